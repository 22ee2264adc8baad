"""Keeping canonical records up to date from a stream of ledger rows.

Every micro-batch is appended to the ledger table, in partitions by a hash of
the candidate, and only the candidates that it touches are reduced anew. So a
batch reads the partitions of its candidates: ``buckets`` is to be so large
that a partition is small beside the ledger. Batches are written under their
number, so a batch that runs again replaces itself.

compact() merges all batches up to a number into one base, for the ledger and
for the records (of which only the newest of each candidate stays). A base
counts once its marker is written, and batches that it holds are then no
longer read, so a run that breaks off on the way changes nothing.

Defined results: rows with a null candidate form a record of their own; an
empty batch writes nothing new; repeated rows count as the reductions say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.canonical import canonical_records

BUCKETS = 4096


def bucket_of(candidate: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(candidate), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Table:
    """A folder of batches (batch=N/bucket=B), bases of merged batches (base=N/bucket=B) and their markers (_base-N)."""

    spark: SparkSession
    path: str

    def _names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def base(self) -> int:
        """Up to which batch the newest base reaches; -1 without one."""
        return max((int(n.removeprefix("_base-")) for n in self._names() if n.startswith("_base-")), default=-1)

    def write(self, rows: DataFrame, number: int, kind: str = "batch") -> DataFrame:
        """Replaces one batch or base; the rows as they were written. rows: with a column bucket."""
        place = f"{self.path}/{kind}={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def read(self, upto: int) -> DataFrame | None:
        """All rows with their ``batch`` (that of the base for merged ones), of batches up to a number; None if there are none."""
        base, out = self.base(), None
        found = [("base", base)] if 0 <= base <= upto else []
        found += [("batch", n) for n in sorted(int(n.removeprefix("batch=")) for n in self._names() if n.startswith("batch=")) if base < n <= upto or base > upto >= n]
        for kind, n in found:
            part = self.spark.read.parquet(f"{self.path}/{kind}={n}").withColumn("batch", F.lit(n).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def seal(self, number: int) -> None:
        """Marks a base as whole, and deletes the batches and bases that it holds."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        files = fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.create(fs.Path(f"{self.path}/_base-{number}"), True).close()
        for name in self._names():
            kind, _, n = name.partition("=") if "=" in name else name.partition("-")
            if kind == "batch" and int(n) <= number or kind in ("base", "_base") and int(n) < number:
                files.delete(fs.Path(f"{self.path}/{name}"), True)


def absorb(batch: DataFrame, number: int, ledger_path: str, records_path: str, buckets: int = BUCKETS) -> None:
    """Appends one batch of ledger rows and writes the records of its candidates under the same number."""
    spark = batch.sparkSession
    ledger, records = Table(spark, ledger_path), Table(spark, records_path)
    if number <= min(ledger.base(), records.base()):
        return  # it is part of a base already
    own = ledger.write(batch.withColumn("bucket", bucket_of(F.col("candidate_id"), buckets)), number)
    touched = own.select("candidate_id", "bucket").distinct()
    where = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most ``buckets``
    rows = ledger.read(number).where(F.col("bucket").isin(where))
    changed = rows.join(touched.select(F.col("candidate_id").alias("touched")), F.col("candidate_id").eqNullSafe(F.col("touched")), "left_semi")
    made = canonical_records(changed.drop("bucket", "batch"))
    records.write(made.withColumn("bucket", bucket_of(F.col("candidate_id"), buckets)), number)


def follow(ledger_stream: DataFrame, ledger_path: str, records_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts absorbing a streaming DataFrame of ledger rows until the source has no more (available now)."""
    run = lambda batch, number: absorb(batch, number, ledger_path, records_path, buckets)
    return ledger_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame) -> DataFrame:
    """Of each candidate the row of the last batch."""
    latest = rows.groupBy(F.col("candidate_id").alias("of")).agg(F.max("batch").alias("last"))
    return rows.join(latest, F.col("candidate_id").eqNullSafe(F.col("of")) & (F.col("batch") == F.col("last"))).drop("of", "last")


def current_records(spark: SparkSession, records_path: str) -> DataFrame:
    """The newest record of each candidate."""
    return _newest(Table(spark, records_path).read(1 << 62)).drop("batch", "bucket")


def compact(spark: SparkSession, ledger_path: str, records_path: str, upto: int) -> None:
    """Merges the batches up to a number. To be run between batches."""
    for path, keep in ((ledger_path, lambda rows: rows), (records_path, _newest)):
        table = Table(spark, path)
        if table.base() < upto and (rows := table.read(upto)) is not None:
            table.write(keep(rows).drop("batch"), upto, "base")
            table.seal(upto)
