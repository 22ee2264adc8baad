"""What several operators share: bounded samples, scratch tables, column checks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local folder in local mode and an error on a cluster."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


#: Rows of a scratch file, about.
ROWS_A_FILE = 200_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows written as Parquet under the shared folder and read again: short lineage that survives lost executors.

    ``rows``: about how many at most; small tables then go to few files, but no fewer than there are cores.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written(), and whatever else was read from the same folder."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referred to, instead of whenever the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch at most, where rows are whole texts: a batch is held several times over on its way to Python and back.
TEXTS_A_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to TEXTS_A_BATCH rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_A_BATCH:
        spark.conf.set(key, str(TEXTS_A_BATCH))


def need(df: DataFrame, *columns: str) -> None:
    """Raises on missing input columns, before any job runs."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}; there are {', '.join(df.columns)}")


def residue(column, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def _drawn(id_column):
    """A number from 0 to 999999 by a hash of the id."""
    return F.pmod(F.xxhash64(id_column.cast("string"), F.lit(7)), F.lit(1_000_000))


def thinned(rows: DataFrame, most: int) -> DataFrame:
    """About 4 * most rows (all, if there are fewer), chosen by a hash of doc_id: so what a limit sends to the driver doesn't grow with the input."""
    share = 4 * most / max(1, rows.count())
    return rows if share >= 1 else rows.where(_drawn(F.col("doc_id")) < int(share * 1_000_000) + 1)


def labelled_sample(docs: DataFrame, most: int, longest: int, strata: str) -> list:
    """At most ``most`` labelled texts (rows of text and ``strata``), evenly by a hash of the id.

    docs: doc_id, text and the label column ``strata``; rows with a null label,
    a null text or more than ``longest`` characters aren't used for fitting.
    """
    rows = (
        thinned(docs.where(F.col(strata).isNotNull()), most)
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .select("doc_id", "text", strata)
        .orderBy(_drawn(F.col("doc_id")), "doc_id", "text")
        .limit(most)
    )
    return rows.collect()


def sampled_ids(labels: DataFrame, most: int, label: str) -> DataFrame:
    """At most ``most`` labelled ids by hash, one row an id (its greatest label): small enough to broadcast."""
    return (
        thinned(labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label), most)
        .orderBy(_drawn(F.col("doc_id")), "doc_id", F.desc(label))
        .limit(most)
        .groupBy("doc_id")
        .agg(F.max(label).alias(label))
    )


def with_text_columns(docs: DataFrame, added: str, function: Callable[[list], list], column: str = "text") -> DataFrame:
    """docs with columns ``added`` (a schema text) computed from batches of whole texts in ``column`` as UTF-8 bytes.

    Input columns whose names clash with an added one are replaced. The
    function is broadcast once; texts reach Python in Arrow batches.
    """
    from pyspark.sql.types import StructType

    need(docs, column)
    small_batches(docs.sparkSession)
    fresh = StructType.fromDDL(added)
    kept = docs.drop(*(c for c in fresh.names if c != column))
    kept = kept.withColumn(column, F.col(column).cast("string"))
    at = kept.columns.index(column)
    shared = docs.sparkSession.sparkContext.broadcast(function)
    names = [*kept.columns, *fresh.names]

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerloom.llm.textkernel import utf8_list

        for part in parts:
            made = shared.value(utf8_list(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in made)], names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *fresh.fields]))
