from ledgerloom.operators.canonical import canonical_records
from ledgerloom.operators.ledger import build_ledger, extract
from ledgerloom.streaming.incremental import Table, absorb, compact, current_records, follow
from tests.test_engine import DOCUMENT


def test_batches_give_the_records_of_the_whole_ledger(spark, tmp_path):
    documents = [(f"c{i % 3}", i, "recruiter_notes", "p", None, None, f"skills: Go, S{i}. u{i}@x.org") for i in range(9)]
    ledger = build_ledger(extract(spark.createDataFrame(documents, DOCUMENT)))
    source, own, records = (str(tmp_path / n) for n in ("in", "ledger", "records"))
    for low in (0, 5):
        ledger.where(f"src_order >= {low // 3} AND src_order < {low // 3 + 2}").coalesce(1).write.mode("append").parquet(source)
        query = follow(spark.readStream.schema(ledger.schema).parquet(source), own, records, str(tmp_path / "state"), buckets=8)
        assert query.awaitTermination(120)

    def check():
        want = {r.candidate_id: r for r in canonical_records(spark.read.parquet(source)).collect()}
        got = {r.candidate_id: r for r in current_records(spark, records).collect()}
        assert got.keys() == want.keys() and all(got[k].skills == want[k].skills and got[k].emails == want[k].emails for k in want)

    check()
    compact(spark, own, records, 1)
    check()
    names = Table(spark, own)._names()
    assert {n for n in names if not n.startswith(".")} == {"base=1", "_base-1"} and Table(spark, own).base() == 1
    more = ledger.where("candidate_id = 'c1' AND src_order = 1")
    more.write.mode("append").parquet(source)
    for _ in range(2):  # a batch that runs again replaces itself
        absorb(more, 2, own, records, buckets=8)
    absorb(more, 1, own, records, buckets=8)  # held by the base already
    check()
