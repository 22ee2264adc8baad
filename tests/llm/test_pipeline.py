from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import mixing, ngram_join, packing, quality_rules
from ledgerloom.llm import queries as Q
from tests.llm.test_set_operators import check_pieces
from tests.llm.test_text_operators import SF, brute_components, needs_data, odd_docs


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "language_id", "ngram_jaccard_join", "mixing", "packing"]


@needs_data
def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 260").cache()
    good = P.quality(spark, docs, SF)
    assert good.columns == P.COLUMNS and 180 < good.count() < 260
    spoken = P.language(spark, good, SF)
    assert spoken.columns == P.COLUMNS and spoken.count() >= good.count() - 3
    once = P.near_copies(spark, docs, SF)
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100).items() if i == c}
    assert once.columns == P.COLUMNS and {r.doc_id for r in once.collect()} == want
    mixed = P.mixing(spark, docs, SF).cache()
    assert mixed.columns == P.COLUMNS
    texts = {r.doc_id: r.text for r in docs.collect()}
    copies = {r.doc_id: int(r.taken / r.size + 0.5) for r in P.mix_sources(docs).collect() if r.taken}
    found = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}
    packed = P.packing(spark, docs, SF)
    check_pieces(packed.collect(), {r.doc_id: r.text for r in docs.collect()}, 2048)


def test_near_copies_of_repeated_and_missing_ids(spark):
    """One row a group whatever its id; different texts under one id, or under none, all stay."""
    words = [f"w{i}" for i in range(200)]
    near, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::3])
    rows = [(1, near), (1, other), (1, near), (2, near + " more"), (None, third), (None, third + " x"), (None, other + " y"), (3, third), (None, "few words"), (None, "few others"), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in P.near_copies(spark, docs, "").collect())
    want = [(1, near), (1, other), (3, third), (None, "few words"), (None, "few others"), (4, None), (None, None)]
    assert out == sorted((i is None, i or 0, t or "") for i, t in want)


@needs_data
def test_stages_on_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in P.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == P.COLUMNS


def test_oracles_have_queries():
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def test_operators_ignore_columns_named_like_their_own(spark):
    """Input columns that clash with an operator's results change nothing."""
    import public_tokenizers

    docs = odd_docs(spark).select("doc_id", "text", "source")
    clash = docs
    for name in ("n_shingles", "component_id", "class", "key", "start", "length", "offset", "ids", "place", "size", "taken", "target", "pattern", "held_out", "features"):
        clash = clash.withColumn(name, F.lit("x"))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    for run in (
        lambda d: ngram_join.jaccard_components(d, 4, 85, 100),
        lambda d: packing.pack_documents(d, tokenizer).drop("sequence_id", "offset"),
        lambda d: mixing.mix_sources(d),
        lambda d: quality_rules.document_statistics(d).drop("features"),
    ):
        rows = [sorted(map(str, run(d).collect())) for d in (docs, clash)]
        assert rows[0] == rows[1]
