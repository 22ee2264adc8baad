import collections
import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, chat_format, embedding_dedup, mixing, packing, sharding
from ledgerloom.llm import queries as Q
from ledgerloom.llm.components import connected_components
from tests.llm.test_text_operators import ODD, SF, needs_data, odd_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def brute_labels(nodes, pairs):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    want = brute_labels(linked, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing ----


def test_encoder_is_exact():
    encoder = packing.Encoder(BPE)
    assert encoder.fast is not None
    rng = np.random.default_rng(5)
    letters = [*"ab 's\n\t.,!|?é½²Ⅷ0\u3000\x1c\x85\u200b١漢字'", "<|endoftext|>", "'ll", "  ", "\r\n", "\U0001f600"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 14)))) for _ in range(3000)]
    texts += ["'re x've'llamas 'd 'm'sun don't''s", "\u0378 \U0003fffd a", " " * 5000, "a \n\n\n  b" * 700, "longword" * 9000]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    words = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert words.fast is None and words.encode(["Some text"])[0].tolist() == words.tokenizer.encode("Some text", add_special_tokens=False).ids


def test_encoder_of_long_texts(monkeypatch):
    """Texts cut into parts and batches; runs of a million blanks or newlines; pieces forgotten and learned again."""
    encoder = packing.Encoder(BPE)
    rng = np.random.default_rng(9)
    monkeypatch.setattr(byte_bpe, "BATCH", 500)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    texts = ["".join(rng.choice([*"abcdé' \n"], int(n))) for n in rng.integers(0, 3000, 30)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in encoder.encode([" " * 1_000_000, "", "\n" * 1_000_000])] == [1_000_000, 0, len(encoder.tokenizer.encode("\n" * 1_000_000, add_special_tokens=False).ids)]


def check_pieces(rows, texts, window):
    """Every id in exactly one piece, sequences gapless, only full or of a power of two."""
    tokenizer = packing.Encoder(BPE).tokenizer
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window
    return sequences


@needs_data
def test_packing_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.op5_packing(spark, SF).collect()
    sequences = check_pieces(rows, texts, 2048)
    assert np.mean([sum(r.length for r in s) == 2048 for s in sequences.values()]) > 0.9


def test_packing_edge_rows(spark):
    docs = odd_docs(spark).where("doc_id IS NOT NULL")
    rows = packing.pack_documents(docs, BPE, window=64, with_ids=True).collect()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(odd_docs(spark), BPE).where("doc_id IS NULL").count() >= 1
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_neighbours_share_words():
    a, b = np.arange(10, dtype=np.uint32), np.arange(1000, 1010, dtype=np.uint32)
    items = [a, b, a[:8], b[:8], np.arange(50, 60, dtype=np.uint32)]
    index = packing.Index(items)
    unused = np.array([False, True, True, True, True])
    assert index.neighbours(0, unused, 3).tolist() == [2]
    first = next(iter(packing.pack_block([len(x) for x in items], items, 16)))
    assert [d for d, _, _ in first] == [0, 2]


def test_packing_finds_neighbours_in_other_partitions(spark):
    """Sixteen topics of eight documents, one of each topic a partition: windows hold one topic, in one shard and in several."""
    rng = np.random.default_rng(6)
    topics = [[f"{a}{b}" for a in rng.choice([*"bcdfghklmnprst"], 30) for b in rng.choice(["orandi", "ustile", "emaquo"], 1)] for _ in range(16)]
    rows = [(16 * p + t, " ".join(f"topic{t}x{w}" for w in rng.choice(topics[t], 25))) for p in range(8) for t in range(16)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string").cache()
    for block, least in ((1 << 21, 0.9), (3000, 0.7)):
        pieces = packing.pack_documents(docs, BPE, window=256, block=block).collect()
        check_pieces(pieces, dict(rows), 256)
        own = collections.defaultdict(lambda: collections.Counter())
        for r in pieces:
            own[r.sequence_id][r.doc_id % 16] += r.length
        assert sum(max(c.values()) for c in own.values()) > least * sum(r.length for r in pieces)


def test_neighbours_by_all_terms():
    """An item's light terms count too, and weights are those of the table that the statistics describe."""
    common, rare = np.arange(2, 10, dtype=np.uint32), np.arange(100, 150, dtype=np.uint32)
    items = [np.concatenate((common, rare)), np.arange(200, 210, dtype=np.uint32), common]
    frequency = np.ones(300)
    frequency[2:10] = 900
    index = packing.Index(items, packing.Statistics(1000, 50.0, frequency))
    assert index.neighbours(0, np.array([False, True, True]), 2).tolist() == [2]
    assert index.scores(0)[0] - index.scores(0)[2] > 40 * index.scores(0)[2]


def test_scores_are_those_of_bm25():
    """Scores of rows and lists against the formula, written out term by term."""
    rng = np.random.default_rng(12)
    items = [rng.choice(np.concatenate([np.arange(30), np.arange(30, 4000)]), int(n), p=np.concatenate([np.full(30, 0.5 / 30), np.full(3970, 0.5 / 3970)])).astype(np.uint32) for n in rng.integers(1, 200, 150)]
    index = packing.Index(items)
    assert len(index.rows) and len(index.doc)
    mean = np.mean([len(x) for x in items])
    sets = [collections.Counter(x.tolist()) for x in items]
    df = collections.Counter(t for s in sets for t in s)
    for i in (0, 7, 149):
        want = np.zeros(len(items))
        for j, s in enumerate(sets):
            for t in sets[i]:
                if t in s:
                    idf = np.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5))
                    want[j] += idf * s[t] * 2.2 / (s[t] + 1.2 * (0.25 + 0.75 * len(items[j]) / mean))
        assert np.allclose(index.scores(i), want, rtol=1e-4)
        unused = rng.random(len(items)) < 0.5
        got = index.neighbours(i, unused, 12)
        assert unused[got].all() and np.allclose(np.sort(want[got]), np.sort(np.where(unused, want, 0))[-12:], rtol=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25))
def test_blocks_lose_nothing(lengths):
    ids = [np.arange(n, dtype=np.uint32) for n in lengths]
    seen = collections.Counter()
    for sequence in packing.pack_block(lengths, ids, 16):
        total = sum(n for _, _, n in sequence)
        assert total == 16 or total & (total - 1) == 0
        for d, s, n in sequence:
            seen.update((d, s + j) for j in range(n))
    assert set(seen.values()) <= {1} and len(seen) == sum(lengths)


# ---- embeddings ----


def test_embeddings_of_many_lengths(spark):
    """Every length is compared, with an index or without."""
    vectors = spark.range(1, 600).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), F.col("id").cast("int")).alias("embedding"))
    vectors = vectors.unionByName(vectors.select((F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda x: 3 * x).alias("embedding")))
    got = embedding_dedup.dedup_embeddings(vectors).collect()
    assert len(got) == 1198 and all(r.n_links == 1 and r.component_id == (r.vec_id - 1000 if r.vec_id > 1000 else r.vec_id) for r in got)


def test_embeddings_under_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.1, 0.1], [0.0, 1.0, 0.3]
    rows = [(1, a), (1, b), (2, c), (None, a), (3, a), (None, c), (None, [0.0, 0.0, 1.0]), (None, None)]
    got = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got)
    assert found == sorted([(False, 1, 3, 1, True), (False, 1, 3, 1, True), (False, 2, 1, 2, True), (True, 0, 3, 1, False), (False, 3, 3, 1, False), (True, 0, 1, 2, False), (True, 0, 0, 0, True), (True, 0, 0, 0, True)])


@needs_data
def test_recall_of_the_index(spark):
    """Pairs at cosines of 0.9 to 0.92 that visited cells find: all those that brute force finds among the table's vectors and seeded neighbours of them."""
    rows = spark.read.parquet(f"{os.path.dirname(SF)}/sf0.1/embeddings.parquet").select("embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(3)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, (len(x), 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * z])
    index = embedding_dedup.fit_index(both, 16, 0.9, 0.97)
    cells = index.cells(both)
    visited = [set(c.tolist()) for c in cells]
    near = np.argwhere(np.triu(both @ both.T >= 0.9, 1))
    found = [int(cells[j][0]) in visited[i] or int(cells[i][0]) in visited[j] for i, j in near]
    assert len(near) >= len(x) and np.mean(found) >= 0.9


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    rows, vectors = [], {}
    for i in range(900):
        v = base[i % 120] + rng.normal(size=16) * rng.choice([0, 0.05, 0.25, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], "x"))
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [1.0, None] * 8, "x"), (903, [float("nan")] * 16, "x"), (904, [1.0] * 5, "x"), (905, [2.0] * 5, "x"), (906, [], "x"), (907, [3.0], "x"), (908, [1e200] * 16, "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")
    for r in docs.collect():
        v = np.array([x for x in r.embedding or [] if x is not None], float)
        if r.embedding and len(v) == len(r.embedding) and np.isfinite(v).all() and np.linalg.norm(v):
            vectors[r.vec_id] = v / np.linalg.norm(v)
    pairs = [(a, b) for a in vectors for b in vectors if a < b and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= 0.9]
    got = {r.vec_id: r for r in embedding_dedup.dedup_embeddings(docs, codewords=4, indexed=500).collect()}
    assert len(got) == len(rows)
    want = collections.Counter(x for p in pairs for x in p)
    assert all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(want.values())
    label = brute_labels(got, pairs)
    assert np.mean([got[i].component_id == label[i] for i in got]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[904].n_links == 1 and got[905].component_id == 904 and got[900].n_links == 0
    assert embedding_dedup.dedup_embeddings(docs.limit(0)).count() == 0


def test_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    v = np.ones(8) + rng.normal(size=(150, 8)) * 0.02
    docs = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(np.concatenate([v, v[:10]]))], "vec_id long, embedding array<double>")
    got = embedding_dedup.dedup_embeddings(docs, codewords=2, indexed=100).collect()
    assert {r.n_links for r in got} == {159} and {r.component_id for r in got} == {0}


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    got = [a[i] + b[j] for i, j in embedding_dedup.multi_sequence(a, b, 63)]
    assert got == sorted(got) and np.allclose(got, np.sort((a[:, None] + b).ravel()))


# ---- chat ----


def test_chat_round_trip(spark):
    texts = [*(t for t in ODD if t is None or len(t) < 100), "</s>[INST] ok [/INST]", "<|turn|>\\<|end|>", "\\", "<\\", "[\\INST]", "<<SYS>>", "a<b [x] <s>", "<\\|text|>"]
    rows = [(i % 5, i, ["user", "assistant", "assistant", None, "<|turn|>"][i % 4 if i % 7 else 4], t) for i, t in enumerate(texts)] + [(None, 1, "user", "x"), (9, None, "user", "late"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        for s in r.segments:
            if s.loss:
                assert not any(m in s.text for m in ("</s>", "[INST]", "[/INST]", "<|", "<<SYS>>", "<s>"))
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="\\<[|/s>INST]a\n", max_size=12), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    out = rows.select("i", "x", chat_format.unescape(chat_format.escape(F.col("x"))).alias("y"), chat_format.escape(F.col("x")).alias("e")).collect()
    assert all(r.x == r.y for r in out)
    assert not any(m in r.e for r in out for m in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))


# ---- sharding ----


def bins_of(runs):
    """The bin of each item, by size, as runs say."""
    out = collections.defaultdict(list)
    for size, start, end, first, each in runs:
        assert start == len(out[size])
        out[size] += [first + i // each for i in range(end - start)]
    return out


def plain_best_fit(sizes, capacity):
    """Best-fit-decreasing item by item, by plain search: the loads of the bins."""
    remaining = []
    for size in sorted(sizes, reverse=True):
        fit = min(((r, b) for b, r in enumerate(remaining) if r >= size), default=None)
        if fit is None:
            remaining.append(capacity - size)
        else:
            remaining[fit[1]] -= size
    return sorted(capacity - r for r in remaining)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_best_fit_decreasing(sizes):
    classes = list(collections.Counter(sizes).items())
    placed = bins_of(sharding.best_fit_decreasing(classes, 50))
    assert {s: len(b) for s, b in placed.items()} == dict(classes)
    loads = collections.Counter()
    for size, bins in placed.items():
        for b in bins:
            loads[b] += size
    assert sorted(loads.values()) == plain_best_fit(sizes, 50) and set(loads) == set(range(len(loads)))
    capacity, runs = sharding.fewest_bytes(classes, 8)
    assert max(b for bins in bins_of(runs).values() for b in bins) < 8 and capacity >= max(sizes)


def test_shards(spark):
    docs = odd_docs(spark, [f"text {i} " * (i % 40) for i in range(400)])
    for frame, n in ((docs, docs.count()), (docs.limit(0), 0)):
        out = sharding.shard_documents(frame, 8).collect()
        assert len(out) == n
        by = collections.defaultdict(list)
        for r in out:
            by[r.shard].append(r)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    place = collections.defaultdict(set)
    for r in sharding.shard_documents(docs, 8).collect():
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        place[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    clash = docs.select("*", F.lit("x").alias("shard"), F.lit(7).alias("size"), F.lit(1).alias("of_text"), F.lit(1).alias("bytes"))
    assert sharding.shard_documents(clash, 8).count() == docs.count()


def test_shards_are_those_of_plain_best_fit(spark):
    """Thousands of groups of few sizes, some of copies: each shard's bytes are those of packing group by group."""
    texts = [f"{i:06d}" * (1 + i % 97) for i in range(3000)] + ["copied " * 30] * 400 + ["twice " * 5] * 2 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = [n * (len((t or "").encode()) + 1) for t, n in collections.Counter(t or "" for t in texts).items()]
    out = sharding.shard_documents(docs, capacity=100_000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sorted(r.s for r in out) == plain_best_fit(sizes, 100_000)
    capacity, _ = sharding.fewest_bytes(list(collections.Counter(sizes).items()), 8)
    out = sharding.shard_documents(docs, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sorted(r.s for r in out) == plain_best_fit(sizes, capacity)
    with pytest.raises(ValueError, match="exceeds the capacity"):
        sharding.shard_documents(docs, capacity=1000)


@needs_data
def test_shards_of_documents_are_even(spark):
    sizes = [r.s for r in Q.op9_sharding(spark, SF).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)


# ---- mixing ----


def brute_targets(sizes, weights, total, most):
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        w = sum(weights[s] for s in sizes if s not in fixed)
        t = {s: left * weights[s] / w for s in sizes if s not in fixed} if w else {}
        over = {s: most * sizes[s] for s in t if t[s] > most * sizes[s]}
        if not over:
            return fixed | t
        fixed |= over


def check_mix(rows, sources):
    sizes = collections.Counter()
    for r in rows:
        sizes[sources[r.doc_id]] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = brute_targets(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[sources[r.doc_id]] and abs(r.target - want[sources[r.doc_id]]) < 1e-6
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_edge_rows(spark):
    docs = odd_docs(spark, [f"{'w ' * (i % 90)}" for i in range(300)]).where("doc_id IS NOT NULL")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows, {r.doc_id: r.source for r in docs.collect()})
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@needs_data
def test_mix_of_documents(spark):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    check_mix(Q.op10_mixing(spark, SF).collect(), sources)


def test_mix_of_sources_with_odd_names(spark):
    """Names with control characters, quotes and commas are names of their own."""
    names = ["s", "s\x1ft", "t\x1f", "\x1f", '"', 'a","b', "a", "b", "", "null", None]
    rows = [(i, "w " * (1 + i % 5), names[i % len(names)], 1, 1, "x") for i in range(110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, size int, pattern string")
    check_mix(mixing.mix_sources(docs).collect(), {r[0]: r[2] for r in rows})
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_sources(docs, most_patterns=10)


def cheapest(patterns, quotas, repeats):
    """Most words routed, and their least cost, by successive shortest paths (Bellman-Ford) over single words."""
    arcs = []  # from, to, room, cost
    names = list(quotas)
    for i, (members, words) in enumerate(patterns):
        arcs += [["in", i, words, r] for r in range(repeats)] + [[i, s, words * repeats, 0] for s in members if s in quotas]
    arcs += [[s, "out", quotas[s], 0] for s in names]
    flow, cost = 0, 0
    used = [0] * len(arcs)
    while True:
        far, came = {"in": 0}, {}
        for _ in range(len(patterns) + len(names) + 2):
            for e, (a, b, room, c) in enumerate(arcs):
                for x, y, free, d, sign in ((a, b, room - used[e], c, 1), (b, a, used[e], -c, -1)):
                    if x in far and free and far[x] + d < far.get(y, np.inf):
                        far[y], came[y] = far[x] + d, (x, e, sign, free)
        if "out" not in far:
            return flow, cost
        path, y = [], "out"
        while y != "in":
            path.append(came[y])
            y = came[y][0]
        n = min(p[3] for p in path)
        for _, e, sign, _ in path:
            used[e] += sign * n
        flow, cost = flow + n, cost + n * far["out"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcd"), min_size=1), st.integers(0, 30)), min_size=1, max_size=7), st.lists(st.integers(0, 60), min_size=4, max_size=4), st.integers(1, 3))
def test_flow_is_cheapest(found, quotas, repeats):
    patterns, quotas = [(frozenset(m), n) for m, n in found], dict(zip("abcd", quotas, strict=True))
    given_ = mixing.route(patterns, quotas, repeats)
    totals = [sum(g.values()) for g in given_]
    for (members, words), g, total in zip(patterns, given_, totals, strict=True):
        assert set(g) <= members and total <= repeats * words
    assert all(sum(g.get(s, 0) for g in given_) <= q for s, q in quotas.items())
    cost = sum(r * min(words, max(0, total - r * words)) for (_, words), total in zip(patterns, totals, strict=True) for r in range(repeats))
    assert (sum(totals), cost) == cheapest(patterns, quotas, repeats)


def test_many_sources_are_routed_in_linear_time():
    patterns = [(frozenset([i]), 5 + i % 9) for i in range(100_000)]
    given_ = mixing.route(patterns, {i: 7 for i in range(100_000)}, 2)
    assert all(sum(g.values()) == min(7, 2 * (5 + i % 9)) for i, g in enumerate(given_))


def test_flow_over_overlapping_sources(spark):
    patterns = [(frozenset("a"), 100), (frozenset("ab"), 100), (frozenset("b"), 20)]
    given_ = mixing.route(patterns, {"a": 120, "b": 100}, 2)
    assert sum(g.get("a", 0) for g in given_) == 120 and sum(g.get("b", 0) for g in given_) == 100
    assert [sum(g.values()) for g in given_] == [100, 100, 20]  # once each, before anything repeats
    assert sum(sum(g.values()) for g in mixing.route(patterns, {"a": 1000, "b": 1000}, 2)) == 440
    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 3 else ["a", "b"]) for i in range(60)], "doc_id long, text string, source array<string>")
    out = mixing.mix_sources(docs, weights={"a": 1, "b": 1}, share=1.0).collect()
    assert sum(r.taken for r in out) == 600 and all(r.taken <= 20 for r in out)
