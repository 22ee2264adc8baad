import collections
import html.parser
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fragments, html_text, language_id, ngram_join, quality_classifier, quality_rules
from ledgerloom.llm import queries as Q
from ledgerloom.llm import textkernel as K
from ledgerloom.llm.language_id import fit_language_id, identify_languages
from ledgerloom.llm.quality_classifier import fit_quality_classifier, score_quality

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
ODD = [None, "", " \t\n", "a", "é", "a b c d e f g", "x " * 5000, "A B C D E F G", "<|endoftext|> [INST] </s>", "ß" * 3000, "one\ntwo\none\n\n\n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, kept string, lang_pred string, n_words string"


def odd_docs(spark, more=()):
    texts = [*ODD, *ODD[:5], *more]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, *["x"] * 5)], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_do_not_depend_on_place():
    text = ("aa bb\tcc " * 300_000).encode()
    _, _, h = K.words_of(np.frombuffer(text, np.uint8))
    assert len(h) == 900_000 and len(np.unique(h)) == 3
    long_word = b"y" * (3 << 20) + b" z " + b"y" * (3 << 20)
    _, _, h = K.words_of(np.frombuffer(long_word, np.uint8))
    assert len(h) == 3 and h[0] == h[2] != h[1]


def test_shingle_sets():
    texts = [(t or "").encode() for t in ODD]
    for text, got in zip(ODD, K.shingle_sets(texts, 4), strict=True):
        w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
        want = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        assert len(got) == len(want)
    sets = list(K.shingle_sets(texts, 4))
    assert (sets[5] == sets[7]).all()  # only A-Z are folded


@pytest.mark.parametrize("p", [80, 85])
def test_similar_sets_agree_in_a_fragment(p):
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        keep = rng.random(len(a)) > rng.random() * 0.25
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if fragments.linked(np.array(shared), len(a), len(b), p, 100):
            common = np.intersect1d(fragments.signatures(a, p, 100), fragments.signatures(b, p, 100))
            here = fragments.meets_here(common, np.array(len(a)), np.array(len(b)), p, 100).sum()
            assert len(a) == len(b) == shared or here >= fragments.sure_to_share(np.array(len(a)), np.array(len(b)), p, 100) + 2 * fragments.may_drop(fragments.differences(fragments.level_of(np.array(max(len(a), len(b))), p, 100), p, 100))
            x, y = (ngram_join.sketch_of(s, ngram_join.sketch_words(len(s))) for s in (a, b))
            assert ngram_join._apart(x, y) <= ngram_join.most_apart(len(a), len(b), p, 100)


def brute_components(rows, k, p, q):
    sets = {}
    for i, text in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def varied(seed, n):
    """Groups of near copies of texts, edited by zero to a tenth of their words."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = [f"w{rng.integers(0, 300)}" for _ in range(int(rng.integers(3, 160)))]
        for _ in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 20))):
                t[rng.integers(0, len(t))] = f"e{rng.integers(0, 9)}"
            out.append(" ".join(t) + (" shared passage of many words in all texts" if g % 2 else ""))
    return out


def test_ngram_join_against_brute_force(spark):
    docs = odd_docs(spark, varied(3, 60))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 5, 80, 100).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()], 5, 80, 100)


def test_ngram_join_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(90):
        t = list(base)
        for _ in range(i % 9):
            t[rng.integers(0, 80)] = f"e{i}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85, 100)


def near_and_far(near, far):
    """``near`` texts that all link with each other, then the lowest and the highest classes (``far`` each), which link with none of those."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]

    def edited(i, words):
        t = list(base)
        for j, at in enumerate(rng.choice(150, words, replace=False)):
            t[at] = f"e{i}x{j}"
        return " ".join(t)

    def by_class(texts):
        return sorted(zip([ngram_join.class_of(x) for x in K.shingle_sets([t.encode() for t in texts], 4)], texts, strict=True))

    outer = by_class([edited(i, 6) for i in range(1500)])
    outer = outer[:far] + outer[-far:]
    inner = [t for c, t in by_class([edited(5000 + i, 1) for i in range(2 * near)]) if outer[far - 1][0] < c < outer[far][0]][:near]
    assert len(inner) == near
    return inner + [t for _, t in outer]


def test_ngram_join_names_no_pairs_of_a_group(spark, monkeypatch):
    """A group of texts that all link, but not with the ends of their buckets: twice as many texts make about twice as many rows of pairs, and no link is lost."""
    plain, pairs = ngram_join.written, []

    def written(df, *more):
        out = plain(df, *more)
        if {"a", "b"} <= set(out.columns):
            pairs[-1] = max(pairs[-1], out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    for near in (60, 120):
        pairs.append(0)
        texts = near_and_far(near, 40)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
        assert got == brute_components(list(enumerate(texts)), 4, 85, 100)
        assert [got[i][1] for i in range(near)] == [0] * near
    assert pairs[1] <= 2.5 * pairs[0]


def test_block_links_against_brute_force():
    """Sets of many sizes at both sides of a block, and on one: what links join is joined by fewer links than there are sets, all of them links."""
    rng = np.random.default_rng(12)
    for two in (False, True):
        sets = []
        for n in (1, 5, 60, 63, 68, 250, 270, 1000) * 12:
            base = np.random.default_rng(n // 50).integers(0, 2**63, 1200, dtype=np.uint64)[:n]
            own = np.concatenate([base[rng.random(n) > rng.choice([0, 0.02, 0.1])], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)])
            sets.append(np.unique(own) if len(own) else base)
        m = len(sets)
        side = rng.integers(0, 2, m) if two else np.full(m, 2)
        comp = np.where(rng.random(m) < 0.2, rng.integers(0, m, m), np.arange(m) + m)
        linked = [(i, j) for i in range(m) for j in range(i + 1, m) if (not two or side[i] != side[j]) and fragments.linked(np.array(len(np.intersect1d(sets[i], sets[j]))), len(sets[i]), len(sets[j]), 85, 100)]
        found = ngram_join._joining(side, comp, sets, 85, 100)
        assert {tuple(sorted(x)) for x in found} <= set(linked) and 0 < len(found) < m
        nodes = {int(c) for c in comp}
        assert connected(nodes, [(int(comp[i]), int(comp[j])) for i, j in linked]) == connected(nodes, [(int(comp[i]), int(comp[j])) for i, j in found])


def connected(nodes, pairs):
    label = {n: n for n in nodes}
    for _ in nodes:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(odd_docs(spark).limit(0), 4, 85, 100).count() == 0


def brute_statistics(text):
    w = words(text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_quality_statistics():
    texts = [*ODD, "a b c a b c", "a b a b a", "#x *y| <z>\n#x *y| <z>\nq", "a b c d a b c e", "ü b c ü b c\x00d"]
    counts, feats = quality_rules.statistics([None if t is None else t.encode() for t in texts])
    assert counts.tolist() == [brute_statistics(t) for t in texts] and np.isfinite(feats).all()


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality_rules.FEATURES)))
    symbols = quality_rules.FEATURES.index("symbols")
    y = ((x[:, symbols] + 0.4 * x[:, 0] + 0.3 * rng.random(600)) < 0.8).astype(float)
    model = quality_rules.fit_trees(x, y, rounds=25)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.9
    rising = np.repeat(x[:50, None], 20, axis=1)
    rising[:, :, symbols] = np.linspace(0, 1, 20)
    p = model.probability(rising.reshape(-1, x.shape[1])).reshape(50, 20)
    assert (np.diff(p, axis=1) <= 1e-12).all()
    walked = model.base + sum(leaf[0] for leaf in model.leaf * 0)
    assert walked == model.base and model.margin(x[:1]).shape == (1,)
    assert quality_rules.fit_trees(x[:0], y[:0]).probability(x[:2]).tolist() == quality_rules.fit_trees(x, y * 0 + 1).probability(x[:2]).tolist()


@needs_data
def test_quality_rules_on_labels(spark):
    got = {r.doc_id: r for r in Q.op8_quality_rules(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = [(x.quality, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert np.mean([q == k for q, k in kept]) > 0.97
    for t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        r = got[t.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_statistics(t.text)


def test_trees_against_walking_them():
    """Scores of flattened trees are those of following every row node by node."""
    rng = np.random.default_rng(4)
    x = rng.random((300, len(quality_rules.FEATURES)))
    model = quality_rules.fit_trees(x, (x[:, 1] > 0.4).astype(float), rounds=12)
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9


def test_quality_rules_edge_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality_rules.apply_quality_rules(docs, quality_rules.fit_quality_rules(docs, labels))
    assert out.count() == docs.count() and out.where("kept").count() <= 3
    assert quality_rules.apply_quality_rules(docs.limit(0), quality_rules.fit_quality_rules(docs.limit(0), labels)).count() == 0


@needs_data
def test_quality_classifier_held_out(spark):
    got = {r.doc_id: r for r in Q.op2_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(x.quality, got[x.doc_id].predicted) for x in labels if got[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def brute_pooled(vectors, text):
    """Means of the vectors of a text's words and forms, word by word."""
    size, pooled = vectors.size, np.zeros(2 * vectors.size)
    found = words(text)
    for i, w in enumerate(found):
        buf = np.frombuffer(w.encode(), np.uint8)
        key = K.words_of(buf)[2]
        at = np.flatnonzero(vectors.keys == key[0])
        pooled[:size] += vectors.words[at[0]] if len(at) else quality_classifier.index_vectors(key, size)[0]
        recent = w.encode() in [x.encode() for x in found[max(0, i - 6) : i]]
        line = " ".join([w] * (2 if recent else 1)).encode()
        buf = np.frombuffer(line, np.uint8)
        starts, ends, hashes = K.words_of(buf)
        pooled[size:] += vectors.forms[quality_classifier.word_forms(buf, starts, ends, hashes, np.array([0, len(hashes)]))[-1]]
    pooled[:size] /= len(found) + quality_classifier.SHRINK
    pooled[size:] /= max(1, len(found))
    return pooled


def brute_context(texts, word, size):
    """The sum of the index vectors around a word, over all its places."""
    total = np.zeros(size)
    for text in texts:
        found = words(text)
        for i, w in enumerate(found):
            for j in range(max(0, i - 2), min(len(found), i + 3)):
                if w == word and j != i:
                    spots, signs = quality_classifier.index_parts(K.words_of(np.frombuffer(found[j].encode(), np.uint8))[2], size)
                    np.add.at(total, spots[0], signs[0])
    return total


@needs_data
def test_word_vectors_against_brute_force(spark):
    """Contexts and pooled vectors of fifty documents, word by word."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000 AND text IS NOT NULL").orderBy("doc_id").limit(50).collect()]
    raw = [t.encode() for t in texts]
    vectors = quality_classifier.Vectors(quality_classifier.vocabulary(raw), 32)
    texts_with = collections.Counter(w for t in texts for w in set(words(t)))
    known = [w for w, n in texts_with.items() if n >= quality_classifier.LEAST_TEXTS]
    assert len(vectors.keys) == len(known)
    vectors.learn(raw)
    for word in known[:10]:
        key = K.words_of(np.frombuffer(word.encode(), np.uint8))[2]
        context = brute_context(texts, word, 32)
        want = quality_classifier.index_vectors(key, 32)[0] + context / max(np.linalg.norm(context), 1e-9)
        assert np.allclose(vectors.words[vectors.place(key)[0]], want, atol=1e-5)
    more = ["", "a", "never seen before never"]
    pooled, n = vectors.pooled([*raw, *(t.encode() for t in more)])
    for text, row, count in zip([*texts, *more], pooled, n, strict=True):
        assert count == len(words(text)) and np.allclose(row, brute_pooled(vectors, text), atol=1e-4)


def test_quality_classifier_edge_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    out = score_quality(docs, fit_quality_classifier(docs, labels)).collect()
    assert len(out) == docs.count() and out[0].score == 0 and set(out[0].asDict()) == set(docs.columns)
    assert score_quality(docs.limit(0), fit_quality_classifier(docs.limit(0), labels)).count() == 0


@needs_data
def test_language_id_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = Q.op4_language_id(spark, SF).collect()
    held = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_language_id_learns_whole_texts(spark):
    """Texts that all begin with the same long foreign heading are told apart by what follows."""
    heading = "lorem ipsum dolor sit amet consectetur " * 200
    words = {"de": "der hund und die katze schlafen nicht ", "en": "the dog with this cow thinks what they say "}
    rows = [(i, heading + words[lang] * 250, lang) for i, lang in enumerate(["de", "en"] * 10)]
    model = fit_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = model.predict([words["de"].encode(), words["en"].encode(), (heading + words["en"] * 400).encode()])
    assert names == ["de", "en", "en"] and min(scores) > 0.6


@needs_data
def test_language_kernel_against_sets(spark):
    """Kernels of fifty documents with the landmarks, and predictions, from sets of n-grams."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 6000 AND lang IS NOT NULL").select("doc_id", "text", "lang").orderBy("doc_id").limit(50)
    model = fit_language_id(rows, landmarks=12)

    def gram_set(codes):
        return {tuple(codes[i : i + n]) for n in (1, 2, 3) for i in range(len(codes) - n + 1)}

    numbers = {}
    for a in range(64):
        for grams in ((a,), *((a, b) for b in range(64)), *((a, b, c) for b in range(64) for c in range(64))):
            numbers[grams] = int(language_id.grams(np.array(grams, np.uint8))[len(grams) - 1][0])
    marks = [np.flatnonzero(model.landmarks[:, i]) for i in range(model.landmarks.shape[1])]
    for r in rows.collect():
        parts = language_id.pieces(language_id.coded(r.text.encode()))
        got = model.kernel(parts)
        for part, kernels in zip(parts, got, strict=True):
            own = {int(model.column[numbers[g]]) for g in gram_set(part.tolist())} - {0}
            want = [len(own & set(m.tolist())) / max(1, len(own)) ** 0.5 / len(m) ** 0.5 for m in marks]
            assert np.allclose(kernels, want, atol=1e-4)
        value = sum(len(p) * (k @ model.weights) for p, k in zip(parts, got, strict=True))
        assert model.predict([r.text.encode()])[0] == [model.languages[int(np.argmax(value))]]


def test_language_id_edge_rows(spark):
    more = ["das ist ein kurzer deutscher text über nichts", "this is a short english text about nothing"] * 6
    rows = [(100 + i, t, "de" if i % 2 == 0 else "en") for i, t in enumerate(more)]
    model = fit_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(odd_docs(spark, ["ein deutscher text", "12 34 !?"]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[17] == ("und", 0.0) and got[16][0] == "de" and 0 < got[16][1] <= 1
    none = fit_language_id(odd_docs(spark).where("lang IS NULL"))
    assert {r.lang_pred for r in identify_languages(odd_docs(spark), none).collect()} == {"und"}
    assert identify_languages(odd_docs(spark).limit(0), model).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies to do it all for you and more and more text, really a lot of it.</div>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="sidebar"><p>Side paragraph with lots of text, long enough to pass any threshold of length.</p></div>
<article><h2>Title &amp; more</h2><p>First para&nbsp;graph is long &lt;enough&gt; to count.<p>Short.<ul><li>one</li><li>two <b>bold</b>word</li></ul>
<form><p>Subscribe now</p></form><table><tr><td>a</td><td>b</td></tr></table><aside>Buy</aside><script>var t="</p>";</script><p>Last one<br>line two.</p></article>
<section id="comments"><p>Great article, thanks for writing it, I really liked reading your long text.</p></section><footer>&copy; 2020</footer></body></html>"""
WANT = "Title & more\n\nFirst para graph is long <enough> to count.\n\nShort.\n\none\n\ntwo boldword\n\na b\n\nLast one line two."


def test_html_main_text():
    assert html_text.main_text(PAGE) == WANT
    unmarked = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(unmarked) == WANT
    for page, want in ((None, ""), ("", ""), ("text only", "text only"), ("<p>hi", "hi"), ("<!-- x", ""), ("<script>x", ""), ("<p>a</p", "a"), ("&am", "&am"), ("<article><p>Be.</p></article>", "Be."), ("<p>1 < 2", "1 < 2")):
        assert html_text.main_text(page) == want
    cut = html_text.main_text(PAGE[: PAGE.index("Last one") + 4])
    assert cut == WANT[: WANT.index("Last") + 4]


def test_html_layout_words_do_not_hide_the_article():
    body = PAGE[PAGE.index("<header") : PAGE.index("</body>")]
    for opens, closes in (('<div class="page has-sidebar menu-open">', "</div>"), ("<form action=x>", "</form>"), ('<div id="nav-page"><div class="banner-layout">', "</div></div>")):
        assert html_text.main_text(f"<body>{opens}{body}{closes}</body>") == WANT
    hidden = '<div class="related-posts"><article><p>Another article that is long enough to be taken for the text of the page.</p></article></div>'
    assert html_text.main_text(f"<body>{body}{hidden}</body>") == WANT


def test_html_article_in_a_form_or_layout_container():
    body = "".join(f"<p>Paragraph {i} of the article, which has enough words to be read as text.</p>" for i in range(5))
    want = "\n\n".join(f"Paragraph {i} of the article, which has enough words to be read as text." for i in range(5))
    for opens, closes in (("<form>", "</form>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='menu-open'>", "</div>")):
        for holder in ("<div id=content>", "<div class='post-content'>"):
            assert html_text.main_text(f"<body>{opens}<p>Log in</p>{holder}{body}</div>{closes}</body>") == want
    sidebar = "<div class=sidebar><div class=content><p>About the author, in a few words.</p></div></div>"
    assert html_text.main_text(f"<body>{body}{sidebar}</body>") == want
    teaser = "<article><p>Another story you may like</p></article>"
    assert html_text.main_text(f"<body><main>{body}{teaser}</main></body>").startswith(want)


def test_html_short_rest_after_an_interruption():
    body = "<p>" + "A long first paragraph of the article. " * 5 + "</p>"
    form = "<form>" + "<p>Subscribe to our letter</p>" * 4 + "</form>"
    assert html_text.main_text(f"<body>{body}{form}<p>And a short last line.</p></body>").endswith("And a short last line.")


def test_html_line_blocks():
    long = "x" * 90
    assert html_text.spans([0, 0, 90, 5, 0, 0, 0, 0, 100], [False] * 9) == [(0, 4), (6, 9)]
    assert html_text.spans([50, 0, 0, 0, 90, 0, 0, 0, 5], [False] * 9) == [(2, 5), (6, 9)]  # no surge in the first window
    assert html_text.spans([50, 0, 0, 0, 90], [True] * 5) == [(0, 5)]
    menu = "".join(f"<p><a href=x>menu entry number {i} is long</a></p>" for i in range(6))
    page = f"<body>{menu}<p>{long}</p><p>tiny</p><p>{long}</p>{menu}</body>"
    assert html_text.main_text(page) == f"{long}\n\ntiny\n\n{long}"


def test_html_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    out = html_text.extract_pages(pages).collect()
    assert [(r.page_id, r.n_chars) for r in out] == [(1, len(WANT)), (1, len(WANT)), (2, 0), (None, 0)] and out[0].text == WANT
    assert html_text.extract_pages(pages.limit(0)).count() == 0


class Blocks(html.parser.HTMLParser):
    """A page's text blocks by another parser: what lies in nav, footer, an advert, script, style or title is left out."""

    OUT = {"nav", "footer", "script", "style", "title"}

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "article", "br"):
            self.blocks.append("") if tag != "br" else self.handle_data(" ")
        if tag in self.OUT or tag == "div":
            self.open.append((tag, tag in self.OUT or ("class", "ad") in attrs))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article", "nav", "footer"):
            self.blocks.append("")
        if self.open and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        if not any(out for _, out in self.open):
            self.blocks[-1] += data

    def text(self, page):
        self.feed(page or "")
        self.close()
        found = (" ".join(b.split()) for b in self.blocks)
        return "\n\n".join(b for b in found if b)


@needs_data
def test_html_extraction_of_pages(spark):
    """All pages against another parser; and again with <article> renamed, so that nothing marks the text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op3_html_extraction(spark, SF).collect():
        assert r.text == Blocks().text(pages[r.page_id]) and r.n_chars == len(r.text)
        plain = re.sub(r"<(/?)article>", r"<\1div>", pages[r.page_id])
        assert html_text.main_text(plain) == r.text


def test_html_nesting_takes_linear_time():
    n = 100_000
    assert html_text.main_text("<div>" * n + "deep text" + "</div>" * n) == "deep text"
    assert html_text.main_text("<b class=x><table>" + "<div class=menu>" * n + "</b>" * n + "menu") == ""


def test_residue(spark):
    import zlib

    from ledgerloom.llm.common import residue

    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12)], "doc_id long")
    assert [r.x for r in rows.select(residue(F.col("doc_id"), 5).alias("x")).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, -3, 10**12)]
