"""Packing documents into fixed windows with their lexical neighbours.

The texts become token ids once, in a scratch table; document frequencies, the
number of documents and their mean length are taken over all of them. What a
document holds beyond its whole windows is its item. Items are ordered by the
terms that weigh most in them, among terms common enough to fill a good part of
a shard, and dealt by ranges of that order to shards of about BLOCK tokens: so
related items meet whatever file they come from, a frequent first term is
divided by the next ones, and equal items by their place. A shard gets a BM25
inverted index with the statistics of the whole table; a seed queries it with
all its terms, and the unused neighbours, best first, fill the window. The item
at the window's end is cut there and its rest seeds the next window, so windows
are full. What a shard leaves over is cut into sequences whose lengths are
powers of two, which need no padding either. Memory is bounded by a shard.

Neighbours in another shard aren't found: a search over all items for every
window would grow with the square of the table (README).

Defined results: null and empty texts are the end id alone; repeated rows are
packed each for itself; rows with a null id are packed too; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.byte_bpe import PRETOKENS, ByteBpe, sure
from ledgerloom.llm.common import need, small_batches, written
from ledgerloom.llm.textkernel import utf8_list

BLOCK = 1 << 21
#: Terms that order the items.
KEYS = 3
#: Terms that at least one in so many items of a shard has are held as a row.
DENSE = 16


def byte_symbols() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that ``tokenizers`` gives for a tokenizer file, without special tokens.

    Texts go through ByteBpe, which yields the same ids several times faster;
    texts with a special token's string or a character of unknown class, and
    files that aren't plain byte-level BPE, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._load(spec)

    def _load(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        import tiktoken

        symbols = byte_symbols()
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        if any(c not in symbols for k in vocab for c in k):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        if sorted(set(order)) != order or len(order) + 256 != len(vocab) or min(order, default=256) < 256:
            return None  # merges aren't ranked by id
        ranks = {bytes(symbols[c] for c in k): v for k, v in vocab.items()}
        return ByteBpe(tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and not any(a in t for a in self.added) and sure(t) for t in texts]
        made = iter(self.fast.encode([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        return [next(made) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]


_encoders: dict[str, Encoder] = {}


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and how often each occurs."""
    s = np.sort(ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[first].astype(np.int64), np.diff(np.append(first, len(s)))


class Statistics:
    """What BM25 needs to know of a whole table: number of documents, their mean length, document frequencies by term."""

    def __init__(self, n: int, mean: float, frequency: np.ndarray):
        self.n, self.mean, self.frequency = n, max(mean, 1), frequency
        self.idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    def weights(self, term: np.ndarray, count: np.ndarray, length, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        return (self.idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * length / self.mean))).astype(np.float32)

    def keys(self, ids: np.ndarray, least: float) -> list[int]:
        """The KEYS weightiest terms: those of ``least`` documents or more, then the others; -1 where there are no more."""
        term, count = counted(ids)
        weight = self.weights(term, count, len(ids))
        best = np.lexsort((-weight, self.frequency[term] < least))[:KEYS]
        return term[best].tolist() + [-1] * (KEYS - len(best))


class Index:
    """BM25 over a shard's items: postings by term, and each item's terms. Without statistics of a table those of the items count."""

    def __init__(self, items: list[np.ndarray], statistics: Statistics | None = None):
        found = [counted(x) for x in items]
        self.n, self.query = len(items), [t for t, _ in found]
        owner = [len(t) for t in self.query]
        term, count = np.concatenate(self.query), np.concatenate([c for _, c in found])
        doc = np.repeat(np.arange(self.n), owner)
        length = np.array([len(x) for x in items])
        frequency = np.bincount(term)
        statistics = statistics or Statistics(self.n, length.mean(), frequency)
        weight = statistics.weights(term, count, length[doc])
        # Postings of terms that many items have are rows of a matrix (at most DENSE numbers a posting), the others' are lists.
        often = frequency * DENSE >= self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n), np.float32)
        many = often[term]
        self.rows[self.row[term[many]], doc[many]] = weight[many]
        term, doc, weight = term[~many], doc[~many], weight[~many]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float64)
        self.first = np.concatenate(([0], np.cumsum(np.where(often, 0, frequency))))

    def scores(self, item: int) -> np.ndarray:
        """BM25 scores of all items for one item's terms."""
        terms = self.query[item]
        row = self.row[terms]
        asked = np.zeros(len(self.rows), np.float32)
        asked[row[row >= 0]] = 1
        score = (asked @ self.rows).astype(np.float64)
        if spans := [slice(self.first[t], self.first[t + 1]) for t in terms[row < 0]]:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return score

    def neighbours(self, item: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Unused items that share a term, best first (equal scores: lower number first)."""
        score = np.where(unused, self.scores(item), 0)
        best = np.argpartition(-score, most)[:most] if self.n > most else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def pack_block(lengths: Sequence[int], ids: Sequence[np.ndarray], window: int, statistics: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) over documents of the given lengths (end id included)."""
    items, starts = [], []
    for d, n in enumerate(lengths):
        for k in range(n // window):
            yield [(d, k * window, window)]
        if n % window:
            items.append(d), starts.append(n - n % window)
    if not items:
        return
    index = Index([ids[d][s:] for d, s in zip(items, starts, strict=True)], statistics)
    left = np.array([lengths[d] - s for d, s in zip(items, starts, strict=True)])
    unused, sequence, room, cursor = np.ones(len(items), bool), [], window, 0
    seed, ahead = 0, [0]
    while True:
        if not ahead:
            ahead = index.neighbours(seed, unused, 12).tolist()
            if not ahead:  # nothing shares a term: the next unused in order
                while cursor < len(items) and not unused[cursor]:
                    cursor += 1
                if cursor == len(items):
                    break
                ahead = [cursor]
        i = ahead.pop(0)
        unused[i] = False
        if not sequence:
            seed = i
        while left[i]:
            take = int(min(left[i], room))
            sequence.append((items[i], starts[i], take))
            starts[i] += take
            left[i] -= take
            room -= take
            if not room:
                yield sequence
                # the cut document's rest, or the next unused one, is the new seed
                sequence, room, ahead, seed = [], window, [], i
    while sequence:  # by powers of two, largest first
        size = 1 << (sum(n for _, _, n in sequence).bit_length() - 1)
        part, rest = [], []
        for d, s, n in sequence:
            take = min(n, size)
            if take:
                part.append((d, s, take))
            if n > take:
                rest.append((d, s + take, n - take))
            size -= take
        yield part
        sequence = rest


def _encoded(docs: DataFrame, tokenizer: str, window: int, end_id: int, whole: bool) -> DataFrame:
    """Token ids: place, doc_id, doc_tokens, windows (checksums of whole windows), ids (those beyond the whole windows, or all).

    Each task adds a row without a place, whose ids are how many of its documents have each term.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        own = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        size = max(*own.tokenizer.get_vocab().values(), end_id) + 1
        narrow = "<u2" if size <= 1 << 16 else "<u4"
        context = TaskContext.get()
        place = (context.partitionId() if context else 0) << 32
        frequency = np.zeros(size, "<i8")
        id_type = None
        for part in parts:
            id_type = part.schema.types[0]
            tokens, windows, ids = [], [], []
            for found in own.encode([(text or b"").decode("utf-8", "replace") for text in utf8_list(part.column(1))]):
                made = np.append(found, np.uint32(end_id)).astype("<u4")
                frequency[counted(made)[0]] += 1
                rest = len(made) - len(made) % window
                tokens.append(len(made))
                windows.append([zlib.crc32(made[k : k + window].data) for k in range(0, rest, window)])
                ids.append(made[0 if whole else rest :].astype(narrow).tobytes())
            places = np.arange(place, place + len(ids))
            place += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(places), part.column(0), pa.array(tokens, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(ids, pa.binary())], ENCODED)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([frequency.tobytes()], pa.binary())], ENCODED)

    return docs.mapInArrow(run, f"place long, doc_id {kind}, doc_tokens long, windows array<long>, ids binary")


def _statistics(encoded: DataFrame, window: int) -> tuple[Statistics, int]:
    """The statistics of all documents, and how many ids are beyond whole windows."""

    def terms(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            for x in part.column(0).to_pylist():
                frequency = np.frombuffer(x, "<i8")
                term = np.flatnonzero(frequency)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(frequency[term])], ["term", "n"])

    total = encoded.where("place IS NOT NULL").agg(F.count("*"), F.sum("doc_tokens"), F.sum(F.col("doc_tokens") % window)).first()
    rows = encoded.where("place IS NULL").select("ids").mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(max((r.term for r in rows), default=0) + 1)
    for r in rows:
        frequency[r.term] = r.n
    return Statistics(total[0], (total[1] or 0) / max(total[0], 1), frequency), total[2] or 0


def _ids(data: bytes, count: int) -> np.ndarray:
    """Stored ids, of two or four bytes each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype("<u4")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    docs: doc_id, text. tokenizer: the path of a byte-level BPE file that every
    executor has. with_ids: each piece's token ids too. block: about how many
    tokens a shard has.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    encoded = written(_encoded(slim, tokenizer, window, end_id, with_ids), "packing")
    made, rest = _statistics(encoded, window)
    shards = max(1, -(-rest // block))
    least = made.n / shards / 3
    shared = spark.sparkContext.broadcast(made)

    def keyed(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            tokens, data = part.column(2).to_pylist(), part.column(4).to_pylist()
            keys = [shared.value.keys(_ids(x, n if with_ids else n % window)[n - n % window if with_ids else 0 :], least) for n, x in zip(tokens, data, strict=True)]
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(KEYS)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*ENCODED, *names])

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence_id = (context.partitionId() if context else 0) << 32
        # of each document: id, tokens, checksums of whole windows, all ids (with_ids), and the ids beyond whole windows
        doc_ids: list = []
        tokens: list[int] = []
        windows: list[list[int]] = []
        full: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator:
            nonlocal sequence_id, held
            doc, start, length, crc, seq, offset = [], [], [], [], [], []
            for d, checks in enumerate(windows):
                for k, check in enumerate(checks):
                    doc.append(d), start.append(k * window), length.append(window), seq.append(sequence_id), offset.append(0), crc.append(check)
                    sequence_id += 1
            for pieces in pack_block([len(x) for x in ids], ids, window, shared.value):
                at = 0
                for d, s, n in pieces:
                    doc.append(d), start.append(tokens[d] - len(ids[d]) + s), length.append(n), seq.append(sequence_id), offset.append(at)
                    crc.append(zlib.crc32(ids[d][s : s + n].data))
                    at += n
                sequence_id += 1
            which = pa.array(doc, pa.int64())
            columns = [pa.array(doc_ids, id_type).take(which), start, length, crc, pa.array(tokens, pa.int64()).take(which), seq, offset]
            if with_ids:
                columns.append(pa.array([full[d][s : s + n].astype(np.int64) for d, s, n in zip(doc, start, length, strict=True)], pa.list_(pa.int64())))
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            for held_rows in (doc_ids, tokens, windows, full, ids):
                held_rows.clear()
            held = 0
            yield from pa.Table.from_arrays(columns, names=[*NAMES, "ids"][: len(columns)]).to_batches(20_000)

        id_type = None
        for part in parts:
            id_type = part.schema.types[1]
            for key, n, checks, data in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                stored = _ids(data, n if with_ids else n % window)
                doc_ids.append(key), tokens.append(n), windows.append(checks)
                full.append(stored if with_ids else stored[:0]), ids.append(stored[len(stored) - n % window :])
                held += n if with_ids else n % window
                if held >= 2 * block:  # a shard much larger than planned
                    yield from flush()
        if ids:
            yield from flush()

    names = [f"key{i}" for i in range(KEYS)]
    order = [*names, "place"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = encoded.where("place IS NOT NULL").mapInArrow(keyed, f"place long, doc_id {kind}, doc_tokens long, windows array<long>, ids binary, " + ", ".join(f"{k} int" for k in names))
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))


ENCODED = ["place", "doc_id", "doc_tokens", "windows", "ids"]
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
