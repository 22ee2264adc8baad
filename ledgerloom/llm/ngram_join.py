"""N-gram Jaccard self-join by vertical partitioning.

1. Documents become sets of hashed k-word shingles; equal sets are one class.
2. The global n-gram order (that of the hashes) is cut into fragments; sets that
   may be similar agree in several whole fragments (see fragments.py). A
   fragment's hash found in two classes or more is a bucket. Which hashes occur
   twice is found first, from four bytes of each.
3. Each bucket's members are compared with its two extreme members; what a
   parity sketch can't rule out is verified: partial overlaps are counted
   fragment by fragment, and summed per pair.
4. Buckets whose members already are one component are done. A set leaves out
   its largest others (passages that many texts share), as many as its size
   allows: fragments enough remain. In what is left all pairs of different
   components are held against the sketch, in blocks within a task. Tasks name
   the members that have a pair left, not the pairs.
5. The whole sets of those meet by the lowest member of their buckets, in blocks
   again: overlaps are counted within the task, and only links that join what
   isn't joined there yet leave it. So no link between different components is
   lost, and groups of near copies aren't expanded into pairs.

Texts never move. One pass hashes them and writes each class's sketch and
fragment hashes to the shared folder; steps 3 and 5 read them again, for the
documents that a bitmap of bounded size asks for. Scratch tables go as soon as
they are used up.
Sets are identified by 64-bit hashes (chance of two different sets among n
being taken for one: about n*n / 2**65).

Defined results: texts without a word (null, empty, white space) have 0
shingles and are a component of their own; texts of fewer than k words have
their whole sequence as one shingle; repeated rows give a row each; null ids
never are a component's id unless alone; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import fragments
from ledgerloom.llm import textkernel as K
from ledgerloom.llm.bitmap import Bitmap, bitmap_of
from ledgerloom.llm.common import ROWS_A_FILE, forget, need, release, small_batches, written
from ledgerloom.llm.components import connected_components

#: Fragments in which overlaps are counted.
PARTS = 8
#: Words at least of the shorter sketch that travels with each member of a bucket; the whole one is held against the pairs that it lets through.
FEW = 32
#: Members of a bucket that meet in one block.
BLOCK = 1024
#: N-grams of the sets that meet in one block, about.
GRAMS = 1 << 19
#: Rows of buckets of one lowest member that go to one task, about.
ROWS_A_TASK = 8192
#: Lowest members with more rows than that, which are broadcast, at most.
BROADCAST_ROWS = 1_000_000
#: Classes that a task remembers to have announced.
SEEN = 1 << 20
#: Fragment hashes that meet in one task when those found twice are looked for, about.
HASHES_A_PART = 1 << 20


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit identity of a set, as a signed long."""
    if not len(shingles):
        return 0
    total = K.mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(K.mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def sketch_of(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch: bit i is the parity of the n-grams hashed to i; the sketches of two sets differ in at most as many bits as the sets do in n-grams."""
    spot = K.mix(shingles ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(64 * words)
    odd = (np.bincount(spot.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def sketch_words(n: int) -> int:
    """64-bit words of the sketch of a set of n: four bits an n-gram, in powers of two (at most 8 KB)."""
    words = 4
    while 16 * words < n and words < 1024:
        words *= 2
    return words


def short_words(n: int) -> int:
    """64-bit words of the short sketch: FEW, or for large sets about a bit an n-gram."""
    words = FEW
    while 64 * words < n and words < 1024:
        words *= 2
    return words


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch brought to fewer words: parities of positions that agree modulo the smaller size."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def most_apart(a, b, p: int, q: int):
    """How many n-grams two linked sets of these sizes differ in at most."""
    return (q - p) * (a + b) // (q + p)


def _slices(part, rows: int = 512) -> Iterator:
    for at in range(0, part.num_rows, rows):
        yield part.slice(at, rows)


def document_classes(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """doc_id, key (of the id), n_shingles and class of each row; its class's sketch and fragment hashes (sigs) once a class and task, else empty."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for part in (x for whole in parts for x in _slices(whole)):
            n, cls, sketch, sigs, drops = [], [], [], [], []
            for s in K.shingle_sets(K.utf8_list(part.column(2)), k):
                n.append(len(s))
                drops.append(fragments.droppable(len(s), p, q) if len(s) else (0, 0))
                cls.append(c := class_of(s))
                new = len(s) and c not in seen
                sketch.append(sketch_of(s, sketch_words(len(s))).tobytes() if new else b"")
                sigs.append(fragments.signatures(s, p, q).tobytes() if new else b"")
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(c)
            columns = [pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(x, pa.binary()) for x in (sketch, sigs)), *(pa.array(x, pa.int32()) for x in zip(*drops, strict=True))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "key", "n_shingles", "class", "sketch", "sigs", "drop0", "drop1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, class long, sketch binary, sigs binary, drop0 int, drop1 int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id").alias("key"), F.col("text").cast("string").alias("text"))


def _places(sig: np.ndarray, parts: int) -> np.ndarray:
    """Where hashes are compared: the part (by the upper bits) in the upper half, four bytes of the hash in the lower one."""
    x = sig.view(np.uint64)
    return (((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))


def _repeated(rows: DataFrame, parts: int) -> DataFrame:
    """The _places() of fragment hashes that occur more than once (and few others): four bytes a hash are shuffled, a row a task and part."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def packed() -> Iterator:
            place = np.sort(_places(np.frombuffer(b"".join(held), np.int64), parts))
            low, part = place.astype("<u4"), (place >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            for at in range(0, len(cut), 256):
                own = cut[at : at + 257]
                ends = own[1:] if len(own) == 257 else np.append(own[1:], len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part[own[: len(ends)]]), pa.array([low[i:j].tobytes() for i, j in zip(own, ends, strict=False)], pa.binary())], ["part", "low"])

        held, size = [], 0
        for batch in batches:
            held += batch.column(0).to_pylist()
            size += batch.column(0).nbytes
            if size > 1 << 23:
                yield from packed()
                held.clear()
                size = 0
        yield from packed()

    def repeated(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for part, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(low)
        for part, lows in held.items():
            low = np.sort(np.frombuffer(b"".join(lows), "<u4"))
            lows.clear()
            found = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64) | part << 32
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 50_000])], ["place"])

    packed = rows.where(F.octet_length("sigs") > 0).select("sigs").mapInArrow(pack, "part long, low binary")
    return packed.repartition(parts, "part").mapInArrow(repeated, "place long")


def _fragment_rows(rows: DataFrame, wanted: Bitmap, places: int) -> DataFrame:
    """(sig, class): the fragments' hashes of each class whose place ``wanted`` may have."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in (x for whole in parts for x in _slices(whole, 1000)):
            raw = part.column(0).to_pylist()
            sig = np.frombuffer(b"".join(raw), np.int64)
            cls = np.repeat(part.column(1).to_numpy(), [len(x) // 8 for x in raw])
            keep = shared.value.has(_places(sig, places))
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(cls[keep])], ["sig", "class"])

    return rows.where(F.octet_length("sigs") > 0).select("sigs", "class").mapInArrow(run, "sig long, class long")


def _sets_of(docs: DataFrame, classes: DataFrame, asked: DataFrame, rows: int, k: int, parts: int) -> DataFrame:
    """(class, part, grams) of the classes in ``asked``, written: their sorted n-grams, cut into ``parts`` (a power of two) by value.

    classes: class, key (of one of its documents). rows: about how many documents there are.
    """
    asked = written(asked.join(classes.select("class", "key"), "class"), "asked", rows)
    count = asked.count()
    wanted = docs.sparkSession.sparkContext.broadcast((bitmap_of(asked.select("key"), count), bitmap_of(asked.select("class"), count)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, sets = wanted.value
        edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length())
        seen: set[int] = set()
        for part in (x for whole in batches for x in _slices(whole)):
            part = part.filter(pa.array(keys.has(part.column(1).to_numpy())))
            cls, piece, grams = [], [], []
            for s in K.shingle_sets(K.utf8_list(part.column(2)), k):
                c = class_of(s)
                if not len(s) or c in seen or not sets.has(np.array([c]))[0]:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(c)
                for i, own in enumerate(np.split(s, np.searchsorted(s, edges))):
                    if len(own):
                        cls.append(c), piece.append(i), grams.append(own.view(np.int64))
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(piece, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["class", "part", "grams"])

    pieces = _keyed(docs).mapInArrow(run, "class long, part int, grams array<long>")
    pieces = written(pieces.dropDuplicates(["class", "part"]), "pieces", count)
    forget(asked)
    release(docs.sparkSession)
    return pieces


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, rows: int, k: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b: classes, a < b, with sizes na and nb) that are linked, written: partial overlaps by fragment, summed per pair."""
    pairs = written(pairs, "pairs", rows)
    pieces = _sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), rows, k, PARTS)
    by_part = pairs.join(pieces.select(F.col("class").alias("a"), "part", F.col("grams").alias("grams_a")), "a")
    by_part = by_part.join(pieces.select(F.col("class").alias("b"), "part", F.col("grams").alias("grams_b")), ["b", "part"])
    partial = by_part.select("a", "b", "na", "nb", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("shared"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    linked = written(total.where(F.col("shared") * q >= (F.col("na") + F.col("nb") - F.col("shared")) * p).select("a", "b"), "links", rows)
    forget(pairs, pieces)
    release(docs.sparkSession)
    return linked


def _near(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) that sizes and sketches don't rule out, without the sketches."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            na, nb = (part.column(i).to_numpy() for i in (2, 3))
            keep = np.minimum(na, nb) * q >= np.maximum(na, nb) * p
            sa, sb = part.column(4), part.column(5)
            for i in np.flatnonzero(keep):
                keep[i] = _apart(np.frombuffer(sa[i].as_py(), np.uint64), np.frombuffer(sb[i].as_py(), np.uint64)) <= most_apart(int(na[i]), int(nb[i]), p, q)
            yield part.filter(_mask(keep)).select(["a", "b", "na", "nb"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na long, nb long")


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep)


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def _small_pairs(m: int, rows: np.ndarray, sig, comp, n, four, p: int, q: int) -> np.ndarray:
    """Index pairs within buckets of m members each (rows: first row of each) that sizes and folded sketches don't rule out."""
    i, j = np.triu_indices(m, 1)
    left, right = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
    for keep in (
        lambda: comp[left] != comp[right],
        lambda: np.minimum(n[left], n[right]) * q >= np.maximum(n[left], n[right]) * p,
        lambda: fragments.meets_here(sig[left], n[left], n[right], p, q),
        lambda: np.bitwise_count(four[left] ^ four[right]).sum(1) <= most_apart(n[left], n[right], p, q),
    ):
        ok = keep()
        left, right = left[ok], right[ok]
    return np.stack([left, right], 1)


def _large_pairs(rows: np.ndarray, sig, side, cls, comp, n, sketch: list, p: int, q: int) -> np.ndarray:
    """The same within one block of many members, by products of their sketches."""
    words = min(len(sketch[r]) for r in rows) // 8
    bits = np.stack([np.unpackbits(folded(np.frombuffer(sketch[r], np.uint64), words).view(np.uint8)) for r in rows]).astype(np.float32) * 2 - 1
    left, right = np.flatnonzero(side[rows] != 1), np.flatnonzero(side[rows] != 0)
    out = []
    for at in range(0, len(left), 128):
        l, r = left[at : at + 128], rows[right]  # noqa: E741
        nl = n[rows[l]][:, None]
        apart = (bits.shape[1] - bits[l] @ bits[right].T) / 2
        ok = (apart <= most_apart(nl, n[r], p, q)) & (np.minimum(nl, n[r]) * q >= np.maximum(nl, n[r]) * p) & (comp[rows[l]][:, None] != comp[r])
        ok &= fragments.meets_here(sig[rows[0]], nl, n[r], p, q)
        if side[rows[0]] == 2:
            ok &= cls[rows[l]][:, None] < cls[r]
        i, j = np.nonzero(ok)
        out.append(np.stack([rows[l[i]], r[j]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _blocks(members: DataFrame, p: int, q: int) -> DataFrame:
    """Members (low, class, component, n) that form a pair of different components within some (sig, block) which sizes and sketches don't rule out.

    Both members of a pair come with the same low. A task names a member once
    a low, however many pairs it is in.

    members: sig, low, block, side (0 meets 1; 2 meets its like), class, component,
    n, sketch, salts. Near copies share many buckets, most with the same lowest
    member: those go to one task, or to as many as ``salts`` says.
    """

    def members_of(numbers: np.ndarray, sketch: list) -> np.ndarray:
        cut = np.flatnonzero(np.concatenate(([True], (numbers[1:, :2] != numbers[:-1, :2]).any(1))))
        sizes = np.diff(np.append(cut, len(numbers)))
        side, cls, comp, n = numbers[:, 2], numbers[:, 3], numbers[:, 4], numbers[:, 5]
        four = np.stack([folded(np.frombuffer(x, np.uint64), 4) for x in sketch])
        found = [np.zeros((0, 2), np.int64)]
        small = (sizes <= 16) & (side[cut] == 2)
        for m in np.unique(sizes[small]):
            if m > 1:
                for at in range(0, int((own := cut[small & (sizes == m)]).size), 4096):
                    found.append(_small_pairs(int(m), own[at : at + 4096], numbers[:, 0], comp, n, four, p, q))
        for first, m in zip(cut[~small], sizes[~small], strict=True):
            found.append(_large_pairs(np.arange(first, first + m), numbers[:, 0], side, cls, comp, n, sketch, p, q))
        ij = np.concatenate(found)
        if not len(ij):
            return np.zeros((0, 4), np.int64)
        a, b = cls[ij[:, 0]], cls[ij[:, 1]]
        ij[a > b] = ij[a > b][:, ::-1]
        i, j = ij[np.unique(np.stack([cls[ij[:, 0]], cls[ij[:, 1]]], 1), axis=0, return_index=True)[1]].T
        near = np.array([_apart(np.frombuffer(sketch[x], np.uint64), np.frombuffer(sketch[y], np.uint64)) <= most_apart(int(n[x]), int(n[y]), p, q) for x, y in zip(i, j, strict=True)], bool)
        return np.unique(numbers[np.concatenate([i[near], j[near]])][:, [6, 3, 4, 5]], axis=0)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        held, sketches = np.zeros((0, 7), np.int64), []

        met: set[tuple[int, ...]] = set()

        def named() -> Iterator:
            if met:
                a = np.array(list(met), np.int64)
                met.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a[:, j].copy()) for j in range(4)], ["low", "class", "component", "n"])

        def batch(numbers: np.ndarray, sketch: list) -> Iterator:
            if len(numbers) > 1:
                met.update(map(tuple, members_of(numbers, sketch).tolist()))
                if len(met) > 200_000:
                    yield from named()

        for part in parts:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in part.columns[:7]], 1)])
            sketches += part.column(7).to_pylist()
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(1))  # the last bucket may go on
            done = int(last[-1]) + 1 if len(last) else 0
            yield from batch(held[:done], sketches[:done])
            held, sketches = held[done:], sketches[done:]
        yield from batch(held, sketches)
        yield from named()

    salted = members.withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")))
    sorted_rows = salted.repartition("low", "salt", "block").sortWithinPartitions("low", "salt", "sig", "block")
    return sorted_rows.select("sig", "block", "side", "class", "component", "n", "low", "sketch").mapInArrow(run, "low long, class long, component long, n long")


def _joining(side: np.ndarray, comp: np.ndarray, sets: list, p: int, q: int) -> list[tuple[int, int]]:
    """Index pairs of linked sets that join all components which links within one block join: fewer than there are sets."""
    comp, n = comp.copy(), np.array([len(s) for s in sets])
    words = np.array([sketch_words(x) for x in n])
    sketch = [sketch_of(s, w) for s, w in zip(sets, words, strict=True)]
    out = []
    for w in np.unique(words):
        left = np.flatnonzero(words == w)
        right = np.flatnonzero((words >= w) & (n * p <= n[left].max() * q))
        bits = np.stack([np.unpackbits(folded(sketch[r], w).view(np.uint8)) for r in right]).astype(np.float32) * 2 - 1
        for at in range(0, len(left), 128):
            l = left[at : at + 128]  # noqa: E741
            nl, nr = n[l][:, None], n[right]
            apart = (bits.shape[1] - bits[np.searchsorted(right, l)] @ bits.T) / 2
            ok = (apart <= most_apart(nl, nr, p, q)) & (np.minimum(nl, nr) * q >= np.maximum(nl, nr) * p) & (comp[l][:, None] != comp[right])
            ok &= ((side[l] == 2)[:, None] | (side[l][:, None] != side[right])) & ((words[right] > w) | (l[:, None] < right))
            i, j = np.nonzero(ok)
            for x, y in zip(l[i].tolist(), right[j].tolist(), strict=True):
                if comp[x] != comp[y] and fragments.linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]), p, q):
                    comp[comp == comp[y]] = comp[x]
                    out.append((x, y))
    return out


def _block_links(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) that join all components which links within each (low, block) join.

    rows: low, block, side (0 meets 1; 2 meets its like), class, component, grams.
    """

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        held, sets = np.zeros((0, 5), np.int64), []

        def block(numbers: np.ndarray, own: list) -> Iterator:
            ij = np.array(_joining(numbers[:, 2], numbers[:, 4], own, p, q), np.int64).reshape(-1, 2) if len(own) > 1 else ()
            if len(ij):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[ij[:, 0], 3]), pa.array(numbers[ij[:, 1], 3])], ["a", "b"])

        for part in (x for whole in parts for x in _slices(whole)):
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in part.columns[:5]], 1)])
            sets += [x.values.to_numpy().view(np.uint64) for x in part.column(5)]
            cut = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1  # the last block may go on
            for start, end in zip([0, *cut[:-1]], cut, strict=False):
                yield from block(held[start:end], sets[start:end])
            if len(cut):
                held, sets = held[cut[-1] :], sets[cut[-1] :]
        yield from block(held, sets)

    return rows.repartition("low", "block").sortWithinPartitions("low", "block").select("low", "block", "side", "class", "component", "grams").mapInArrow(run, "a long, b long")


def _meetings(spread: DataFrame, *columns: str) -> DataFrame:
    """The columns of each row with block and side, once a block in which it meets others: classes are dealt to ``blocks``, and each pair of those meets once.

    Two classes of one bucket (or low) meet in one block: at side 2, or at 0 and 1.
    """
    dealt = spread.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            (F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own"))).alias("block"),
            F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1).alias("side"),
        ),
    )
    return dealt.select(*columns, F.explode(meet).alias("at")).select(*columns, "at.block", "at.side")


def link_classes(docs: DataFrame, hashed: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(node, component) of the classes that have links; hashed: document_classes(docs), written (and deleted here)."""
    spark = docs.sparkSession
    n_docs, hashes = hashed.agg(F.count("*"), F.sum(F.octet_length("sigs") / 8)).first()
    parts = max(16, int(hashes or 0) // HASHES_A_PART)
    twice = written(_repeated(hashed, parts), "twice", int(hashes or 0) // 8)
    wanted = bitmap_of(twice, twice.count())
    forget(twice)
    release(spark)
    # One row a class: of those with a sketch, any (they are alike).
    told = hashed.where(F.octet_length("sketch") > 0)
    classes = told.groupBy("class").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.max("drop0").alias("drop0"), F.max("drop1").alias("drop1"), F.min("key").alias("key"))
    classes = written(_with_short(classes), "sets", n_docs)
    found = written(_fragment_rows(hashed, wanted, parts), "found", 32 * n_docs)
    forget(hashed)
    buckets = found.groupBy("sig").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    rows = written(found.join(buckets, "sig").distinct(), "members", 32 * n_docs)
    forget(found)
    release(spark)

    def held(pairs: DataFrame, sketch: str, sizes: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sketches in a column of ``sizes`` don't rule out."""
        size = sizes.select(F.col("class").alias("of"), "n", F.col(sketch).alias("s"))
        one = pairs.select("a", "b").join(size.select(F.col("of").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        return _near(one.join(size.select(F.col("of").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b"), p, q)

    def near(pairs: DataFrame) -> DataFrame:
        """By the short sketches first; sets that are too large for those by their whole ones."""
        left = written(held(pairs, "short", classes), "near", n_docs)
        scratch.append(left)
        release(spark)
        few = F.least("na", "nb") <= 16 * FEW
        return left.where(few).unionByName(held(left.where(~few), "sketch", classes.where(F.col("n") > 16 * FEW)))

    scratch: list[DataFrame] = []
    ends = F.array(F.struct(F.col("low").alias("a"), F.col("class").alias("b")), F.struct(F.col("class").alias("a"), F.col("high").alias("b")))
    star = rows.select(F.explode(ends).alias("e")).select("e.*").where("a < b").distinct()
    links = verified(docs, classes, near(star), n_docs, k, p, q)
    first = connected_components(links, n_docs)

    # Buckets that hold different components: every pair of them that is left is looked at.
    placed = rows.join(first.withColumnRenamed("node", "class"), "class", "left").select("sig", "low", "class", F.coalesce("component", "class").alias("component"))
    open_ = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("sig", "m")
    members = placed.join(open_, "sig").join(classes.select("class", "n", F.col("short").alias("sketch"), "drop0", "drop1"), "class")
    # Each set disregards its largest buckets of a level, as many as leave fragments enough.
    level = F.col("sig").bitwiseAND(1)
    hottest = Window.partitionBy("class", level).orderBy(F.desc("m"), "sig")
    members = members.withColumn("rank", F.row_number().over(hottest)).where(F.col("rank") > F.when(level == 0, F.col("drop0")).otherwise(F.col("drop1")))
    members = written(members.select("sig", "low", "class", "component", "n", "sketch", "m"), "open", 8 * n_docs)
    release(spark)
    # A bucket of more than BLOCK members is cut into blocks, and each pair of blocks meets once.
    salts = written(members.groupBy("low").agg(F.ceil(F.count("*") / ROWS_A_TASK).alias("more")).where("more > 1"), "salts", n_docs)
    if salts.count() <= BROADCAST_ROWS:
        salts = F.broadcast(salts)
    spread = members.join(salts, "low", "left").withColumn("salts", F.coalesce("more", F.lit(1))).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    laid = _meetings(spread, "sig", "low", "salts", "class", "component", "n", "sketch")
    named = written(_blocks(laid, p, q).distinct(), "named", 4 * n_docs)
    forget(members, rows, first)
    release(spark)
    # The whole sets of the members named meet by their lowest member, in blocks that a task can hold.
    whole = _sets_of(docs, classes, named.select("class").distinct(), n_docs, k, 1)
    cuts = named.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GRAMS)).cast("int").alias("blocks"))
    found = _meetings(named.join(cuts, "low"), "low", "class", "component").join(whole.select("class", "grams"), "class")
    found = written(_block_links(found, p, q), "joins", n_docs)
    forget(named, whole)
    release(spark)
    out = connected_components(links.unionByName(found), n_docs)
    forget(links, found, classes, *scratch)
    return out


def _with_short(classes: DataFrame) -> DataFrame:
    """The classes with their short sketches."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in (x for whole in parts for x in _slices(whole)):
            n, whole = part.column("n").to_pylist(), part.column("sketch").to_pylist()
            short = [folded(np.frombuffer(x, np.uint64), min(short_words(m), len(x) // 8)).tobytes() for m, x in zip(n, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(short, pa.binary())], [*part.schema.names, "short"])

    return classes.mapInArrow(run, "class long, n long, sketch binary, drop0 int, drop1 int, key long, short binary")


def jaccard_components(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Documents link when q * |intersection| >= p * |union| of their k-word
    shingles; component_id is the least doc_id reachable by links.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    hashed = written(document_classes(docs, k, p, q), "hashed")
    rows = written(hashed.select("doc_id", "n_shingles", "class"), "classes")
    some = rows.where("n_shingles > 0")
    joined = link_classes(docs, hashed, k, p, q).select(F.col("node").alias("class"), "component")
    placed = some.select("doc_id", "n_shingles", "class").join(joined, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.coalesce(max(6, rows.count() // ROWS_A_FILE))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * shared >= 85 * (sx.n + sy.n - shared)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
