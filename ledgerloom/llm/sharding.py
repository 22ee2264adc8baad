"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that stays in one shard. The driver only sees how many
groups there are of each size (at most sqrt(2 * bytes) different sizes, far
fewer in practice) and packs them by best-fit-decreasing, exactly as if every
group were an item of its own: among equal items the tightest bin takes as many
as it holds, so a size is placed in runs. Groups then find their run by their
rank among the groups of their size; texts never move.

Defined results: a null text counts as an empty one (size 1, checksum 0, in
one group with empty texts); repeated rows each get a slot; null ids are kept;
extra columns are ignored; an empty table gives an empty result. Ties in the
slots' order only occur between rows that agree in id, size and checksum. A group
larger than a shard's even share makes the shards as uneven as it must; one
larger than a given ``capacity`` is refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import need, written

#: Groups that a task numbers at once, ranks that a run is looked up by, and groups of copies that are broadcast at most.
CHUNK, BLOCK, HEAVY = 800_000, 1024, 2048


class _Node:
    __slots__ = ("key", "left", "rank", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.rank, self.left, self.right = key, hash((key, 0x5BD1E995)) & 0xFFFFFFFF, None, None


class Tree:
    """A treap of (remaining capacity, bin): insert, and take the least key not below a bound."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, _Node(key)), high)

    def take_least(self, bound: tuple[int, int]) -> tuple[int, int] | None:
        low, high = self._split(self.root, bound)
        found = high
        while found is not None and found.left is not None:
            found = found.left
        if found is not None:
            _, high = self._split(high, (found.key[0], found.key[1] + 1))
        self.root = self._join(low, high)
        return found and found.key


def best_fit_decreasing(sizes: Sequence[tuple[int, int]], capacity: int, most: float = math.inf) -> list[tuple[int, int, int, int, int]] | None:
    """Bins of (size, how many items): largest first, each item into the fullest bin that still has room, else a new one.

    Returns runs (size, first item, end, first bin, items a bin), items of a size
    counted from 0; None if more than ``most`` bins are needed.
    """
    if sizes and max(sizes)[0] > capacity:
        raise ValueError("a group exceeds the capacity")
    tree, bins, out = Tree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            found = tree.take_least((size, -1))
            if found is None:
                break
            room, b = found
            n = min(count - at, room // size)
            out.append((size, at, at + n, b, n))
            at += n
            tree.insert((room - n * size, b))
        if at < count:
            each = capacity // size
            new = -(-(count - at) // each)
            if bins + new > most:
                return None
            out.append((size, at, count, bins, each))
            for i in range(new):
                tree.insert((capacity - size * min(each, count - at - i * each), bins + i))
            bins += new
    return out


def fewest_bytes(sizes: Sequence[tuple[int, int]], shards: int) -> tuple[int, list]:
    """The least capacity (by bisection, to one part in 2**16) at which best-fit-decreasing needs at most ``shards`` bins, and its runs."""
    if not sizes:
        return 0, []
    low = max(max(sizes)[0], -(-sum(s * n for s, n in sizes) // shards))
    fits = lambda c: best_fit_decreasing(sizes, c, shards)
    if found := fits(low):
        return low, found
    step = max(1, low >> 14)
    high = low + step
    while not (found := fits(high)):
        low, step = high, 2 * step
        high = low + step
    while high - low > max(1, high >> 16):
        middle = (low + high) // 2
        if better := fits(middle):
            high, found = middle, better
        else:
            low = middle
    return high, found


def shard_documents(docs: DataFrame, shards: int = 8, capacity: int | None = None) -> DataFrame:
    """Puts each row of docs (doc_id, text) into a shard; equal texts share one.

    With ``capacity`` (bytes) the number of shards is the fewest that
    best-fit-decreasing finds; else the shards are ``shards`` of the least
    capacity. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = written(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("of_text"),
        ),
        "shard-sizes",
    )
    groups = written(slim.groupBy("of_text").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "shard-groups")
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    runs = best_fit_decreasing(sizes, capacity) if capacity else fewest_bytes(sizes, shards)[1]
    # A group's rank among those of its size: by a hashed chunk, then within it.
    chunk = F.pmod(F.xxhash64("of_text", F.lit(5)), F.lit(max(16, sum(n for _, n in sizes) // CHUNK)))
    groups = groups.withColumn("chunk", chunk)
    so_far = Window.partitionBy("bytes").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = groups.groupBy("bytes", "chunk").agg(F.count("*").alias("n")).select("bytes", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("bytes", "chunk").orderBy("of_text")) - 1
    ranked = groups.join(ahead, ["bytes", "chunk"]).withColumn("rank", rank).withColumn("block", F.floor(F.col("rank") / BLOCK))
    of_run = spark.createDataFrame(runs, "bytes long, start long, end long, bin long, each long")
    of_run = of_run.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    of_group = ranked.join(of_run, ["bytes", "block"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    of_group = of_group.select("of_text", "copies", (F.col("bin") + F.floor((F.col("rank") - F.col("start")) / F.col("each"))).cast("int").alias("shard"))
    of_group = written(of_group, "shard-of-group")
    # Groups of many copies (fewer than HEAVY) are broadcast, so no key of the join below has more rows than one in HEAVY.
    hot = F.broadcast(of_group.where(F.col("copies") > rows // HEAVY).select("of_text", F.col("shard").alias("hot_shard")))
    marked = slim.join(hot, "of_text", "left")
    cold = marked.where("hot_shard IS NULL").drop("hot_shard").join(of_group.where(F.col("copies") <= rows // HEAVY).select("of_text", "shard"), "of_text")
    placed = cold.unionByName(marked.where("hot_shard IS NOT NULL").withColumnRenamed("hot_shard", "shard"))
    # Slots: rows are numbered in chunks by a hash of the id, each from where the chunks before end.
    chunks = max(16, min(1 << 16, rows // CHUNK))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(11)), F.lit(chunks)).cast("int").alias("chunk"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(at) - 1)
        .join(F.broadcast(starts), ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
