"""Near-duplicate embeddings by an inverted multi-index.

Vectors are normalised and cut into halves; each half has a codebook of its own
(k-means on a bounded sample), so the pairs of codewords form a grid of cells.
Every vector is in one cell and visits the cells nearest to it in multi-
sequence order (by the sum of the two halves' squared distances), as many as
the sample says are needed for the target recall of neighbours at the
threshold. Visitors and residents of a cell are compared by cosine in double
precision, in blocks within a task, and only counts and a spanning forest of
the links leave the task.

Equal vectors are one class, named by a 64-bit hash of the vector, and travel
once, in single precision where that holds them exactly (cosines are in double
precision always). Cells with many residents or visitors are cut into blocks of
BLOCK, every pair of which meets once. Lengths with few vectors have one cell:
those are compared without an index.

Defined results: vectors that are null, zero, or hold null or non-finite
components have no links; every other row is a vector of its own, whatever its
id, so repeated rows link with each other (cosine 1), also under one id and
under null ids; vectors of different lengths never link; component_id is the
least id that isn't null (null if there is none), kept says whether that is the
row's id (null counting as null's equal); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, need, written
from ledgerloom.llm.components import connected_components

BLOCK = 1024
#: Vectors a cell (about), and vectors that fit the codebooks of one length at most; a codeword has at least four of those.
RESIDENTS, SAMPLE = 200, 16_000
#: Vectors from which a length has an index, and lengths that have one at most; others are compared in blocks.
INDEXED, MOST_INDEXES = 4096, 100
#: Cells of several blocks that are broadcast at most.
BROADCAST_CELLS = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of Lloyd's algorithm from seeded rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def multi_sequence(first: np.ndarray, second: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The ``most`` pairs (i, j) with the least first[i] + second[j], in order, by a heap over both sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for y in ((i + 1, j), (i, j + 1)):
            if y[0] < len(a) and y[1] < len(b) and y not in seen:
                seen.add(y)
                heapq.heappush(heap, (first[a[y[0]]] + second[b[y[1]]], *y))
    return out


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and how many cells a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return tuple((c * c).sum(1) - 2 * y @ c.T for c, y in ((self.first, x[:, :half]), (self.second, x[:, half:])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector, and of the visited cells after it."""
        d1, d2 = self.distances(x)
        k = len(self.second)
        return np.array([[i * k + j for i, j in multi_sequence(a, b, self.visits)] for a, b in zip(d1, d2, strict=True)], np.int32).reshape(len(x), -1)


def stored_vectors(column) -> tuple[list[bytes | None], list[int]]:
    """The usable vectors of an Arrow list column as bytes (of floats where those are exact, else of doubles), and their lengths; null for others."""
    out, dims = [], []
    for v in column:
        v, x = v.values, None
        if v is not None and len(v) and not v.null_count:
            x = v.to_numpy(zero_copy_only=False).astype("<f8")
        if x is None or not np.isfinite(x).all() or not x.any():
            out.append(None), dims.append(0)
            continue
        with np.errstate(over="ignore"):
            short = x.astype("<f4")
        out.append((short if (short == x).all() else x).tobytes()), dims.append(len(x))
    return out, dims


def unit_vectors(raw: Sequence[bytes], dim: int) -> np.ndarray:
    """Stored vectors at length 1, in double precision."""
    x = np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in raw]).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_index(sample: np.ndarray, codewords: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks on the sample; visits: so many that a neighbour whose cosine is drawn evenly from threshold..1 lies in a visited cell with chance ``recall``."""
    half = sample.shape[1] // 2
    index = MultiIndex(kmeans(sample[:, :half], codewords), kmeans(sample[:, half:], codewords), 1)
    rng = np.random.default_rng(11)
    x = sample[rng.choice(len(sample), min(1000, len(sample)), replace=False)]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True).clip(1e-12)
    cosine = rng.uniform(threshold, 1, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    (a1, a2), (b1, b2) = index.distances(x), index.distances(y)
    rank = np.zeros(len(x), np.int64)
    for i in range(len(x)):
        grid = a1[i][:, None] + a2[i]
        rank[i] = (grid < grid[b1[i].argmin(), b2[i].argmin()]).sum() + 1
    index.visits = int(np.quantile(rank, recall, method="higher"))
    return index


def _found_in(block: list[tuple], threshold: float) -> tuple[dict, list]:
    """Link counts by class, and a spanning forest of the links, between residents and visitors of one block.

    Rows: dim, cell, block, visits, class, copies, home, raw, route.
    """
    residents = [r for r in block if not r[3]]
    visitors = [r for r in block if r[3]]
    if not residents or not visitors:
        return {}, []
    a, b = (unit_vectors([r[7] for r in rows], block[0][0]) for rows in (residents, visitors))
    ids_a, ids_b = np.array([r[4] for r in residents]), np.array([r[4] for r in visitors])
    n_a, n_b = np.array([r[5] for r in residents]), np.array([r[5] for r in visitors])
    near = (a @ b.T >= threshold) & (ids_a[:, None] != ids_b)
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return {}, []
    # A visitor counts every resident. A resident counts a visitor only if it doesn't itself visit that one's cell.
    homes, home_of = np.unique([r[6] for r in visitors], return_inverse=True)
    goes = np.stack([np.isin(homes, np.frombuffer(residents[x][8], np.int32)) for x in rows])
    by_visitor = n_a @ near
    by_resident = (near[rows] & ~goes[:, home_of]) @ n_b
    counts: dict[int, int] = {}
    for ids, n in ((ids_b, by_visitor), (ids_a[rows], by_resident)):
        for i in np.flatnonzero(n):
            counts[int(ids[i])] = counts.get(int(ids[i]), 0) + int(n[i])
    # Trees: each resident joins the trees of the visitors it links.
    edges, tree = [], -1 - np.arange(len(visitors))
    for x in rows:
        own = np.flatnonzero(near[x])
        roots, first = np.unique(tree[own], return_index=True)
        edges += [(int(ids_a[x]), int(ids_b[own[f]])) for f in first]
        tree[np.isin(tree, roots)] = roots[0]
    return counts, edges


def codewords_for(rows: int, sample: int = SAMPLE) -> int:
    """Codewords of a half: a power of two, for about RESIDENTS vectors a cell of the grid; at most one for four vectors of the sample."""
    words = 8
    while 8 * words <= sample and (2 * words) ** 2 * RESIDENTS <= 2 * rows:
        words *= 2
    return words


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.9, codewords: int | None = None, recall: float = 0.97, sample: int = SAMPLE, indexed: int = INDEXED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    ``sample``: at most so many vectors of a length (by their hash) fit its
    codebooks; every vector is indexed and queries the index. ``codewords`` of a
    half follow the number of vectors if not given. ``indexed``: lengths with
    fewer vectors are compared without an index.
    """
    need(vectors, "vec_id", "embedding")

    def stored(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            raw, dims = stored_vectors(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "raw", "dim"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(stored, "vec_id long, raw binary, dim int")
    rows = written(rows.withColumn("class", F.when(F.col("raw").isNotNull(), F.xxhash64("raw", "dim"))), "units")
    classes = rows.where("class IS NOT NULL").groupBy("class", "dim", "raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes, "vector-classes")
    lengths = classes.groupBy("dim").count().where(F.col("count") >= indexed).orderBy(F.desc("count"), "dim").limit(MOST_INDEXES).collect()
    indexes = {}
    for dim, n in lengths:
        some = classes.where(F.col("dim") == dim).orderBy("class").select("raw").limit(sample).collect()
        if dim > 1:
            indexes[dim] = fit_index(unit_vectors([r["raw"] for r in some], dim), codewords or codewords_for(n, sample), threshold, recall)
    found = written(_links_of(classes, indexes, threshold), "vector-links")
    counts = found.where("other IS NULL").groupBy("class").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("other IS NOT NULL").select("class", "other"))
    named = classes.join(counts, "class", "left").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "n_links", "component_id")
    named = written(named, "vector-names")
    forget(found, classes)
    # Unusable vectors have no class, and components of their own.
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _links_of(classes: DataFrame, indexes: dict[int, MultiIndex], threshold: float) -> DataFrame:
    """Rows (class, n, null): links counted; and (class, null, other): links of a spanning forest. indexes: by the vectors' length."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def route(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            raw, dims = part.column(3).to_pylist(), part.column(1).to_numpy()
            cells: list = [np.zeros(1, np.int32)] * len(raw)
            for dim in np.unique(dims):
                if (index := shared.value.get(int(dim))) is not None:
                    own = np.flatnonzero(dims == dim)
                    for i, c in zip(own, index.cells(unit_vectors([raw[i] for i in own], int(dim))), strict=True):
                        cells[i] = c
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([c.tolist() for c in cells], pa.list_(pa.int32()))], ["class", "dim", "copies", "raw", "route", "cells"])

    routed = classes.select("class", "dim", "copies", "raw").mapInArrow(route, "class long, dim int, copies long, raw binary, route binary, cells array<int>")
    routed = written(routed, "routes")
    home = F.get("cells", F.lit(0))
    residents = routed.select("dim", home.alias("cell"), F.lit(False).alias("visits"), "class", "copies", home.alias("home"), "raw", "route")
    visitors = routed.select("dim", F.explode("cells").alias("cell"), F.lit(True).alias("visits"), "class", "copies", home.alias("home"), "raw", F.lit(b"").alias("route"))
    # Cells of more than one block: how many blocks of residents and of visitors.
    n_res = residents.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rs"))
    n_vis = visitors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("vs"))
    grid = written(n_res.join(n_vis, ["dim", "cell"]).where("rs > 1 OR vs > 1"), "blocks")
    if grid.count() <= BROADCAST_CELLS:
        grid = F.broadcast(grid)
    rs, vs = (F.coalesce(F.col(c), F.lit(1)) for c in ("rs", "vs"))
    both = residents.unionByName(visitors).join(grid, ["dim", "cell"], "left")
    at_r, at_v = F.pmod(F.xxhash64("class"), rs).cast("int"), F.pmod(F.xxhash64("class"), vs).cast("int")
    blocks = F.when(F.col("visits"), F.transform(F.sequence(F.lit(0), rs - 1), lambda r: r * vs + at_v)).otherwise(F.transform(F.sequence(F.lit(0), vs - 1), lambda v: at_r * vs + v))
    laid = both.select("dim", "cell", F.explode(blocks).alias("block"), "visits", "class", "copies", "home", "raw", "route")

    def meet(parts: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def flush() -> Iterator:
            counts, edges = _found_in(held, threshold)
            if counts:
                ids = [*counts, *(a for a, _ in edges)]
                n = [*counts.values(), *[None] * len(edges)]
                other = [*[None] * len(counts), *(b for _, b in edges)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["class", "n", "other"])

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from flush()
                    held.clear()
                held.append(row)
        if held:
            yield from flush()

    return laid.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block").mapInArrow(meet, "class long, n long, other long")


#: Brute force: what the index finds when it misses nothing.
ORACLE = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings), v AS (
  SELECT r, embedding::DOUBLE[] AS e FROM r
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT r AS x, r AS y FROM r UNION SELECT reach.x, l.y FROM reach JOIN links l ON l.x = reach.y
), labels AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN r ON r.r = y GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM r JOIN labels ON labels.x = r.r LEFT JOIN counts ON counts.x = r.r
"""
