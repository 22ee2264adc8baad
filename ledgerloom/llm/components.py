"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and an equi-join, so hubs
of any degree are fine; each round's edges are written to the shared folder.
After O(log n) rounds every node points at the least node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, written


def _checked(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def connected_components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, component: least node reachable) of every node that has an edge to another.

    edges: two long columns in any direction; repeats and loops do no harm,
    rows with a null are left out. ``rows``: about how many at most, if known.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(now.distinct(), "edges", rows)
    state = _checked(now)
    for _ in range(rounds):
        # Large star: every neighbour above u points at the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below point at the least of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(down.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges", rows)
        done = _checked(after)
        forget(now)
        now = after
        if done == state:
            break
        state = done
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
