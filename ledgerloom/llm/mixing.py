"""Mixing sources to target weights as a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). Each pattern offers its words once at no cost, a second time at cost 1, a
third at 2 and so on (convex, so repetition spreads evenly); the flow routes
them to the sources' quotas. As costs only lie on a pattern's copies, the flow is
cheapest if each further round of copies is only opened once no more of the
cheaper ones can be routed: every round is a maximum flow by blocking flows, so
sources that don't overlap cost time in proportion to their number. Within a pattern, documents come in the order of a
seeded hash of the id: all get the whole copies, the first ones one more, and
the document at the boundary the words that are left (a part of a copy), so
that the quota is met exactly.

Defined results: a null text has no words; null sources are a source of their
own, last in order; repeated rows each count; rows without a word take 0; an
empty table gives an empty result; extra columns are ignored. The driver
holds a row a pattern (never a document): a table of more than ``most_patterns``
different sets of sources is refused.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import need, written

#: Membership patterns on the driver at most, and up to how many are broadcast.
MOST_PATTERNS, BROADCAST_PATTERNS = 1_000_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


class Flow:
    """Maximum flow by blocking flows over shortest paths; more room may be opened between runs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.room.append(r)
        return len(self.to) - 2

    def _distances(self, source: int) -> list[int]:
        far, line = [-1] * len(self.out), [source]
        far[source] = 0
        for x in line:
            for e in self.out[x]:
                if self.room[e] > 0 and far[self.to[e]] < 0:
                    far[self.to[e]] = far[x] + 1
                    line.append(self.to[e])
        return far

    def run(self, source: int, sink: int) -> None:
        """Sends as much more as fits."""
        while (far := self._distances(source))[sink] >= 0:
            tried, path, x = [0] * len(self.out), [], source
            while True:
                if x == sink:
                    most = min(self.room[e] for e in path)
                    for i in range(len(path) - 1, -1, -1):
                        self.room[path[i]] -= most
                        self.room[path[i] ^ 1] += most
                        if not self.room[path[i]]:
                            cut = i
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                own = self.out[x]
                while tried[x] < len(own) and not (self.room[own[tried[x]]] > 0 and far[self.to[own[tried[x]]]] == far[x] + 1):
                    tried[x] += 1
                if tried[x] < len(own):
                    path.append(own[tried[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break


def route(patterns: Sequence[tuple[frozenset, int]], quotas: dict, repeats: int) -> list[dict]:
    """Words that each pattern (its sources, its words) gives to each source; at most ``repeats`` times its words."""
    at = {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    net, copies, uses = Flow(2 + len(patterns) + len(at)), [], []
    for i, (members, words) in enumerate(patterns):
        copies.append(net.arc(0, 2 + i, 0))
        uses.append({s: net.arc(2 + i, at[s], words * repeats) for s in sorted(members & at.keys(), key=at.__getitem__)})
    for s, quota in quotas.items():
        net.arc(at[s], 1, quota)
    for _ in range(repeats):
        for e, (_, words) in zip(copies, patterns, strict=True):
            net.room[e] += words
        net.run(0, 1)
    return [{s: net.room[e ^ 1] for s, e in use.items() if net.room[e ^ 1]} for use in uses]


def fill_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared anew by weight."""
    targets, open_, left = {}, list(sizes), total
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > most * sizes[s]]
        if not over:
            targets |= {s: left * weights[s] / weight for s in open_}
            break
        for s in over:
            targets[s] = float(most * sizes[s])
        left -= sum(targets[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return targets


def _ordered(names) -> list:
    return sorted((s for s in names if s is not None)) + [None] * (None in names)


def mix_sources(
    docs: DataFrame,
    cycle: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    weights: dict | None = None,
    source: str = "source",
    carry: Sequence[str] = (),
    most_patterns: int = MOST_PATTERNS,
) -> DataFrame:
    """How many words of each row of docs (doc_id, text, source) the mix takes.

    source: a string, or an array of them for documents of several sources.
    weights: by source; else ``cycle`` repeats over the sources by code point,
    null last. Sources share ``share`` times all words, no source's target is
    above ``repeats`` times its words. ``carry`` columns pass through. Returns
    doc_id, size, source_size, target (both of the row's source, or the sums
    over its sources) and taken.
    """
    need(docs, "doc_id", "text", source, *carry)
    spark = docs.sparkSession
    many = docs.schema[source].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.col(source).cast("array<string>"))) if many else F.array(F.col(source).cast("string"))
    members = F.when(F.coalesce(F.size(members), F.lit(0)) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    slim = written(
        docs.select(
            "doc_id",
            F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.to_json(members).alias("pattern"),
            # 60 bits of a hash that SQL engines share
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long").alias("place"),
            *(F.col(c).alias(f"carried_{c}") for c in carry),
        ),
        "mix-sizes",
    )
    found = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    found.sort(key=lambda r: r["pattern"])
    names_of = {r["pattern"]: json.loads(r["pattern"]) for r in found}
    sizes: dict = {}
    for r in found:
        for s in names_of[r["pattern"]]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    order = _ordered(sizes)
    sizes = {s: sizes[s] for s in order}
    weights = weights or {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total = sum(r["words"] for r in found)
    targets = fill_targets(sizes, weights, share * total, repeats)
    given = route([(frozenset(names_of[r["pattern"]]), r["words"]) for r in found], {s: math.floor(targets[s] + 0.5) for s in order}, repeats)
    # Where in the hashed order each pattern's last copy ends: first by bucket, then by row.
    rows = max((r["n"] for r in found), default=0)
    bits = max(6, min(20, (rows // 20_000).bit_length()))
    plan = [
        (r["pattern"], sum(sizes[s] for s in names_of[r["pattern"]]), float(sum(targets[s] for s in names_of[r["pattern"]])), *divmod(sum(g.values()), max(1, r["words"])))
        for r, g in zip(found, given, strict=True)
    ]
    small = F.broadcast if len(found) <= BROADCAST_PATTERNS else lambda df: df
    plans = small(spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long, extra long"))
    bucket = F.shiftright("place", 60 - bits)
    slim = slim.withColumn("bucket", bucket)
    so_far = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    cuts = (
        sums.join(plans, "pattern")
        .where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")))
        .groupBy("pattern")
        .agg(F.min("bucket").alias("cut"), F.min_by("before", "bucket").alias("before"))
    )
    placed = slim.join(plans, "pattern").join(small(cuts), "pattern", "left")
    own = ["doc_id", "size", "source_size", "target", *(F.col(f"carried_{c}").alias(c) for c in carry)]
    inside = placed.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
    inside = inside.select(*own, (F.col("size") * (F.col("whole") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0))).alias("taken"))
    line = Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(F.col("bucket") == F.col("cut")).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead")))
    return inside.unionByName(edge.select(*own, (F.col("size") * F.col("whole") + part).alias("taken")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), t AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s
), open AS (
  SELECT arg_min(rest, 2.0 * source_size / w) AS rest, arg_min(weights, 2.0 * source_size / w) AS weights FROM t WHERE rest / weights <= cap / w
), targets AS (
  SELECT source, source_size, CASE WHEN open.rest * w / open.weights > cap THEN cap ELSE open.rest * w / open.weights END AS target FROM t, open
), q AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (quota // greatest(source_size, 1)) + greatest(0, least(size, quota % greatest(source_size, 1) - ahead)))::BIGINT AS taken FROM q
"""
