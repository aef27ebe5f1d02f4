"""Mixing sources to target weights.

Documents are aggregated by the set of sources they belong to.  A minimum-cost
flow routes the tokens of each such pattern to the sources' quotas; using a
pattern's tokens once more costs more each time, so nothing is repeated while
fresh text is left, and a source never uses a document more often than its cap.
The flow runs on one row a pattern; documents are then chosen where they are:
each pattern's documents lie in seeded order on a circle, and each source takes
the arc that the flow gave it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


class Flow:
    """Minimum-cost maximum flow by successive shortest paths with potentials, for small graphs with whole capacities."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def carried(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        height: dict[int, int] = dict.fromkeys(self.out, 0)
        total = 0
        while True:
            far, via, heap = {s: 0}, {}, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out.get(x, ()):
                    y = self.to[e]
                    if self.room[e] and d + self.cost[e] + height[x] - height[y] < far.get(y, math.inf):
                        far[y] = d + self.cost[e] + height[x] - height[y]
                        via[y] = e
                        heapq.heappush(heap, (far[y], y))
            if t not in far:
                return total
            for x in height:
                height[x] += far.get(x, far[t])
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each source takes from each pattern.  ``targets``: a source's weight and how often it may use a document."""
    flow, first, goal = Flow(), 0, 1
    at = {s: 2 + i for i, s in enumerate(sorted(targets))}
    arcs = {}
    for i, (pattern, tokens) in enumerate(sorted(patterns.items())):
        node = 2 + len(at) + i
        for use in range(sum(targets[s][1] for s in pattern)):
            flow.arc(first, node, tokens, use)
        for s in pattern:
            arcs[pattern, s] = flow.arc(node, at[s], tokens * targets[s][1], 0)
    for s, node in at.items():
        flow.arc(node, goal, math.ceil(targets[s][0] * total), 0)
    flow.run(first, goal)
    return {k: flow.carried(e) for k, e in arcs.items()}


@dataclass
class Mix:
    """``report``: (source, weight, max_uses, documents, tokens, capacity, target, chosen, taken, share, short); ``selection``: (key, source, uses, tokens).

    ``chosen`` is the flow's plan; ``taken`` and ``share`` are what the selection takes in whole documents.
    """

    report: DataFrame
    selection: DataFrame


def mix_sources(df: DataFrame, key: str, size: str, sources: str, targets: DataFrame, seed: int = 42, circle: int = 16_384) -> Mix:
    """Choose documents so that each source of ``targets`` (source, weight, max_uses) gives its share of the total size.

    ``sources`` is a column of one source or an array of several.  The total is
    the size of all documents that have a source.  A document without a source
    or without a source of ``targets`` isn't chosen; a null size or weight
    counts as 0, a null or negative number of uses as 0.  A source whose tokens
    times its uses don't reach its target gives all it has and is ``short``.
    Repeated keys are documents of their own.  ``targets`` is a parameter table
    of one row a source.  The driver receives a row for each pattern of its
    sources that occurs, at most ``2 ** sources - 1`` and no more than documents.
    """
    spark = df.sparkSession
    wanted = {r[0]: (float(r[1] or 0.0), max(int(r[2] or 0), 0)) for r in targets.collect() if r[0] is not None}
    kind = dict(df.dtypes)[sources]
    held = F.col(f"`{sources}`") if kind.startswith("array") else F.when(F.col(f"`{sources}`").isNotNull(), F.array(F.col(f"`{sources}`").cast("string")))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("n"), F.array_sort(F.array_distinct(F.array_compact(held))).alias("pattern")).where("size(pattern) > 0")
    # Sources without a target only count in the total.
    rows = cut_lineage(rows.withColumn("pattern", F.filter("pattern", lambda s: s.isin(*wanted) if wanted else F.lit(False))))
    by_pattern = rows.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    total = sum(r.n for r in by_pattern)
    known: dict[tuple[str, ...], int] = {}
    for r in by_pattern:
        if r.pattern and r.n > 0:
            known[tuple(r.pattern)] = r.n
    flows = route(known, wanted, total)

    plan, offset = [], dict.fromkeys(known, 0)
    for (p, s), f in sorted(flows.items()):
        if f:
            plan.append((list(p), s, offset[p], f, known[p]))
            offset[p] = (offset[p] + f) % known[p]
    arcs = spark.createDataFrame(plan, "pattern array<string>, source string, begin bigint, tokens bigint, length bigint")

    ours = rows.where("size(pattern) > 0 and n > 0")
    order = ours.withColumn("h", F.xxhash64(F.lit(seed), F.col("key").cast("string"))).withColumn("slot", F.pmod("h", F.lit(circle)))
    slots = order.groupBy("pattern", "slot").agg(F.sum("n").alias("n"))
    before = slots.select("pattern", "slot", (F.sum("n").over(Window.partitionBy("pattern").orderBy("slot")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("pattern", "slot").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = order.withColumn("inside", inside).join(before, ["pattern", "slot"]).select("key", "n", "pattern", (F.col("before") + F.col("inside")).alias("start"))
    # Turns of the circle at which the document's start lies on the arc [begin, begin + tokens).
    turns = "((begin + tokens - 1 - start) - pmod(begin + tokens - 1 - start, length)) div length - ((begin - 1 - start) - pmod(begin - 1 - start, length)) div length"
    chosen = placed.join(arcs, "pattern").select("key", "source", F.expr(turns).cast("int").alias("uses"), F.col("n").alias("tokens")).where("uses > 0")

    has = {s: (0, 0) for s in wanted}
    for r in by_pattern:
        for s in r.pattern:
            has[s] = (has[s][0] + r.d, has[s][1] + r.n)
    got = {s: sum(f for (_, x), f in flows.items() if x == s) for s in wanted}
    lines = [(s, w, m, has[s][0], has[s][1], has[s][1] * m, w * total, got[s], got[s] < w * total) for s, (w, m) in sorted(wanted.items())]
    facts = spark.createDataFrame(lines, "source string, weight double, max_uses int, documents bigint, tokens bigint, capacity bigint, target double, chosen bigint, short boolean")
    taken = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("taken"))
    reached = taken.agg(F.sum("taken").alias("all"))  # one row
    filled = facts.join(taken, "source", "left").crossJoin(F.broadcast(reached)).withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    report = filled.select("source", "weight", "max_uses", "documents", "tokens", "capacity", "target", "chosen", "taken", F.coalesce(F.col("taken") / F.col("all"), F.lit(0.0)).alias("share"), "short")
    return Mix(report, chosen)
