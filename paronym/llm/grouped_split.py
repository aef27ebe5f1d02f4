"""Splits that keep related records together.

Records that share a value belong to one component, directly or through others;
components are given whole to the splits.  The search starts from hashed
assignment and moves or exchanges whole components, lessening the deviation of
size and label shares by annealing; chains with different seeds run in parallel
and the best result of all is kept.

The search works on units of bounded number: each component that holds more
than ``1 / heavy`` of the records is a unit, and the others fall into ``buckets``
by hash.  A chain therefore holds at most ``heavy + buckets`` rows, at any size
of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components


def related_groups(members: DataFrame, record: str, value: str) -> DataFrame:
    """``(record, group)`` for every record: the smallest record that it is tied to by shared values.

    ``members`` has a row for each value of a record; records are integers.  A
    null value ties nothing, an empty one is a value like others; a record with
    nulls alone is its own group; rows with a null record are left out.
    """
    rows = cut_lineage(members.select(F.col(f"`{record}`").cast("bigint").alias("r"), F.col(f"`{value}`").alias("v")).where("r is not null").distinct())
    # A value stands for the smallest record that has it: two values of one record then are tied in any case.
    least = rows.where("v is not null").groupBy("v").agg(F.min("r").alias("rep"))
    tied = cut_lineage(rows.join(least, "v", "left").groupBy("r").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.collect_set("rep").alias("reps")))
    edges = tied.select("low", F.explode("reps").alias("other"))
    roots = components(edges, "low", "other")
    return tied.join(roots.withColumnRenamed("v", "low"), "low", "left").select(F.col("r").alias("record"), F.coalesce("root", "low", "r").alias("group"))


def _anneal(shares: list[float], steps: int, seed: int, weight: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    want = np.asarray(shares)

    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values("unit", kind="stable").reset_index(drop=True)
        chain = int(units["chain"].iloc[0])
        rng = np.random.default_rng([seed, chain])
        size, label = units["n"].to_numpy(float), units["positive"].to_numpy(float)
        total, positives = max(size.sum(), 1.0), max(label.sum(), 1.0)
        place = units["start"].to_numpy(np.int64).copy()
        sums = np.stack([np.bincount(place, size, len(want)) / total, np.bincount(place, label, len(want)) / positives])
        size, label = size / total, label / positives

        def cost(s: np.ndarray) -> float:
            return float(np.abs(s[0] - want).sum() + weight * np.abs(s[1] - want).sum())

        now = cost(sums)
        best, best_place = now, place.copy()
        n, heat = len(place), max(now, 1e-3)
        cool = (1e-7 / heat) ** (1 / max(steps, 1)) if heat > 1e-7 else 1.0
        # Large units are drawn more often: they are what moves the sums at first.
        by_size = np.cumsum(np.sqrt(size) + 1e-9)
        first = np.searchsorted(by_size, rng.random(steps) * by_size[-1]).clip(0, n - 1)
        other, target, swap, luck = rng.integers(0, n, steps), rng.integers(0, len(want), steps), rng.random(steps) < 0.5, rng.random(steps)
        for t in range(steps):
            i, j = first[t], other[t]
            a, b = place[i], place[j] if swap[t] else target[t]
            if a == b:
                heat *= cool
                continue
            new = sums.copy()
            dx, dy = size[i] - (size[j] if swap[t] else 0.0), label[i] - (label[j] if swap[t] else 0.0)
            new[0, a] -= dx
            new[0, b] += dx
            new[1, a] -= dy
            new[1, b] += dy
            c = cost(new)
            if c <= now or luck[t] < math.exp((now - c) / heat):
                place[i] = b
                if swap[t]:
                    place[j] = a
                sums, now = new, c
                if now < best:
                    best, best_place = now, place.copy()
            heat *= cool
        return pd.DataFrame({"chain": chain, "unit": units["unit"], "place": best_place, "cost": best})

    return run


def split_groups(
    records: DataFrame, record: str, group: str, label: str | None, shares: dict[str, float], seed: int = 42, chains: int = 8, steps: int = 20_000, weight: float = 0.5, heavy: int = 2000, buckets: int = 2048
) -> DataFrame:
    """``(record, group, split)``: every record in its group's split, sizes near ``shares``.

    ``label`` is an integer column whose 1s should spread like the records, or
    None; other values and null count as 0.  Groups are never parted, so one
    that is larger than a share leaves the sizes uneven; nothing else does.  An
    empty table gives an empty result; repeated records stay repeated.
    """
    names, part = list(shares), np.cumsum(list(shares.values())) / sum(shares.values())
    positive = F.lit(0) if label is None else F.coalesce((F.col(f"`{label}`") == 1).cast("int"), F.lit(0))
    rows = cut_lineage(records.select(F.col(f"`{record}`").alias("record"), F.col(f"`{group}`").alias("group"), positive.alias("p")))
    total = rows.count()
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    spread = lambda what, m: F.pmod(F.xxhash64(F.lit(what), F.lit(seed), "group"), F.lit(m))
    unit = F.when(F.col("n") * heavy > total, F.concat(F.lit("g"), F.col("group").cast("string"))).otherwise(F.concat(F.lit("b"), spread("bucket", buckets).cast("string")))
    groups = cut_lineage(sizes.select("group", "n", "p", unit.alias("unit")))
    units = groups.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("p").alias("positive"))
    draw = F.pmod(F.xxhash64(F.lit("start"), F.lit(seed), "unit", "chain"), F.lit(1_000_000)) / 1_000_000
    start = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        start = F.when(draw < float(part[i]), F.lit(i)).otherwise(start)
    tried = units.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).withColumn("start", start)
    want = [float(x) for x in np.diff(part, prepend=0)]
    done = cut_lineage(tried.groupBy("chain").applyInPandas(_anneal(want, steps, seed, weight), "chain int, unit string, place int, cost double"))
    best = done.agg(F.min(F.struct("cost", "chain"))["chain"].alias("chain"))
    chosen = done.join(F.broadcast(best), "chain").select("unit", F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1).alias("split"))
    placed = groups.join(F.broadcast(chosen), "unit").select("group", "split")  # at most heavy + buckets rows are broadcast
    return rows.join(placed, "group").select("record", "group", "split")
