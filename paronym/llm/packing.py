"""Filling containers of fixed capacity with items of varying length.

Hierarchical residual packing: every partition packs its items best-fit by
falling size and closes its nearly full bins; the others travel as items to the
next level, where fewer partitions pack them together, up to one.  An item is
cut only if it is larger than a container.

Bins whose room is smaller than the smallest item left anywhere are closed
between levels, which costs nothing.  A level has as many partitions as its
items need at ``rows_per_task``, so no task grows with the data; where that
keeps more than one partition, levels go on in new company until a round spares
less than one bin in a thousand.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_BINS = "bin string, size bigint, items array<struct<key: string, piece: int, tokens: bigint>>, closed boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices by bin: largest first, each into the fullest bin that still holds it."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    rooms: list[int] = []  # residuals that occur, sorted
    by_room: dict[int, list[int]] = {}
    for i in order:
        need = int(sizes[i])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            place = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[place].append(int(i))
        else:
            room, place = capacity, len(bins)
            bins.append([int(i)])
        left = room - need
        if left not in by_room:
            insort(rooms, left)
            by_room[left] = []
        by_room[left].append(place)
    return bins


def _pack(capacity: int, full: float, level: int, last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        held = pd.concat(parts, ignore_index=True)
        held = held.sort_values("bin", kind="stable").reset_index(drop=True)  # the order in which rows arrive plays no part
        sizes = held["size"].to_numpy(np.int64)
        bins = best_fit(sizes, capacity)
        sums = np.array([sizes[b].sum() for b in bins])
        closed = np.ones(len(bins), bool) if last else sums >= full * capacity
        names, items = held["bin"].to_numpy(), held["items"].to_numpy()
        for at in range(0, len(bins), 10_000):
            some = range(at, min(at + 10_000, len(bins)))
            yield pd.DataFrame({"bin": [f"{level}:{b}:{names[bins[b][0]]}" for b in some], "size": sums[at : at + len(some)], "items": [[x for i in bins[b] for x in items[i]] for b in some], "closed": closed[at : at + len(some)]})

    return run


def pack_items(df: DataFrame, key: str, size: str, capacity: int = 4096, full: float = 0.98, partitions: int | None = None, fan_in: int = 8, rows_per_task: int = 200_000) -> DataFrame:
    """``(container, key, piece, tokens, filled)``: every item in its container, or in several if it is larger than one.

    ``piece`` counts from 0; ``filled`` is the container's total.  A null size
    counts as 0; an item of size 0 needs no container and comes with null.  Keys
    come as strings and should be unique and not null; a repeated row is an item
    of its own.  Other columns play no part.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("n")))
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_task)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1), lambda i: F.struct(F.col("key").alias("key"), i.cast("int").alias("piece"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - i * capacity).alias("tokens")))
    cut = rows.where("n > 0").select(F.explode(pieces).alias("x"))
    name = F.concat_ws("/", F.lpad(F.hex(F.xxhash64("x.key")), 16, "0"), F.coalesce("x.key", F.lit("")), F.col("x.piece").cast("string"))
    items = cut.select(name.alias("bin"), F.col("x.tokens").alias("size"), F.array("x").alias("items"))
    todo, done, level, before = items.repartition(count, "bin"), [], 0, None
    while True:
        packed = cut_lineage(todo.mapInPandas(_pack(capacity, full, level, count == 1), _BINS))
        left = packed.where("not closed")
        n, least = left.agg(F.count("*"), F.min("size")).first()
        if not n or (count > 1 and before is not None and before - n < before / 1000):
            done.append(packed.drop("closed"))
            break
        fits = F.col("size") + least <= capacity
        done.append(packed.where(F.col("closed") | ~fits).drop("closed"))
        need = -(-n // rows_per_task)
        before = n if need >= count // fan_in else None  # a smaller number of partitions is a fresh start
        count, level = max(1, count // fan_in, need), level + 1
        todo = left.where(fits).drop("closed").repartition(count, F.xxhash64(F.lit(level), "bin"))
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    placed = bins.select(F.col("bin").alias("container"), F.col("size").alias("filled"), F.explode("items").alias("x")).select("container", "x.key", "x.piece", "x.tokens", "filled")
    empty = rows.where("n <= 0").select(F.lit(None).cast("string").alias("container"), "key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("filled"))
    return placed.unionByName(empty)
