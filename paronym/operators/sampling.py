"""Deterministic splits, balancing and draws: the order of a seeded hash stands in for chance.

The hash is md5 of key and seed, which any engine can repeat.  Rows are never
numbered in one task: the hash's leading digits cut each label's rows into
cells, cells are counted, and a row's number is its cell's offset and its place
inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def numbered(df: DataFrame, key: str, within: list[str], seed: int) -> DataFrame:
    """Add ``rank`` from 0 by hash order inside each value of ``within``, and the size ``of``."""
    h = df.withColumn("h", order_hash(key, seed)).withColumn("cell", F.substring("h", 1, 3))
    sizes = h.groupBy(*within, "cell").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*within)
    before = sizes.select(*within, "cell", (F.sum("c").over(group.orderBy("cell")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("of"))
    placed = h.withColumn("inside", F.row_number().over(Window.partitionBy(*within, "cell").orderBy("h", key)) - 1)
    return placed.join(F.broadcast(before), [*within, "cell"]).withColumn("rank", F.col("before") + F.col("inside")).drop("h", "cell", "inside", "before")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.15, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``: each label's rows by hash order, the first ``test`` of them to teste, the next to validacao, the rest to treino."""
    made = numbered(df, key, [label], seed)
    a, b = F.floor(F.col("of") * test + 0.5), F.floor(F.col("of") * validation + 0.5)
    split = F.when(F.col("rank") < a, "teste").when(F.col("rank") < a + b, "validacao").otherwise("treino")
    return made.withColumn("split", split).drop("rank", "of")


def undersampled(df: DataFrame, key: str, label: str, ratio: int = 3, seed: int = 42) -> DataFrame:
    """All positives and at most ``ratio`` negatives for each; without positives all rows."""
    positives = df.agg(F.coalesce(F.sum((F.col(label) == 1).cast("int")), F.lit(0)).alias("np"))
    made = numbered(df, key, [label], seed).crossJoin(F.broadcast(positives))  # one row
    keep = (F.col(label) == 1) | (F.col("np") == 0) | (F.col("rank") < F.col("np") * ratio)
    return made.where(keep).drop("rank", "of", "np")


def _draws(df: DataFrame, key: str, wanted: Callable[[int], int], seed: int, within: list[str]) -> DataFrame:
    """Rows drawn with replacement: draw ``i`` takes the row whose number a hash of ``i`` gives.

    ``wanted`` gives the number of draws from a group's size; ``within`` are
    labels, so the sizes are a few rows.  Draws are made in partitions, however many.
    """
    spark = df.sparkSession
    made = numbered(df, key, within, seed)
    drawn = made.select(*within).limit(0).withColumns({"of": F.lit(0).cast("bigint"), "draw": F.lit(0).cast("bigint")})
    for r in df.groupBy(*within).agg(F.count("*").alias("of")).collect():
        group = [F.lit(r[w]).cast(df.schema[w].dataType).alias(w) for w in within]
        drawn = drawn.unionByName(spark.range(max(wanted(r["of"]), 0)).select(*group, F.lit(r["of"]).cast("bigint").alias("of"), F.col("id").alias("draw")))
    placed = drawn.select(*within, "draw", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "draw", F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint"), F.col("of")).alias("rank"))
    return placed.join(made.drop("of"), [*within, "rank"]).drop("rank")


def oversampled(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Negatives as they are and positives drawn with replacement up to their number; without positives all rows.

    A drawn row carries the number of its ``draw``, others null.
    """
    counts = df.agg(F.coalesce(F.sum((F.col(label) == 1).cast("int")), F.lit(0)).alias("np"), F.coalesce(F.sum((F.col(label) != 1).cast("int")), F.lit(0)).alias("nn")).first()
    if not counts.np:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    positives = _draws(df.where(F.col(label) == 1), key, lambda _: counts.nn, seed, [label])
    return df.where(F.col(label) != 1).withColumn("draw", F.lit(None).cast("bigint")).unionByName(positives.select(*df.columns, "draw"))


def bootstrap(df: DataFrame, key: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """``fraction`` of the rows drawn with replacement; as many as there are where that would be under 10."""
    made = _draws(df.withColumn("all", F.lit(0)), key, lambda n: n if int(n * fraction) < 10 else int(n * fraction), seed, ["all"])
    return made.drop("all")


def mixed_up(df: DataFrame, key: str, columns: list[str], label: str, alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """Each row blended with another: columns and label are ``w * own + (1 - w) * other``.

    The other row is that of the same place in another hash order; the weight
    comes from a hash by the inverse of the distribution function of Beta(alpha,
    alpha) in the form ``u ** (1 / alpha) / (u ** (1 / alpha) + v ** (1 / alpha))``,
    taken as 1 where both powers vanish.  The number of rows stays.
    """
    own = numbered(df.withColumn("all", F.lit(0)), key, ["all"], seed).drop("of", "all")
    other = numbered(df.withColumn("all", F.lit(0)), key, ["all"], seed + 1).select("rank", F.struct(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate([*columns, label])]).alias("o"))
    unit = lambda n: (F.conv(F.substring(order_hash(key, seed + n), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    x, y = F.pow(unit(2), F.lit(1 / alpha)), F.pow(unit(3), F.lit(1 / alpha))
    w = F.when(x + y > 0, x / (x + y)).otherwise(F.lit(1.0))
    blended = {c: F.col("w") * F.col(f"`{c}`").cast("double") + (1 - F.col("w")) * F.col("o")[f"v{i}"] for i, c in enumerate([*columns, label])}
    return own.join(other, "rank").withColumn("w", w).withColumns(blended).select(*df.columns)


def stratified_union(df: DataFrame, key: str, label: str, size: int, positives: int, seed: int = 42) -> DataFrame:
    """``size`` rows of which ``positives`` have label 1, as far as there are, each part the first by hash order."""
    part = lambda rows, n: hash_sample(rows, key, n, seed)
    return part(df.where(F.col(label) == 1), positives).unionByName(part(df.where(F.col(label) != 1), size - positives))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """``(pos_weight)``: negatives for each positive, no positive counting as one."""
    p, n = F.sum((F.col(label) == 1).cast("int")), F.sum((F.col(label) == 0).cast("int"))
    return df.agg((n / F.greatest(p, F.lit(1))).alias("pos_weight"))


def swapped(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """All rows, and each again with the columns of every pair exchanged."""
    turn = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    other = df.select(*[F.col(f"`{turn.get(c, c)}`").alias(c) for c in df.columns], F.lit(True).alias("swapped"))
    return df.withColumn("swapped", F.lit(False)).unionByName(other)


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, the first by hash order."""
    return df.orderBy(order_hash(key, seed), key).limit(size)


def hard_negatives(scored: DataFrame, size: int, key: str = "pair_id") -> DataFrame:
    """The negatives with the highest scores."""
    return scored.where("y = 0").orderBy(F.desc("score"), key).limit(size)
