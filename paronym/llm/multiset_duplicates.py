"""Duplicates hidden by formatting: one fingerprint for records that differ in case, blanks, punctuation or field order.

Each normalised field name and value is hashed; the hashes are added, so their
order can't matter.  Records meet by fingerprint in an aggregation that combines
on the map side; each record is then held against its group's first record,
field by field, without sorting.  A record that only shares the fingerprint is
grouped again by its fields themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEEDS = ("a", "b")


def fingerprint(swappable: list[str], fixed: list[str], bits: int = 64) -> Column:
    """Two sums of hashes as a struct; ``swappable`` fields share one name, so their values may change places.

    ``bits`` shortens the sums and is for tests of the verification only.
    """
    pairs = [("*", c) for c in swappable] + [(c, c) for c in fixed]
    # Sums wrap at 64 bits: the upper and lower halves are added apart, so that no addition overflows.
    sums = []
    for seed in SEEDS:
        hashes = [F.xxhash64(F.lit(seed), F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()) for name, c in pairs]
        low = reduce(lambda x, y: x + y, [h.bitwiseAND(F.lit(0xFFFFFFFF)) for h in hashes])
        high = reduce(lambda x, y: x + y, [F.shiftrightunsigned(h, 32) for h in hashes])
        sums += [low, high]
    if bits < 64:
        sums = [F.pmod(s, F.lit(2**bits)) for s in sums[:1]]
    return F.struct(*[s.alias(f"h{i}") for i, s in enumerate(sums)])


def _same(left: str, right: str, swappable: list[str], fixed: list[str]) -> Column:
    """Whether two records hold the same fields: every value occurs as often among the one's swappable fields as among the other's."""
    a, b = [F.col(f"{left}.{c}") for c in swappable], [F.col(f"{right}.{c}") for c in swappable]
    equal = F.lit(True)
    for x in a:
        equal = equal & (sum((F.when(x.eqNullSafe(y), 1).otherwise(0) for y in a), F.lit(0)) == sum((F.when(x.eqNullSafe(y), 1).otherwise(0) for y in b), F.lit(0)))
    for c in fixed:
        equal = equal & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return equal


def duplicate_groups(df: DataFrame, key: str, swappable: list[str], fixed: list[str], bits: int = 64) -> DataFrame:
    """``(first, key, copies)`` for each row of a group of two or more: the group's smallest key, the row's, the group's size.

    Fields are compared as they come (normalise them first); null equals null.
    Keys should be unique and not null; a repeated row counts as a copy of
    itself.  Columns of ``df`` that aren't named play no part.
    """
    names = [f"s{i}" for i in range(len(swappable))], [f"x{i}" for i in range(len(fixed))]
    rows = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(swappable, names[0])], *[F.col(f"`{c}`").alias(n) for c, n in zip(fixed, names[1])])
    fields = [*names[0], *names[1]]
    rows = cut_lineage(rows.select(fingerprint(*names, bits).alias("fp"), "key", F.struct(*fields).alias("own")))
    groups = rows.groupBy("fp").agg(F.min_by("own", "key").alias("lead"), F.count("*").alias("n")).where("n > 1")
    held = rows.join(groups, "fp").withColumn("same", _same("own", "lead", *names))
    if bits >= 64:
        held = cut_lineage(held)
    # The leader of a group is the row with its smallest key; rows that agree with it share that key.
    leads = held.where("same").groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    agreed = held.where("same").join(leads, "fp").select("first", "key", "copies")
    rest = held.where(~F.col("same")).select("key", F.array_sort(F.array(*[F.col(f"own.{c}") for c in names[0]])).alias("s"), *[F.col(f"own.{c}").alias(c) for c in names[1]])
    exact = rest.groupBy("s", *names[1]).agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("s", *names[1])])
    others = rest.alias("r").join(exact.alias("e"), same).select("e.first", "r.key", "e.copies")
    return agreed.unionByName(others).where("copies > 1")
