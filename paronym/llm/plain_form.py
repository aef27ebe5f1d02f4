"""Visually identical text with different characters: one plain form for every spelling.

Texts are exploded to positioned code points, a broadcast table brings each
code point's decomposition, look-alike letter and combining class, marks are
ordered by class inside their segment, segments are composed again and the
strings rebuilt.  Explode, join and rebuild run inside one partitioning by the
text's hash, so the exploded rows are never shuffled, and every distinct text is
worked on once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .unicode_tables import LOOKALIKES, code_points, compositions, joining, merging_starters

#: Text in these characters alone is its own plain form.
SETTLED = "[^\\t\\n\\r -~\\u00a1-\\u00ac\\u00ae-\\u00ff]"


def _class(chars: str) -> str:
    """A regular expression character class; neighbouring code points become ranges."""
    numbers, spans = sorted(map(ord, chars)), []
    for n in numbers:
        if spans and spans[-1][1] == n - 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _compose(parts: Column) -> Column:
    """Canonical composition of an array of (class, ..., char) whose marks are in order."""
    table = F.str_to_map(F.lit("\x01".join(f"{two}\x02{one}" for two, one in compositions().items())), F.lit("\x01"), F.lit("\x02"))

    def state(done: Column, starter: Column, tail: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))

    def step(s: Column, part: Column) -> Column:
        made = F.when((s["starter"] != "") & (s["last"] < part["k"]), F.element_at(table, F.concat(s["starter"], part["c"])))
        return (
            F.when(made.isNotNull(), state(s["done"], made, s["tail"], s["last"]))
            .when(part["k"] == 0, state(F.concat(s["done"], s["starter"], s["tail"]), part["c"], F.lit(""), F.lit(-1)))
            .otherwise(state(s["done"], s["starter"], F.concat(s["tail"], part["c"]), part["k"]))
        )

    empty = F.lit("")
    return F.aggregate(parts, state(empty, empty, empty, F.lit(-1)), step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def _odd(value: Column) -> Column:
    return F.coalesce(value.rlike(SETTLED), F.lit(False))


def plain_values(values: DataFrame, column: str, lookalikes: dict[str, str] | None = None) -> DataFrame:
    """``(value, plain)`` of each distinct string of ``column`` that has characters which may change.

    Texts may have any length; the exploded code points of a text stay in the
    partition to which the text was sent.
    """
    known = tuple((LOOKALIKES if lookalikes is None else lookalikes).items())
    table = values.sparkSession.createDataFrame([(ch, image, [tuple(p) for p in parts]) for ch, image, parts in code_points(known)], "ch string, image string, parts array<struct<c: string, k: int>>")
    merging = F.coalesce(F.col("v").rlike(_class(joining(known))), F.lit(False))
    each = values.select(F.col(f"`{column}`").cast("string").alias("v")).where(_odd(F.col("v"))).distinct()

    # A row number inside the partition keeps texts of one hash apart; it is made and used in one stage.
    held = each.withColumn("hv", F.xxhash64("v")).repartition("hv").withColumn("rid", F.monotonically_increasing_id()).withColumn("m", merging)
    group = ["hv", "rid"]
    chars = held.select(*group, "m", F.posexplode(F.split("v", "")).alias("p", "ch"), F.when(F.col("p") == 0, F.col("v")).alias("v"))
    mapped = chars.join(F.broadcast(table), "ch", "left")

    single = mapped.where(~F.col("m")).groupBy(*group).agg(
        F.max("v").alias("v"), F.array_sort(F.collect_list(F.struct("p", F.coalesce("image", "ch").alias("s")))).alias("a")
    )
    parts = mapped.where("m").select(*group, "p", "v", F.posexplode_outer(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))).alias("j", "x"))
    order = Window.partitionBy(*group).orderBy("p", "j")
    segments = parts.withColumn("s", F.sum(F.when(F.col("x.k") == 0, 1).otherwise(0)).over(order))
    composed = segments.groupBy(*group, "s").agg(F.max("v").alias("v"), F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct(F.col("x.k").alias("k"), "p", "j", F.col("x.c").alias("c"))))).alias("a"))
    merged = _seconds(composed, group)

    def whole(d: DataFrame) -> DataFrame:
        return d.select(F.col("v").alias("value"), F.array_join(F.transform("a", lambda x: x["s"]), "").alias("plain"))

    return whole(single).unionByName(whole(merged))


def plain_forms(df: DataFrame, keys: list[str], fields: list[str], lookalikes: dict[str, str] | None = None) -> DataFrame:
    """One row ``(*keys, field, value, plain)`` for each row of ``df`` and each of ``fields``.

    ``field`` is the column's name, ``value`` the stored string and ``plain``
    its plain form: canonical composition, separate letters and digits of
    ordinary width, ordinary blanks, no invisible characters, a Latin letter
    for each look-alike.  Tabs and line breaks stay.  Null stays null, empty
    stays empty; repeated rows and repeated keys are kept, each for itself;
    other columns of ``df``, whatever their names, are left out.  A conjoining
    Hangul jamo isn't composed.  Texts may have any length.  Only values that
    may change are moved, and each distinct one is worked on once.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)], F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields])).alias("x")).select(*k, "x.f", "x.v")
    named = lambda d, plain: d.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("f").alias("field"), F.col("v").alias("value"), plain.alias("plain"))
    odd = rows.where(_odd(F.col("v")))
    known = plain_values(odd, "v", lookalikes).withColumnRenamed("value", "v")
    return named(rows.where(~_odd(F.col("v"))), F.col("v")).unionByName(named(odd.join(known, "v"), F.col("plain")))


def plain_columns(df: DataFrame, keys: list[str], fields: list[str], lookalikes: dict[str, str] | None = None) -> DataFrame:
    """``(*keys, *fields)`` with each field in plain form, one row for each row of ``df``; cases as in ``plain_forms``."""
    k, v = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(fields))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)], *[F.col(f"`{f}`").cast("string").alias(a) for f, a in zip(fields, v)])
    any_odd = reduce(lambda x, y: x | y, [_odd(F.col(a)) for a in v])
    odd = rows.where(any_odd)
    known = cut_lineage(plain_values(odd.select(F.explode(F.array(*v)).alias("v")), "v", lookalikes))  # read once a field
    for a in v:
        odd = odd.join(known.select(F.col("value").alias(a), F.col("plain").alias("p")), a, "left").withColumn(a, F.coalesce("p", a)).drop("p")
    both = rows.where(~any_odd).unionByName(odd)
    return both.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], *[F.col(a).alias(f) for a, f in zip(v, fields)])


def _seconds(composed: DataFrame, group: list[str]) -> DataFrame:
    """Strings of composed segments, in order.  A few composing code points are starters themselves; they merge here."""
    texts = composed.select(*group, "s", "v", F.when(F.size("a") == 1, F.col("a")[0]["c"]).otherwise(_compose(F.col("a"))).alias("t"))
    whole = texts.groupBy(*group).agg(F.max("v").alias("v"), F.array_sort(F.collect_list(F.struct(F.col("s").alias("p"), F.coalesce("t", F.lit("")).alias("s")))).alias("a"))
    return whole.withColumn("a", F.when(F.exists("a", lambda x: x["s"].isin(*merging_starters())), F.array(F.struct(F.lit(0).cast("bigint").alias("p"), _compose(F.transform("a", lambda x: F.struct(F.lit(0).alias("k"), x["s"].alias("c")))).alias("s")))).otherwise(F.col("a")))


def folded(plain: Column) -> Column:
    """The plain form in lower case, letters and digits only; accents stay."""
    return F.regexp_replace(F.lower(plain), "[^\\p{L}\\p{N}]", "")


def terms(plain: Column) -> Column:
    """Unbroken runs of letters and digits of the lower-case plain form, in order."""
    return F.regexp_extract_all(F.lower(plain), F.lit("[\\p{L}\\p{N}]+"), 0)


def is_usable(*columns: str) -> Column:
    """Whether every column has a character that is no blank."""
    held = F.lit(True)
    for c in columns:
        held = held & F.coalesce(F.col(f"`{c}`").rlike("[^\\s\\p{Z}]"), F.lit(False))
    return held
