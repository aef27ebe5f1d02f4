"""The explainable score of two names: components, guards against chance likeness, and the better of several readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import anagram_similarity, edit_similarity, phonetic_code, token_metrics
from .text import base_form, digits_as_words, has_digit, numbers_as_words, phonetic_key, strict_form

# Labels of what drives a score, in the order in which they are tried, and of how numbers were read.
DRIVERS = {
    "fon": "Fonética (Som)",
    "orto": "Ortografia (Escrita)",
    "fuzzy": "Aproximação de Termos (Fuzzy)",
    "overlap": "Inclusão Total de Termo",
    "token": "Palavras em Comum",
    "none": "Geral",
}
LITERAL, CARDINAL = "Literal (dígito por dígito)", "Cardinal (valor por extenso)"


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later projections and filters take as it is: the optimizer doesn't move them past a generator.

    Without it the nested expressions are copied into each other until planning takes longer than the query.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _words(name: str) -> Column:
    return F.filter(F.split(F.col(name), " "), lambda t: t != "")


def _largest(*columns: Column) -> Column:
    return F.greatest(*columns)


def directional_score(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add the score of ``left`` against ``right``, two strings, as a struct ``out``.

    The fields are final, driver, orto, fon, token, anagram, fuzzy, jaccard and
    overlap.  The two directions may differ: on equal token counts the fuzzy
    overlap is seen from the left.
    """
    p = f"_{out}_"
    df = df.withColumns({f"{p}a": base_form(F.col(left)), f"{p}b": base_form(F.col(right))})
    a, b = F.col(f"{p}a"), F.col(f"{p}b")
    df = _settled(df, f"{p}in", F.struct(a.alias("a"), b.alias("b"), _words(f"{p}a").alias("w1"), _words(f"{p}b").alias("w2")))
    a, b, w1, w2 = (F.col(f"{p}in")[x] for x in ("a", "b", "w1", "w2"))
    parts = {"o": edit_similarity(strict_form(a), strict_form(b)), "f": edit_similarity(phonetic_code(w1), phonetic_code(w2)), "g": anagram_similarity(a, b), "m": token_metrics(w1, w2)}
    df = _settled(df, f"{p}parts", F.struct(*[c.alias(n) for n, c in parts.items()]))
    o, f, g, m = (F.col(f"{p}parts")[x] for x in "ofgm")
    j, v, z = m["jaccard"], m["overlap"], m["fuzzy"]
    few, many = F.least(F.size(w1), F.size(w2)), F.greatest(F.size(w1), F.size(w2))
    single = F.when(F.size(w1) == 1, w1).otherwise(w2)
    others = F.when(F.size(w1) == 1, w2).otherwise(w1)
    token = single[0]
    contained = (
        (z >= 1.0) & (few == 1) & ((o >= 0.2) | (f >= 0.25)) & (F.length(token) == 4)
        & (F.array_max(F.transform(others, lambda t: F.length(t))) >= 4)
        & F.exists(others, lambda t: phonetic_key(t) == phonetic_key(token))
        & F.exists(others, lambda t: F.levenshtein(t, token) <= 1)
    )
    df = df.withColumns({
        f"{p}t": _largest(j, v, z),
        f"{p}c": F.coalesce(contained, F.lit(False)),
        f"{p}few": few,
        f"{p}many": many,
    })
    t, c = F.col(f"{p}t"), F.col(f"{p}c")
    few, many = F.col(f"{p}few"), F.col(f"{p}many")
    drive = F.when(g >= 0.95, _largest(o, f, t, g)).otherwise(_largest(o, f, t))
    df = df.withColumn(f"{p}d", drive)
    d = F.col(f"{p}d")
    strong, anagram = (o >= 0.8) | (f >= 0.8), g >= 0.95
    apart = (j == 0) & (v == 0)
    best = F.greatest(o, f)
    # Each guard that holds takes nine tenths away; they add up.
    guards = [
        ~strong & ~anagram & ~c & apart & (o <= 0.5) & (f <= 0.5),
        ~strong & ~anagram & ~c & apart & (z >= 0.9) & (best < 0.55),
        ~c & apart & (z >= 0.9) & (o < 0.35),
        ~c & apart & (z >= 0.9) & (few == 1) & (many >= 2) & (best < 0.7),
        ~anagram & ~c & (j <= 0.2) & (z >= 0.5) & (o < 0.5) & (f < 0.8),
        ~strong & ~anagram & apart & (F.size(w1) == 1) & (F.size(w2) == 1),
    ]
    final = F.lit(0.4) * ((o + f + t + g) / 4) + F.lit(0.6) * d
    for guard in guards:
        final = final * F.when(guard, F.lit(0.1)).otherwise(F.lit(1.0))
    driver = (
        F.when(d == f, DRIVERS["fon"]).when(d == o, DRIVERS["orto"]).when((d == z) & (z > v), DRIVERS["fuzzy"])
        .when((d == v) & (v > j), DRIVERS["overlap"]).when(d == t, DRIVERS["token"]).otherwise(DRIVERS["none"])
    )
    made = F.struct(final.alias("final"), driver.alias("driver"), o.alias("orto"), f.alias("fon"), t.alias("token"), g.alias("anagram"), z.alias("fuzzy"), j.alias("jaccard"), v.alias("overlap"))
    return _settled(df, out, made).drop(*[x for x in df.columns if x.startswith(p)])


_FIELDS = ("final", "driver", "orto", "fon", "token", "anagram", "fuzzy")


def symmetric_score(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add the score of two raw names as a struct ``out``: the best of all readings and directions, with ``via``.

    Names without digits are read as they are, in both directions.  With a digit
    in either, one side at a time has its numbers spelled digit by digit or as
    cardinals.  The first of equals wins.  Null is the empty name.  Two names
    are scored once, however many rows hold them, in the readings that they have.
    """
    if df.isStreaming:
        return _symmetric_rowwise(df, left, right, out)
    p = f"__{out}_"
    keyed = df.withColumns({f"{p}l": F.coalesce(F.col(left), F.lit("")), f"{p}r": F.coalesce(F.col(right), F.lit(""))})
    a, b = F.col(f"{p}l"), F.col(f"{p}r")
    digits = has_digit(a) | has_digit(b)

    def reading(i: int, x: Column, y: Column, via: str) -> Column:
        return F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y"), F.lit(via).alias("via"))

    plain = F.array(reading(0, a, b, LITERAL), reading(1, b, a, LITERAL))
    spelled = F.array(reading(0, digits_as_words(a), b, LITERAL), reading(1, numbers_as_words(a), b, CARDINAL), reading(2, digits_as_words(b), a, LITERAL), reading(3, numbers_as_words(b), a, CARDINAL))
    tried = keyed.select(a, b).distinct().select(a, b, F.explode(F.when(digits, spelled).otherwise(plain)).alias("t")).select(a, b, F.col("t.i").alias("i"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.via").alias("via"))
    scored = directional_score(tried, "x", "y", "s")
    made = F.struct(*[F.col("s")[f].alias(f) for f in _FIELDS], F.col("via").alias("via"))
    best = scored.groupBy(a, b).agg(F.max_by(made, F.struct(F.col("s")["final"].alias("f"), (-F.col("i")).alias("i"))).alias(out))
    return keyed.join(best, [f"{p}l", f"{p}r"]).drop(f"{p}l", f"{p}r")


def _symmetric_rowwise(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``symmetric_score`` without an exchange, for streams: all four readings of each row stand side by side."""
    p = f"__{out}_"
    a, b = F.coalesce(F.col(left), F.lit("")), F.coalesce(F.col(right), F.lit(""))
    digits = has_digit(a) | has_digit(b)
    readings = [
        (F.when(digits, digits_as_words(a)).otherwise(a), b),
        (F.when(digits, numbers_as_words(a)).otherwise(b), F.when(digits, b).otherwise(a)),
        (F.when(digits, digits_as_words(b)), F.when(digits, a)),
        (F.when(digits, numbers_as_words(b)), F.when(digits, a)),
    ]
    for i, (x, y) in enumerate(readings):
        df = df.withColumns({f"{p}x{i}": x, f"{p}y{i}": y})
        df = directional_score(df, f"{p}x{i}", f"{p}y{i}", f"{p}s{i}")
    df = df.withColumn(f"{p}n", digits)
    tried = F.col(f"{p}n")
    score = lambda i: F.col(f"{p}s{i}")
    via = [F.lit(LITERAL), F.when(tried, F.lit(CARDINAL)).otherwise(F.lit(LITERAL)), F.lit(LITERAL), F.lit(CARDINAL)]
    # Readings that weren't made rank below all others; the first of equals is taken.
    finals = [F.when(F.lit(i < 2) | tried, score(i)["final"]).otherwise(F.lit(-1.0)) for i in range(4)]
    df = _settled(df, f"{p}top", F.array_max(F.array(*finals)))
    at = F.lit(3)
    for i in (2, 1, 0):
        at = F.when(finals[i] == F.col(f"{p}top"), F.lit(i)).otherwise(at)
    df = _settled(df, f"{p}at", at)
    best = F.array(*[score(i) for i in range(4)])[F.col(f"{p}at")]
    name = F.array(*via)[F.col(f"{p}at")]
    df = _settled(df, f"{p}best", F.struct(best.alias("s"), name.alias("via")))
    made = F.struct(*[F.col(f"{p}best.s")[f].alias(f) for f in _FIELDS], F.col(f"{p}best.via").alias("via"))
    return df.withColumn(out, made).drop(*[x for x in df.columns if x.startswith(p)])


def likeness(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add the score from 0 to 100; 0 if either name is empty or null."""
    df = symmetric_score(df, left, right, f"{out}_s")
    empty = (F.coalesce(F.col(left), F.lit("")) == "") | (F.coalesce(F.col(right), F.lit("")) == "")
    return df.withColumn(out, F.when(empty, F.lit(0.0)).otherwise(F.col(f"{out}_s")["final"] * 100)).drop(f"{out}_s")
