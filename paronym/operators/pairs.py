"""The pair table: accepted headers, coercions, and what is known about a data set before anything is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required columns and the headers that a label may have.
REQUIRED = ["marca_monitorada", "marca_colidente", "classe_marca_monitorada", "classe_marca_colidente", "especificacao_monitorado", "especificacao_colidente"]
LABEL_HEADERS = [
    "Rótulo (1=manter, 0=outro)",
    "Rotulo (1=manter, 0=outro)",
    "Rótulo (1=semelhante, 0=não semelhante)",
    "Rotulo (1=semelhante, 0=nao semelhante)",
    "label",
    "rotulo",
    "Rótulo",
]
LABEL_PARTS = ("tulo", "label")


def label_column(columns: list[str]) -> str:
    """The column that holds the label: a known header, else one that contains part of one."""
    for name in LABEL_HEADERS:
        if name in columns:
            return name
    for name in columns:
        if any(part in name.lower() for part in LABEL_PARTS):
            return name
    raise ValueError("no label column")


def validate_columns(df: DataFrame) -> str:
    """The label's column; an error names required columns that are missing."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return label_column(df.columns)


def _whole(c: Column, otherwise: int) -> Column:
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(otherwise))


def clean_pairs(df: DataFrame, key: str | None = "pair_id") -> DataFrame:
    """``(pair_id, a, b, class_a, class_b, spec_a, spec_b, label)`` of the rows with two names.

    Names are trimmed, an unknown class is -1, a missing description empty, a
    label that isn't a number 0, others clipped to 0 and 1.  Without a key
    column rows get one from their content.
    """
    label = validate_columns(df)
    text = [c for c in REQUIRED if not c.startswith("classe")]
    ident = F.col(f"`{key}`") if key and key in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in REQUIRED], F.col(f"`{label}`"))
    held = df.where(F.col(text[0]).rlike("[^\\s\\p{Z}]") & F.col(text[1]).rlike("[^\\s\\p{Z}]"))
    return held.select(
        ident.alias("pair_id"),
        _trim(F.col(REQUIRED[0])).alias("a"),
        _trim(F.col(REQUIRED[1])).alias("b"),
        _whole(F.col(REQUIRED[2]), -1).alias("class_a"),
        _whole(F.col(REQUIRED[3]), -1).alias("class_b"),
        F.coalesce(F.col(REQUIRED[4]), F.lit("")).alias("spec_a"),
        F.coalesce(F.col(REQUIRED[5]), F.lit("")).alias("spec_b"),
        F.greatest(F.lit(0), F.least(F.lit(1), _whole(F.col(f"`{label}`"), 0))).alias("label"),
    )


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r"))


def dropped_rows(df: DataFrame) -> DataFrame:
    """``(rows, kept, dropped)`` of the cleaning, in one pass."""
    usable = F.coalesce(F.col(REQUIRED[0]).rlike("[^\\s\\p{Z}]") & F.col(REQUIRED[1]).rlike("[^\\s\\p{Z}]"), F.lit(False))
    return df.agg(F.count("*").alias("linhas"), F.coalesce(F.sum(usable.cast("int")), F.lit(0)).alias("mantidas"), F.coalesce(F.sum((~usable).cast("int")), F.lit(0)).alias("descartadas"))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: counts, positive rates overall, with equal and with different classes, share of equal classes."""
    same = F.col("class_a") == F.col("class_b")
    y = F.col("label")
    return pairs.agg(
        F.count("*").alias("pares"), F.coalesce(F.sum(y), F.lit(0)).alias("positivos"), F.avg(y).alias("taxa"),
        F.avg(F.when(same, y)).alias("taxa_mesma_classe"), F.avg(F.when(~same, y)).alias("taxa_outra_classe"), F.avg(same.cast("int")).alias("parte_mesma_classe"),
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(coluna, nulos)``."""
    one = df.agg(*[F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"n{i}").alias("nulos")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length of each text column: mean, sample deviation, extremes and exact quartiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.length(F.col(f"`{c}`")).alias("n")) for c in columns])).alias("x")).select("x.*")
    n = F.col("n").cast("double")
    return long.groupBy("coluna").agg(
        F.avg(n).alias("media"), F.stddev_samp(n).alias("desvio"), F.min(n).alias("minimo"), F.percentile(n, F.lit(0.25)).alias("p25"),
        F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.75)).alias("p75"), F.max(n).alias("maximo"),
    )


def class_counts(pairs: DataFrame) -> DataFrame:
    """``(classe, n)`` over both class columns, known classes only."""
    both = pairs.select(F.explode(F.array("class_a", "class_b")).alias("classe"))
    return both.where("classe >= 0").groupBy("classe").agg(F.count("*").alias("n"))


def top_classes(pairs: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent classes, the smaller number first of equals."""
    return class_counts(pairs).orderBy(F.desc("n"), "classe").limit(k)
