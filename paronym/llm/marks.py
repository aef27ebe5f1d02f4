"""The marks of the pair table in plain and folded form, as most operators on pairs start from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .plain_form import folded, is_usable, plain_columns, plain_forms

MARKS = ["marca_monitorada", "marca_colidente"]


def usable_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of marca_pares in which neither mark is null or blank."""
    return table(spark, folder, "marca_pares").where(is_usable(*MARKS))


def plain_marks(spark: SparkSession, folder: str) -> DataFrame:
    """``(pair_id, field, value, plain)`` of both marks of every usable pair."""
    return plain_forms(usable_pairs(spark, folder), ["pair_id"], MARKS)


def folded_pairs(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """``(pair_id, *more, a, b)``: folded forms of the monitored and the colliding mark of every usable pair, and other columns of it."""
    plain = plain_columns(usable_pairs(spark, folder), ["pair_id", *more], MARKS)
    return plain.select("pair_id", *more, folded(F.col(MARKS[0])).alias("a"), folded(F.col(MARKS[1])).alias("b"))
