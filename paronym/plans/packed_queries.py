"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed_values import explode_packed, score_delimiters
from ..sources.tables import table

FIELDS = ["especificacao_monitorado", "especificacao_colidente"]


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of both specification fields."""
    made = explode_packed(table(spark, folder, "marca_pares"), "pair_id", FIELDS, "fonte")
    return made.select(F.col("key").alias("pair_id"), F.col("field").alias("campo"), F.col("position").alias("posicao"), F.col("value").alias("valor"), F.col("count").alias("valores"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_values(spark, folder).where("valores > 1").drop("valores")


def p2_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the candidate delimiters by source."""
    return score_delimiters(table(spark, folder, "marca_pares"), "fonte", FIELDS)


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p2_delimiters": p2_delimiters}

SQL: dict[str, str] = {}
