"""Sources and sinks: pair tables and cases in several formats, run folders with a registry, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = "m1 string, m2 string"
DEBUG = "m1 string, m2 string, res struct<driver: string, final: double, via: string, vetores: struct<anagram: double, fon: double, fuzzy: double, orto: double, token: double>>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A pair table from parquet, CSV with a header (quoted fields may hold line breaks), JSON lines or ORC, by its ending."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith(".orc"):
        return spark.read.orc(path)
    if path.endswith((".xlsx", ".xls")):
        raise ValueError("Spark reads no spreadsheets; export them as CSV or parquet")
    return spark.read.parquet(path)


def read_cases(spark: SparkSession, path: str, debug: bool = False) -> DataFrame:
    """Cases, or debug records, from a file that holds one JSON array."""
    return spark.read.option("multiLine", True).schema(DEBUG if debug else CASES).json(path)


def write_cases(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of each file; the identity of a data set."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_run(df: DataFrame, root: str, run_id: str, name: str = "enriched") -> None:
    """A table of a run as ``root/name/run_id=...``; a run written again replaces itself only."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")


def read_runs(spark: SparkSession, root: str, name: str = "enriched") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def registry(runs: DataFrame, keep: int = 120) -> DataFrame:
    """Newest entry of each ``run_id``, newest first, ``keep`` of them."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("saved_at"))
    last = runs.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    return last.orderBy(F.desc("saved_at"), "run_id").limit(keep)


def write_errors(df: DataFrame, path: str) -> None:
    """Errors as CSV with a header, UTF-8 without a byte order mark."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def stamped(df: DataFrame, score: str, threshold: float, version: str) -> DataFrame:
    """Add the predicted class, threshold, UTC time and version, and put the label last."""
    made = df.withColumns({
        "predicted": (F.col(score) >= threshold).cast("int"), "threshold": F.lit(threshold),
        "scored_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "version": F.lit(version),
    })
    return made.select(*[c for c in made.columns if c != "label"], *[c for c in made.columns if c == "label"])


def cached_values(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with their cached value, and the distinct texts that the cache misses."""
    wanted = texts.select(text).distinct()
    return texts.join(cache, text, "left"), wanted.join(cache.select(text), text, "left_anti")
