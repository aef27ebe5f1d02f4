"""What was fitted, saved and loaded again: lookups and scales as parquet, members as ML writers keep them, and a manifest that is checked.

A loaded bundle scores tables of pairs, or one pair, without the data on which
it was fitted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .features import Fitted, enriched, feature_names
from .lookups import scaled
from .models import Ensemble, Member, with_vector

VERSION = 1
_KINDS = {c.__name__: c for c in (LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel)}
_TABLES = ("frequencies", "priors", "words", "chars")
_PAIR = "pair_id bigint, a string, b string, class_a int, class_b int, spec_a string, spec_b string, label int"

#: Gives the feature table of pairs; the default is all blocks.
Features = Callable[[DataFrame, Fitted], DataFrame]


@dataclass
class Bundle:
    """Lookups, the columns in their order, their scales, the members, and the threshold from which a pair counts as positive."""

    fitted: Fitted
    columns: list[str]
    scales: DataFrame
    ensemble: Ensemble
    threshold: float


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Write a bundle; the manifest comes last, so a folder without one is unfinished."""
    rows = {}
    for name in _TABLES:
        held = getattr(bundle.fitted, name)
        if held is not None:
            held.write.mode("overwrite").parquet(f"{path}/{name}")
            rows[name] = spark.read.parquet(f"{path}/{name}").count()
    bundle.scales.write.mode("overwrite").parquet(f"{path}/scales")
    members = []
    for m in bundle.ensemble.members:
        m.model.write().overwrite().save(f"{path}/members/{m.name}")
        members.append({"name": m.name, "kind": type(m.model).__name__, "slope": m.slope, "shift": m.shift})
    manifest = {"version": VERSION, "columns": bundle.columns, "classes": list(bundle.fitted.classes), "stop_words": list(bundle.fitted.stop_words), "threshold": bundle.threshold, "members": members, "rows": rows}
    _write_text(spark, json.dumps(manifest), f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read a bundle; an error names what doesn't agree with its manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)
    if manifest["version"] != VERSION:
        raise ValueError(f"bundle of version {manifest['version']}, this library reads {VERSION}")
    tables = {}
    for name, rows in manifest["rows"].items():
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if (found := tables[name].count()) != rows:
            raise ValueError(f"{name} has {found} rows, its manifest says {rows}")
    scales = spark.read.parquet(f"{path}/scales")
    missing = set(manifest["columns"]) - {r["column"] for r in scales.select("column").collect()}  # a row a column
    if missing:
        raise ValueError(f"no scales for {', '.join(sorted(missing))}")
    members = [Member(m["name"], _KINDS[m["kind"]].load(f"{path}/members/{m['name']}"), m["slope"], m["shift"]) for m in manifest["members"]]
    fitted = replace(Fitted(None, None, tuple(manifest["classes"]), tuple(manifest["stop_words"])), **tables)
    return Bundle(fitted, manifest["columns"], scales, Ensemble(members), manifest["threshold"])


def score_batch(bundle: Bundle, pairs: DataFrame, features: Features = enriched) -> DataFrame:
    """``(pair_id, score, predicted)`` of pairs as ``clean_pairs`` gives them."""
    rows = with_vector(scaled(features(pairs, bundle.fitted), bundle.columns, bundle.scales), bundle.columns)
    return bundle.ensemble.score(rows.select("pair_id", "features")).select("pair_id", "score", (F.col("score") >= bundle.threshold).cast("int").alias("predicted"))


def score_pair(spark: SparkSession, bundle: Bundle, a: str | None, b: str | None, class_a: int | None = None, class_b: int | None = None, spec_a: str | None = None, spec_b: str | None = None, features: Features = enriched) -> Row:
    """Score and predicted class of one pair; a blank name is an error."""
    if not (a or "").strip() or not (b or "").strip():
        raise ValueError("both names are needed")
    one = [(0, a.strip(), b.strip(), -1 if class_a is None else class_a, -1 if class_b is None else class_b, spec_a or "", spec_b or "", 0)]
    return score_batch(bundle, spark.createDataFrame(one, _PAIR), features).select("score", "predicted").first()


def table_signature(df: DataFrame) -> str:
    """The same for the same rows in any order: their number and the sums of two hashes of each."""
    columns = sorted(df.columns)
    hashed = [F.xxhash64(F.lit(s), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]) for s in (1, 2)]
    r = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"h{i}") for i, h in enumerate(hashed)]).first()
    return f"{r.n}:{r.h0}:{r.h1}:{','.join(columns)}"


def cached_features(pairs: DataFrame, fitted: Fitted, path: str) -> tuple[DataFrame, bool]:
    """All features, from the cache at ``path`` if it was made of the same pairs and columns, else computed and written there; and whether it was."""
    spark = pairs.sparkSession
    wanted = {"version": VERSION, "signature": table_signature(pairs), "columns": feature_names(fitted.classes)}
    try:
        held = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)
    except Exception:  # no cache, or one that isn't whole: made again
        held = None
    if held == wanted:
        return spark.read.parquet(f"{path}/features"), True
    enriched(pairs, fitted).write.mode("overwrite").parquet(f"{path}/features")
    _write_text(spark, json.dumps(wanted), f"{path}/manifest")
    return spark.read.parquet(f"{path}/features"), False
