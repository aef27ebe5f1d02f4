"""Queries of features and models, whose results SQL can't repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import features as ft
from ..operators import lookups as lk
from ..operators import models as md
from ..operators import pairs as pr
from ..operators.bundle import Bundle, load_bundle, save_bundle, score_batch
from ..operators.sampling import stratified_split
from ..session import cut_lineage, scratch_path
from ..sources import io
from ..sources.tables import table
from .pair_queries import clean

SQL: dict[str, str] = {}
COLUMNS = ["orto", "fon", "anagrama", "bigramas", "palavras", "mesma_classe"]


def simple_features(pairs: DataFrame) -> DataFrame:
    """A narrow feature table for the models' queries."""
    a, b = F.col("a"), F.col("b")
    made = pairs.select("pair_id", "label", tx.strict_form(a).alias("x"), tx.strict_form(b).alias("y"), tx.base_form(a).alias("nx"), tx.base_form(b).alias("ny"), (F.col("class_a") == F.col("class_b")).cast("double").alias("mesma_classe"))
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
    return made.select(
        "pair_id", "label", sim.edit_similarity(x, y).alias("orto"), sim.phonetic_similarity(nx, ny).alias("fon"), sim.anagram_similarity(nx, ny).alias("anagrama"),
        sim.jaccard(tx.char_ngrams(x, 2), tx.char_ngrams(y, 2)).alias("bigramas"), sim.jaccard(tx.tokens(nx), tx.tokens(ny)).alias("palavras"), "mesma_classe",
    )


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the three splits with a vector; scales come from the training rows alone."""
    rows = _split_rows(clean(spark, folder))
    return _ready(rows, lk.scaler(rows.where("split = 'treino'"), COLUMNS))


def _split_rows(pairs: DataFrame) -> DataFrame:
    """Features and split of every pair, written once."""
    return cut_lineage(stratified_split(simple_features(pairs), "pair_id", "label"))


def _ready(rows: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    ready = cut_lineage(md.with_vector(lk.scaled(rows, COLUMNS, scales), COLUMNS))
    return tuple(ready.where(F.col("split") == s).drop("split") for s in ("treino", "validacao", "teste"))


def model_bagging(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated mean of bagged members on the test rows."""
    train, validation, test = _prepared(spark, folder)
    made = md.bagging(train, validation, members=3)
    return made.score(test).select("pair_id", "label", F.round("score", 6).alias("score"))


def reloaded_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of ``model_bagging`` by members that were saved and loaded again, with lookups and scales."""
    pairs = clean(spark, folder)
    rows = _split_rows(pairs)
    scales = cut_lineage(lk.scaler(rows.where("split = 'treino'"), COLUMNS))
    train, validation, _ = _ready(rows, scales)
    made = Bundle(ft.Fitted(lk.token_frequencies(pairs), lk.class_pair_priors(pairs), ()), COLUMNS, scales, md.bagging(train, validation, members=3), 0.5)
    path = scratch_path(spark)
    save_bundle(spark, made, path)
    test = pairs.join(rows.where("split = 'teste'").select("pair_id"), "pair_id")
    scored = score_batch(load_bundle(spark, path), test, lambda d, _: simple_features(d))
    return scored.join(pairs.select("pair_id", "label"), "pair_id").select("pair_id", "label", F.round("score", 6).alias("score"))


def model_perceptron(spark: SparkSession, folder: str) -> DataFrame:
    train, validation, test = _prepared(spark, folder)
    made = md.bagging(train, validation, ("rede",), 3, inputs=len(COLUMNS))
    return made.score(test).select("pair_id", "label", F.round("score", 6).alias("score"))


def model_stacking(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-fitted scores of the model on top of the members."""
    train, validation, _ = _prepared(spark, folder)
    return md.stacked(md.bagging(train, validation, members=3), validation, COLUMNS)[1]


def model_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of average precision by permuted column."""
    train, validation, test = _prepared(spark, folder)
    member = md.logistic_member(train.withColumn("label", F.col("label").cast("double")), 42)
    rows = test.select("pair_id", F.col("label").alias("y"), *COLUMNS)
    return md.permutation_importance(lambda d: member.score(md.with_vector(d, COLUMNS), "score"), rows, COLUMNS, repeats=3)


def model_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each feature in each test row's score, against the mean row."""
    train, _, test = _prepared(spark, folder)
    member = md.logistic_member(train.withColumn("label", F.col("label").cast("double")), 42)
    return md.linear_attribution(member, test, COLUMNS, dict.fromkeys(COLUMNS, 0.0))


def _fitted(pairs: DataFrame) -> ft.Fitted:
    top = tuple(r.classe for r in pr.top_classes(pairs).collect())  # 15 rows
    return ft.Fitted(lk.token_frequencies(pairs), lk.class_pair_priors(pairs), top, tuple(ft.stop_words()))


def enriched_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All features of every pair."""
    pairs = clean(spark, folder)
    return ft.enriched(pairs, _fitted(pairs)).drop("a", "b", "spec_a", "spec_b")


def item_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Best, mean of the three best and aligned cosines of the items of both descriptions."""
    pairs = clean(spark, folder)
    return ft.item_matches(pairs.select("pair_id", "spec_a", "spec_b"), _fitted(pairs))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return io.file_hashes(spark, f"{folder}/marca_pares.parquet").select("sha256", "length")


def case_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The stored debug records scored again, with both scores."""
    from ..functions.composite import symmetric_score

    rows = table(spark, folder, "depuracao").select("debug_id", "m1", "m2", F.col("res.final").alias("guardado"), "gerado_em")
    return symmetric_score(rows, "m1", "m2", "s").select("debug_id", "gerado_em", F.round("guardado", 6).alias("guardado"), F.round("s.final", 6).alias("final"), "s.driver")


QUERIES = {f.__name__: f for f in (model_bagging, reloaded_scores, model_perceptron, model_stacking, model_importance, model_attribution, enriched_pairs, item_matches, file_hashes, case_scores)}
