import pytest
from pyspark.sql import functions as F

from paronym.operators import features as ft
from paronym.operators import lookups as lk
from paronym.operators import metrics as mt
from paronym.operators import models as md
from paronym.operators import pairs as pr
from paronym.operators import sampling as sp
from paronym.sources import io
from paronym.streaming.scoring import score_stream, windowed_counts

SCORED = "pair_id int, y int, score double"


def _scored(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], SCORED)


def test_ranking_metrics_with_ties(spark):
    df = _scored(spark, [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.1)])
    assert mt.roc_auc(df).first()[0] == pytest.approx((2.5 + 2) / 6)
    assert mt.average_precision(df).first()[0] == pytest.approx((0.5 + 2 / 3) / 2)
    r = mt.confusion(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 0, 2) and r.f1 == pytest.approx(0.8)


def test_metrics_of_one_class_and_of_nothing(spark):
    one = _scored(spark, [(1, 0.3), (1, 0.3)])
    assert mt.roc_auc(one).first()[0] == 0.5 and mt.average_precision(one).first()[0] == 1.0
    none = _scored(spark, [])
    assert mt.roc_auc(none).first()[0] == 0.5 and mt.average_precision(none).first()[0] == 0.0
    assert mt.confusion(none, 0.5).first().precision == 0.0 and mt.deciles(none).count() == 0


def test_threshold_grid_equals_direct_counts(spark):
    rows = [(i % 3 == 0, round(i * 0.013 % 1.1, 3)) for i in range(200)] + [(1, 0.29), (0, 0.57), (1, 0.05), (0, 0.95)]
    rows = [(int(y), s) for y, s in rows]
    for r in mt.threshold_grid(_scored(spark, rows)).collect():
        assert (r.tp, r.fp) == (sum(y for y, s in rows if s >= r.threshold), sum(1 - y for y, s in rows if s >= r.threshold))


def test_verdict_colours(spark):
    df = spark.createDataFrame([(0.95, 0.7, 0.9, 0.5, 0.1), (0.85, 0.5, 0.9, 0.5, 0.1), (0.95, 0.7, 0.9, 0.5, 0.4)], "roc_auc double, average_precision double, recall double, f1 double, fn_share double")
    assert [r.veredito for r in mt.verdict(df).collect()] == ["pronto", "monitorar", "não recomendado"]


def test_splits_are_whole_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("pair_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = sp.stratified_split(df, "pair_id", "label").orderBy("pair_id").collect()
    assert a == sp.stratified_split(df.repartition(7), "pair_id", "label").orderBy("pair_id").collect()
    assert sum(r.split == "teste" for r in a) == 150 and sum(r.split == "teste" and r.label for r in a) == 15
    assert sp.undersampled(df, "pair_id", "label").count() == 400
    assert sp.oversampled(df, "pair_id", "label").groupBy("label").count().orderBy("label").collect()[1]["count"] == 900
    assert sp.undersampled(df.where("label = 0"), "pair_id", "label").count() == 900
    assert sp.bootstrap(df.limit(12), "pair_id", 0.1).count() == 12


def test_label_headers():
    assert pr.label_column(["a", "Rótulo (1=manter, 0=outro)"]).startswith("Rótulo") and pr.label_column(["x", "Titulo"]) == "Titulo"
    with pytest.raises(ValueError):
        pr.label_column(["a"])


def _pairs(spark, n=24):
    rows = [(i, f"Casa {['Azul', 'Verde', 'Nova 2'][i % 3]}", f"casa {['azull', 'vermelha', 'nova dois'][i % 3]} {'modas' * (i % 2)}", 35 if i % 4 else -1, 35 - i % 3, "roupas; sapatos de couro" if i % 5 else "", "venda de roupas\nbolsas", i % 2) for i in range(n)]
    rows.append((n, "*", "x", 1, 2, "", "", 0))
    return spark.createDataFrame(rows, "pair_id int, a string, b string, class_a int, class_b int, spec_a string, spec_b string, label int")


def test_feature_table_has_all_columns_and_no_nulls(spark):
    pairs = _pairs(spark)
    classes = tuple(range(1, 16))
    made = ft.enriched(pairs, ft.Fitted(lk.token_frequencies(pairs), lk.class_pair_priors(pairs), classes))
    names = ft.feature_names(classes)
    assert len(names) == len(set(names)) == 162 and made.columns == [*pairs.columns, *names]
    rows = made.collect()
    assert len(rows) == 25 and all(r[n] is not None for r in rows for n in names)
    one = next(r for r in rows if r.pair_id == 24)
    assert (one.graf_levenshtein, one.n_tokens_a, one.cls_diff_abs, one.cls_pair_prior_pos) == (0.0, 0.0, 1.0, 2 / 11)


def test_models_calibration_and_stacking(spark):
    rows = [(i, (i * 37 % 100) / 100, (i * 53 % 100) / 100, int((i * 37 % 100) > 60)) for i in range(300)]
    df = md.with_vector(spark.createDataFrame(rows, "pair_id int, f double, g double, label int"), ["f", "g"])
    made = md.bagging(df, df, members=1)
    scored = made.score(df).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(made.members) == 2
    assert sum((r.score > 0.5) == (r.label == 1) for r in scored) > 270
    _, held = md.stacked(made, df, ["f", "g"])
    assert held.count() == 300
    member = md.logistic_member(df.withColumn("label", F.col("label").cast("double")), 1)
    drop = {r.feature: r.importance for r in md.permutation_importance(lambda d: member.score(md.with_vector(d, ["f", "g"]), "score"), df.select("pair_id", F.col("label").alias("y"), "f", "g"), ["f", "g"], repeats=1).collect()}
    assert drop["f"] > 0.1 > abs(drop["g"])
    assert md.platt(_scored(spark, [(1, 0.2), (1, 0.9)])) == (1.0, 0.0)


def test_sources_and_sinks(spark, tmp_path):
    cases = tmp_path / "cases.json"
    cases.write_text('[{"m1": "a", "m2": "b"}, {"m1": "ção", "m2": null}]', encoding="utf-8")
    assert [tuple(r) for r in io.read_cases(spark, str(cases)).collect()] == [("a", "b"), ("ção", None)]
    assert len(io.file_hashes(spark, str(cases)).first().sha256) == 64
    df = spark.createDataFrame([(1, 'a "q"\nb', 1)], "pair_id int, t string, label int")
    io.write_errors(df, str(tmp_path / "e.csv"))
    assert io.read_pairs(spark, str(tmp_path / "e.csv")).first().t == 'a "q"\nb'
    for run in ("r1", "r2", "r2"):
        io.write_run(df, str(tmp_path / "runs"), run)
    assert io.read_runs(spark, str(tmp_path / "runs")).count() == 2
    runs = spark.createDataFrame([("a", "2024"), ("a", "2025"), ("b", "2023")], "run_id string, saved_at string")
    assert [tuple(r) for r in io.registry(runs, keep=1).collect()] == [("a", "2025")]
    assert io.stamped(df.withColumn("s", F.lit(0.7)), "s", 0.5, "1").columns[-1] == "label"
    with pytest.raises(ValueError):
        io.read_pairs(spark, "x.xlsx")


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    rows = [("Casa Azul", "casa azull", "2024-01-01 10:00:00"), ("a", "zz", "2024-01-01 10:30:00")]
    df = spark.createDataFrame(rows, "m1 string, m2 string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, threshold=80.0).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = sorted((r.m1, r.likeness, r.reached) for r in score_stream(df, threshold=80.0).collect())
    assert sorted((r.m1, r.likeness, r.reached) for r in spark.table("scored").collect()) == batch
    assert windowed_counts(score_stream(df), "at").count() == 1
