import pytest
from pyspark.sql import functions as F

from paronym.operators import features as ft
from paronym.operators import lookups as lk
from paronym.operators import models as md
from paronym.operators.bundle import Bundle, load_bundle, save_bundle, score_batch, score_pair, table_signature


def _features(df, _):
    return df.select("pair_id", "label", F.levenshtein("a", "b").cast("double").alias("f"), F.abs(F.col("class_a") - F.col("class_b")).cast("double").alias("g"))


def _made(spark):
    rows = [(i, "casa", "casa" if i % 3 == 0 else "vaso" * (i % 2 + 1), 1, 1 + i % 2, "", "", int(i % 3 == 0)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, a string, b string, class_a int, class_b int, spec_a string, spec_b string, label int")
    table = _features(pairs, None)
    scales = lk.scaler(table, ["f", "g"])
    ready = md.with_vector(lk.scaled(table, ["f", "g"], scales), ["f", "g"])
    return pairs, Bundle(ft.Fitted(lk.token_frequencies(pairs), lk.class_pair_priors(pairs), (1, 2), ("de",)), ["f", "g"], scales, md.bagging(ready, ready, ("logistica",), 2), 0.5), ready


def test_a_loaded_bundle_scores_as_the_saved_one(spark, tmp_path):
    pairs, bundle, ready = _made(spark)
    path = str(tmp_path / "b")
    save_bundle(spark, bundle, path)
    loaded = load_bundle(spark, path)
    want = {r.pair_id: r.score for r in bundle.ensemble.score(ready).select("pair_id", "score").collect()}
    got = {r.pair_id: r for r in score_batch(loaded, pairs, _features).collect()}
    assert {k: r.score for k, r in got.items()} == pytest.approx(want) and all(r.predicted == int(r.score >= 0.5) for r in got.values())
    assert loaded.fitted.classes == (1, 2) and loaded.fitted.stop_words == ("de",) and loaded.fitted.frequencies.count() == bundle.fitted.frequencies.count()
    assert score_pair(spark, loaded, "casa", "casa", 1, 1, features=_features).predicted == 1
    with pytest.raises(ValueError):
        score_pair(spark, loaded, " ", "x", features=_features)


def test_a_bundle_that_disagrees_with_its_manifest_is_refused(spark, tmp_path):
    _, bundle, _ = _made(spark)
    path = str(tmp_path / "b")
    save_bundle(spark, bundle, path)
    bundle.fitted.priors.limit(1).union(bundle.fitted.priors).write.mode("overwrite").parquet(f"{path}/priors")
    with pytest.raises(ValueError, match="priors"):
        load_bundle(spark, path)


def test_signature_takes_no_account_of_order_but_of_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert table_signature(df) == table_signature(df.select("y", "x").orderBy(F.desc("x")))
    assert table_signature(df) != table_signature(df.union(df))


def test_members_of_a_round_share_one_bootstrap(spark, monkeypatch):
    from paronym.operators import models as md

    drawn = []
    monkeypatch.setattr(md, "bootstrap", lambda df, key, share, seed: (drawn.append(seed), df)[1])
    df = md.with_vector(spark.createDataFrame([(i, i / 40, int(i % 7 > 3)) for i in range(40)], "pair_id int, f double, label int"), ["f"])
    assert len(md.bagging(df, df, ("logistica", "logistica"), members=2).members) == 4
    assert drawn == [42, 1042]
