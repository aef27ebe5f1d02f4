import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paronym.functions.arrow import stem
from paronym.functions.term_vectors import char_grams, itself, text_cosines
from paronym.operators import features as ft
from paronym.operators import lookups as lk

TEXTS = [("roupas; bolsas", "roupas"), ("roupas; bolsas", "roupas; sapatos"), ("roupas; bolsas", "sapatos"), ("sapatos; vasos", "vasos; roupas"), ("vasos", "sapatos"), ("zebra", "zebra")]


FITTED = ft.Fitted(None, None, ())


def _stems(text):
    return " ".join(stem(w) for w in text.replace(";", " ").split())


def _pairs(spark, form=lambda t: t):
    return spark.createDataFrame([(i, form(a), form(b), "nome um", "nome dois") for i, (a, b) in enumerate(TEXTS)], "pair_id int, spec_a string, spec_b string, a string, b string")


@pytest.mark.parametrize("name,terms", [("spec_cosine_tfidf_word", lk.word_terms), ("spec_cosine_tfidf_char", lk.char_terms)])
def test_cosines_of_the_feature_table_count_every_copy(spark, name, terms):
    pairs = _pairs(spark, _stems)
    sides = [pairs.select(F.concat(F.col("pair_id").cast("string"), F.lit(s)).alias("ident"), F.col(f"spec_{s}").alias("spec")) for s in "ab"]
    _, vectors = lk.tfidf(sides[0].unionByName(sides[1]), "ident", terms("spec"))
    named = pairs.select("pair_id", F.concat(F.col("pair_id").cast("string"), F.lit("a")).alias("l"), F.concat(F.col("pair_id").cast("string"), F.lit("b")).alias("r"))
    whole = {r.pair_id: r.cosine for r in lk.vector_cosines(named, "pair_id", "l", "r", vectors).collect()}
    forms, specs, fitted = ft.prepared(_pairs(spark), FITTED)
    made = {r.pair_id: r[name] for r in ft.cosine_block(forms, specs, fitted).collect()}
    assert made == pytest.approx({i: whole.get(i, 0.0) for i in made}) and made[0] > 0


def _grams(text):
    out = Counter()
    for w in (f" {w} " for w in text.lower().split()):
        for n in (3, 4, 5):
            if n == 3 or len(w) >= n:
                out.update([w[i : i + n] for i in range(max(len(w) - n + 1, 1))])
    return out


def test_items_are_weighted_by_the_vocabulary_of_all_descriptions(spark):
    texts = [_stems(t) for pair in TEXTS for t in pair]
    df = Counter(g for t in texts for g in _grams(t))
    idf = {g: math.log((len(texts) + 1) / (n + 1)) + 1 for g, n in df.items() if n >= 3}

    def vector(item):
        raw = {g: (math.log(n) + 1) * idf[g] for g, n in _grams(item).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {g: x / norm for g, x in raw.items()}

    expected = {}
    for i, (a, b) in enumerate(TEXTS):
        cells = sorted((sum(w * vector(y).get(g, 0.0) for g, w in vector(x).items()) for x in map(stem, a.split("; ")) for y in map(stem, b.split("; "))), reverse=True)
        if cells[0]:
            expected[i] = (cells[0], sum(cells[:3]) / len(cells[:3]))
    found = {r.pair_id: (r.best, r.top3) for r in ft.item_matches(_pairs(spark), FITTED).collect()}
    assert 5 not in found and set(found) == set(expected)  # 'zebra' stands in two texts only
    for i, both in expected.items():
        assert found[i] == pytest.approx(both)


def test_hashed_vectors_are_stable_and_near_for_near_texts(spark):
    from paronym.functions.arrow import gram_vector, hashed_vector
    from paronym.functions.similarity import cosine

    df = spark.createDataFrame([("botas de couro", "botas de couros", "tintas"), ("", None, "x")], "a string, b string, c string")
    held = df.select("a", hashed_vector(F.col("a"), unit=True).alias("u"), hashed_vector(F.col("b")).alias("v"), hashed_vector(F.col("c")).alias("w"))
    near, blank = held.select("a", cosine(F.col("u"), F.col("v")).alias("n"), cosine(F.col("u"), F.col("w")).alias("f"), F.col("v")[0].alias("z")).orderBy(F.desc("a")).collect()
    assert near.n > 0.8 > 0.3 > near.f and (blank.n, blank.f, blank.z) == (0.0, 0.0, 0.0)
    assert (gram_vector("botas", 64) == gram_vector(" botas ", 64)).all()


def test_cosines_without_rows_for_terms_equal_those_by_joins(spark, tmp_path):
    words = ["casa", "ção", "ab", "x", "𝒳y", "botões", "a/b", "21"]
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(i % 7)), " ".join(words[(i + k) % 8] for k in range(i % 5)) + ("  casa" * (i % 3))) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, sa string, sb string")
    for units, terms, counted in ((lk.word_terms, itself, lk.word_terms), (lk.char_words, char_grams, lk.char_terms)):
        docs = pairs.select(F.concat("pair_id", F.lit("a")).alias("ident"), F.col("sa").alias("spec")).union(pairs.select(F.concat("pair_id", F.lit("b")), "sb"))
        vocabulary, vectors = lk.tfidf(docs, "ident", counted("spec"), max_terms=20)
        named = pairs.select("pair_id", F.concat("pair_id", F.lit("a")).alias("l"), F.concat("pair_id", F.lit("b")).alias("r"))
        joined = {r.pair_id: r.cosine for r in lk.vector_cosines(named, "pair_id", "l", "r", vectors).collect()}
        cut = pairs.select("pair_id", units("sa").alias("ua"), units("sb").alias("ub"))
        fitted = lk.fitted_vocabulary(cut.select(F.explode(F.array("ua", "ub")).alias("u")), "u", terms, max_terms=20)
        assert sorted(map(tuple, fitted.collect())) == sorted(map(tuple, vocabulary.collect()))
        found = {r.pair_id: r.cosine for r in text_cosines(cut, "pair_id", "ua", "ub", fitted, terms).collect()}
        assert len(found) == 60 and found == pytest.approx({i: joined.get(i, 0.0) for i in range(60)})


def test_cosine_queries_join_no_term_rows(spark):
    for name in ("tfidf_char_cosine", "tfidf_word_cosine"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan


def test_item_matches_shuffle_no_pair(spark):
    chars = lk.fitted_vocabulary(spark.createDataFrame([(["bols", "vas"],)] * 3, "u array<string>"), "u", char_grams)
    rows = [(0, "bolsas; ;vasos\nbolsas", "vasos; 12", ""), (1, "bolsas;" * 40 + "vasos", "vasos;zebra" * 30, ""), (2, "", "bolsas", ""), (3, "zebra", "zebra", ""), (4, "bolsas; vasos", "vasos; bolsas", "")]
    df = spark.createDataFrame(rows, "pair_id bigint, spec_a string, spec_b string, x string")
    made = ft.item_matches(df, ft.Fitted(None, None, (), chars=chars))
    assert "Join" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    found = {r.pair_id: (r.best, r.top3, r.aligned) for r in made.collect()}
    assert set(found) == {0, 1, 4}
    assert found[0] == pytest.approx((1, 1 / 3, 1)) and found[4] == pytest.approx((1, 2 / 3, 1))


def test_stems_of_descriptions_need_no_join(spark):
    made = ft.with_stems(spark.createDataFrame([("roupas; bolsas", ""), ("", "12; roupas roupas")], "spec_a string, spec_b string"), FITTED)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.sa_toks, r.sb_toks) for r in made.collect()] == [([stem("roupas"), stem("bolsas")], []), ([], [stem("roupas")] * 2)]


def test_cosines_of_hashed_vectors_make_no_vector_column(spark):
    from functools import partial

    from paronym.functions.arrow import gram_vector, gram_vectors, hashed_vector

    texts = ["", "  ", "a", "botas", " botas de couro ", "ção 𝒳y", "x" * 300, "\ud800z", *(f"marca {i}" for i in range(40))]
    assert (gram_vectors(texts, 64) == [gram_vector(t, 64) for t in texts]).all()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts[:7] + [None], texts[1:7] + ["botas", "a"]))], "pair_id int, a string, b string")
    for unit in (False, True):
        own = ft._vector_cosines(df, hashed_vector, F.col("a"), F.col("b"), "c", "n", unit)
        assert "array" not in own._jdf.queryExecution().optimizedPlan().toString()
        other = ft._vector_cosines(df, partial(hashed_vector), F.col("a"), F.col("b"), "c", "n", unit)
        found, known = ({r.pair_id: (r.c, r.n) for r in d.collect()} for d in (own, other))
        assert set(found) == set(known) and all(found[i] == pytest.approx(known[i], abs=1e-6) for i in known)


def test_words_of_a_text_are_found_once(spark):
    df = spark.createDataFrame([("Casa de ção 21 x",), ("casa",), ("",), (None,)], "t string")
    made = df.select(lk.word_terms("t").alias("w"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.w for r in made.collect()] == [["casa", "de", "ção", "21", "casa de", "de ção", "ção 21"], ["casa"], [], None]
