import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paronym.functions import arrow as ar
from paronym.functions import similarity as sim
from paronym.functions import text as tx
from paronym.functions.composite import CARDINAL, _symmetric_rowwise, likeness, symmetric_score


def _one(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_forms_of_edge_cases(spark):
    x = F.col("x")
    out = _one(spark, [None, "", "  ", "Ação & Cia.", "ß ø", "aab  b", "04", "100", "2024", "200 a", "015"], tx.base_form(x), tx.strict_form(x), tx.base_form(tx.numbers_as_words(x)), tx.base_form(tx.digits_as_words(x)))
    assert out[0] == out[1] == out[2] == ("", "", "", "")
    assert out[3][:2] == ("acao cia", "acaocia") and out[4][0] == "" and out[5][:2] == ("aab b", "ab b".replace(" ", ""))
    assert [r[2] for r in out[6:]] == ["quatro", "cem", "dois mil e vinte quatro", "doiscentos a", "quinze"]
    assert out[10][3] == "zero um cinco"


@pytest.mark.parametrize("word,key", [("pharmacia", "FRMS"), ("farmacia", "FRMS"), ("chave", "XV"), ("quilo", "KL"), ("", ""), ("aki", "AK"), ("aqui", "AK")])
def test_phonetic_keys(spark, word, key):
    assert _one(spark, [word], tx.phonetic_key(F.col("x"))) == [(key,)]


def test_scores_of_known_pairs(spark):
    rows = [("barbatto", "barbato"), ("caravvvela", "caravela"), ("pharmacia", "farmácia"), ("bionova", "novabio"), ("axys", "axis consultoria"), ("casa 100", "casa cem"), ("", "x"), (None, "x"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m1 string, m2 string")
    s = [r.s for r in symmetric_score(df, "m1", "m2", "s").orderBy("i").collect()]
    assert s == [r.s for r in _symmetric_rowwise(df, "m1", "m2", "s").orderBy("i").collect()]  # what streams take
    assert s[0]["final"] == pytest.approx(1.0) and s[1]["final"] == pytest.approx(1.0)
    assert s[2]["final"] > 0.9 and s[3]["final"] >= 0.6 and s[4]["final"] > 0.5
    assert s[5]["final"] == pytest.approx(1.0) and s[5]["via"] == CARDINAL
    out = [r.v for r in likeness(df, "m1", "m2", "v").orderBy("i").collect()]
    assert out[6:] == [0.0, 0.0, 0.0] and all(0 <= v <= 100.0001 for v in out)


def test_sets_and_vectors(spark):
    df = spark.sql("SELECT array() AS e, array('a','b') AS p, array('b','c','b') AS q, array(1.0, 0.0) AS u, array(0.0, 0.0) AS z")
    r = df.select(sim.jaccard(F.col("e"), F.col("e")), sim.jaccard(F.col("p"), F.col("q")), sim.overlap(F.col("e"), F.col("p")), sim.overlap(F.col("p"), F.col("q")), sim.cosine(F.col("u"), F.col("z")), sim.cosine(F.col("u"), F.col("u"))).first()
    assert list(r) == pytest.approx([1.0, 1 / 3, 0.0, 0.5, 0.0, 1.0])


def test_string_distances():
    assert ar.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert ar.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert (ar.jaro("", ""), ar.jaro("", "a")) == (1.0, 0.0)
    assert (ar.damerau("ca", "abc"), ar.damerau("ab", "ba"), ar.damerau("", "abc")) == (2, 1, 3)
    assert (ar.common_subsequence("abcbdab", "bdcaba"), ar.common_subsequence("", "a")) == (4, 0)


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3)):
        x = rng.random((n, m))
        small, large = min(n, m), max(n, m)
        y = x if n <= m else x.T
        want = max(sum(y[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert ar.best_assignment(x) == pytest.approx(want)
    assert ar.best_assignment(np.zeros((0, 3))) == 0.0


@pytest.mark.parametrize("one,other", [("marcas", "marca"), ("aviões", "avião"), ("animais", "animal"), ("menina", "menino"), ("casas", "casa")])
def test_stems(one, other):
    assert ar.stem(one) == ar.stem(other) and ar.stem("") == ""


def test_simhash_of_equal_and_empty(spark):
    out = _one(spark, ["casa", "casa", ""], tx.simhash64(F.col("x")))
    assert out[0] == out[1] and out[2] == (0,)


def test_distances_of_many_are_those_of_one_by_one():
    import random

    from paronym.functions import arrow as ar

    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 14))) for _ in range(600)] + ["", "a", "ab" * 30]
    a, b = words, words[7:] + words[:7]
    plain, winkler = ar.jaro_many(a, b)
    edits = ar.damerau_many(a, b)
    for x, y, j, w, e in zip(a, b, plain, winkler, edits):
        assert j == pytest.approx(ar.jaro(x, y)) and w == pytest.approx(ar.jaro_winkler(x, y)) and e == ar.damerau(x, y), (x, y)
    made = ar.string_similarities.func(pd.Series([*a, None, "k" * 200]), pd.Series([*b, "x", "k" * 190 + "z"]))
    assert made["damerau"].iloc[-1] == 1 - ar.damerau("k" * 200, "k" * 190 + "z") / 200 and made["damerau"].iloc[-2] == 0
