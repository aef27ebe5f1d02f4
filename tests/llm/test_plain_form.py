import random
import unicodedata

import pytest

from paronym.llm.plain_form import is_usable, plain_columns, plain_forms
from paronym.llm.unicode_tables import composed

CASES = [
    None, "", "   ", "abc", "ＢＵＴＡ", "Café", "Cafȩ́", "ȩ́", "́solta", "А́", "Ё", "Й", "ﬁm", "ĳ", "a b", "a b　c",
    "x​y﻿­z", "ぞ", "ｶﾞｷ", "a\tb\nc", "Å", "ΑΒΞ", "東林野", "²", "ᄀa", "\U0001d400x\U0001f600́", "q̣̇", "Ấ̧", "क़", "ʼn", "ŉ",
]


def _run(spark, values, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    return {r.id: r.plain for r in plain_forms(df, ["id"], ["t"], **more).collect()}


def test_cases_match_the_definition(spark):
    out = _run(spark, CASES)
    assert len(out) == len(CASES)
    for i, v in enumerate(CASES):
        assert out[i] == (None if v is None else composed(v)), ascii(v)


def test_random_strings_match_the_definition(spark):
    rng = random.Random(7)
    pool = "abcÀéíõ -.̧̣́̂̈АВЕорсЙЇїΆΈαβＡｂ１ﬁﬀǅ​ 　 ぞぞｶﾞ林̸=ୋ"
    values = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    out = _run(spark, values)
    for i, v in enumerate(values):
        assert out[i] == composed(v), ascii(v)


def test_plain_is_stable_and_composed(spark):
    first = _run(spark, [c for c in CASES if c])
    again = _run(spark, list(first.values()))
    assert dict(enumerate(first.values())) == again
    assert all(unicodedata.is_normalized("NFC", v) for v in first.values())


def test_very_long_text(spark):
    long = ("Café Ｂuta ​" * 7000) + "x"
    assert _run(spark, [long]) == {0: composed(long)}


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "Ａ", 1, "x"), (None, "Ａ", 1, "x"), (1, "е́", 2, "y"), (1, "ок", 3, "z")], "id int, v string, field int, plain string")
    out = plain_forms(df, ["id"], ["v"])
    assert out.columns == ["id", "field", "value", "plain"]
    assert sorted((str(r.id), r.field, r.plain) for r in out.collect()) == [("1", "v", "oк"), ("1", "v", "é"), ("None", "v", "A"), ("None", "v", "A")]


def test_empty_table(spark):
    assert plain_forms(spark.createDataFrame([], "id int, t string"), ["id"], ["t"]).count() == 0


def test_lookalikes_are_a_parameter(spark):
    assert _run(spark, ["АЖ"], lookalikes={"Ж": "K"}) == {0: "АK"}


@pytest.mark.parametrize("a,b,usable", [("x", "y", True), (None, "y", False), ("  　", "y", False), ("", "y", False), ("*", "-", True)])
def test_usable(spark, a, b, usable):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.where(is_usable("a", "b")).count() == int(usable)


def test_columns_side_by_side(spark):
    rows = [(1, "Ａ", "b"), (2, "b", "е́"), (2, "b", "е́"), (3, None, "Ａ"), (None, "x", ""), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    out = plain_columns(df, ["id"], ["a", "b"])
    assert out.columns == ["id", "a", "b"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "A", "b"), (2, "b", "é"), (2, "b", "é"), (3, None, "A"), (None, "x", ""), (4, None, None)]))
    assert plain_columns(df.where("false"), ["id"], ["a", "b"]).count() == 0
