import os

import pytest

from paronym.llm.text_quality import STATISTICS, common_words, document_statistics, flag_tails, sketches
from paronym.llm.text_scan import scan

PROSE = "A câmara técnica recusou a oposição porque as letras finais não são iguais, mas ninguém respondeu até agora. "
LIST = "- tintas\n- botas de lã\n- BUTA XUVESETUGE\n- venda on-line de velas\n"


def _docs(spark, n=700):
    rows = []
    for i in range(n):
        if i % 3:
            rows.append((i, PROSE * (1 + i % 5) + f"O prazo corre até o dia {i}.", "pt" if i % 2 else None, True))
        else:
            rows.append((i, LIST * (1 + i % 4) + str(i), "pt" if i % 2 else "en", False))
    rows += [(10_000, PROSE.upper() + "\n" + LIST, "pt", True), (10_001, PROSE.replace(".", "").replace(" ", "\n", 4), "xx", True), (10_002, "", "pt", False), (10_003, None, None, False), (10_004, "4af 00 ## " * 9000, "pt", False), (10_005, PROSE * 900, "pt", True)]
    return rows


def test_lists_and_junk_are_flagged_and_prose_is_not(spark):
    rows = _docs(spark)
    df = spark.createDataFrame(rows, "k int, t string, l string, b boolean")
    out = {r.key: r for r in flag_tails(document_statistics(df, "k", "t", "l")).collect()}
    assert len(out) == len(rows)
    assert [k for k, _, _, b in rows if out[k].prose != b] == []
    assert all(0 <= r[f"{s}_percentile"] <= 1 for r in out.values() for s in STATISTICS)


# Texts that share next to no word with the tables, and lists that share many.
PLANTED = [
    ("Jane walked home. Rain fell all night, yet nobody minded much. Next morning she found five letters under her door, each one written by hand. Her brother laughed when he heard about them.", "en", True),
    ("Maria e João caminhavam devagar para casa. Chovia muito em toda rua, eles riam e cantavam. Depois de algum tempo apareceram cinco cartas debaixo de cada porta, todas escritas por gente desconhecida. Pedro gostou delas.", "pt", True),
    ("Il pleuvait depuis trois jours et personne ne sortait plus. Le matin suivant, elle trouva cinq lettres sous la porte, toutes écrites à la main. Son frère rit beaucoup quand il les vit.", "fr", True),
    ("the cup\nthe box\nthe lid\nthe spoon\nthe plate\nthe jar\nthe bowl\nthe tray", "en", False),
    ("the cup / the box / the lid / the spoon / the plate / the jar / the bowl", "en", False),
    ("os vasos;\nas tintas de parede;\no colchão;\na bicicleta;\nos cadernos;\nas velas;\no uniforme", "pt", False),
]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_planted_texts_and_the_same_result_from_other_partitions(spark):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang")
    df = held.union(spark.createDataFrame([(-1 - i, t, l) for i, (t, l, _) in enumerate(PLANTED)], held.schema))
    first = flag_tails(document_statistics(df, "doc_id", "text", "lang")).select("key", "prose", "words_percentile", "common_words_z")
    again = flag_tails(document_statistics(df.repartition(7), "doc_id", "text", "lang")).select("key", "prose", "words_percentile", "common_words_z")
    rows = {r.key: tuple(r) for r in first.collect()}
    assert [i for i, (_, _, prose) in enumerate(PLANTED) if rows[-1 - i][1] != prose] == []
    assert rows == {r.key: tuple(r) for r in again.collect()}


def test_common_words_are_learned(spark):
    df = spark.createDataFrame(_docs(spark), "k int, t string, l string, b boolean")
    words = {r.word for r in common_words(df, "t", "l").collect()}
    assert {"porque", "a", "ninguém"} <= words and not {"tintas", "botas", "velas"} & words


def test_statistics_of_one_text(spark):
    df = spark.createDataFrame([(1, "O sinal (novo) foi visto.\n\nsem ponto; #1", "x")], "k int, t string, words string")
    r = document_statistics(df, "k", "t", common=["o", "foi", "sem"]).collect()[0]
    assert (r.language, r.words) == ("und", 8)
    assert r.mean_word_length == pytest.approx((1 + 5 + 4 + 3 + 5 + 3 + 5 + 2) / 8)
    assert r.punctuated_lines == 0.5 and r.common_words == pytest.approx(3 / 8) and r.whole_words == 7 / 8
    assert r.symbol_share == pytest.approx(5 / 32) and r.running_words == 5 / 8 and r.top_word == 1 / 8


def test_scan_of_odd_texts():
    s = scan(["", " \u3000", "a/b (c-d) e'f", "--- ...", "x" * 50_000])
    words = [s.joined[a:b] for a, b in zip(s.start, s.end)]
    assert words[:3] == ["a/b", "c-d", "e'f"] and len(words[3]) == 50_000
    assert s.lines.tolist() == [0, 0, 1, 1, 1] and s.text.tolist() == [2, 2, 2, 4]
    assert len(set(s.word.tolist())) == 4 and scan(["zz e'f"]).word[1] == s.word[2]


def test_sketches_merge_to_the_whole(spark):
    df = spark.createDataFrame(_docs(spark, 200), "k int, t string, l string, b boolean")
    stats = document_statistics(df, "k", "t", "l", common=["porque"])
    whole = {tuple(r)[:3]: r.n for r in sketches(stats).collect()}
    parts = [{tuple(r)[:3]: r.n for r in sketches(stats.where(c)).collect()} for c in ("key < 90", "key >= 90 or key is null")]
    assert whole == {c: parts[0].get(c, 0) + parts[1].get(c, 0) for c in {*parts[0], *parts[1]}}
    assert {s for _, s, _ in whole} == set(STATISTICS)


def test_empty_repeated_and_one_kind_of_text(spark):
    df = spark.createDataFrame([], "k int, t string, l string")
    assert flag_tails(document_statistics(df, "k", "t", "l")).count() == 0
    two = spark.createDataFrame([(1, PROSE, None), (1, PROSE, None)], "k int, t string, l string")
    assert [r.prose for r in flag_tails(document_statistics(two, "k", "t", "l")).collect()] == [True, True]
