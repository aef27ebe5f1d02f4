from collections import Counter

from paronym.llm.term_counts import band, count_terms, global_dictionary


def _brute(rows):
    occ, rec, seen = Counter(), Counter(), {}
    for key, terms in rows:
        if key is None or terms is None:
            continue
        for t in terms:
            if t is not None:
                occ[t] += 1
                seen.setdefault(key, set()).add(t)
    for s in seen.values():
        rec.update(s)
    return {(t, occ[t], rec[t]) for t in occ}


def test_counts_match_brute_force(spark):
    rows = [(i, [f"w{i % 7}", f"w{i % 11}", "hot", "hot"] if i % 5 else []) for i in range(500)]
    rows += [(None, ["lost"]), (1, None), (2, [None, "x"]), (3, ["x", "x"]), (3, ["x"]), (4, ["muito " * 5000])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    out = {tuple(r) for r in count_terms(df, "k", "t", blocks=5, width=3).collect()}
    assert out == _brute(rows)


def test_dictionary_has_no_gaps(spark):
    df = spark.createDataFrame([(f"t{i % 50}",) for i in range(300)] + [(None,)], "term string")
    out = global_dictionary(df).collect()
    assert sorted(r.id for r in out) == list(range(50)) and len({r.term for r in out}) == 50


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k int, t array<string>, term string, id int")
    assert count_terms(empty, "k", "t").count() == 0
    df = spark.createDataFrame([(1, ["a"], "z", 9)], "k int, t array<string>, term string, id int")
    assert [tuple(r) for r in count_terms(df, "k", "t").collect()] == [("a", 1, 1)]


def test_bands(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "t string, n int")
    assert [r[0] for r in df.select(band("n", 300)).collect()] == ["rara", None, "comum"]
