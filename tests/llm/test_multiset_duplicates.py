from collections import defaultdict

import pytest

from paronym.llm.multiset_duplicates import duplicate_groups

ROWS = [
    (5, "a", "b", 1), (2, "b", "a", 1), (9, "a", "b", 1), (3, "a", "b", None), (4, "b", "a", None), (6, "a", "b", 2),
    (7, "", "a", 1), (8, "a", "", 1), (10, "a", "a", 1), (11, None, "a", 1), (12, "a", None, 1), (13, "x" * 50_000, "y", 1), (14, "y", "x" * 50_000, 1),
] + [(100 + i, f"v{i % 3}", f"v{(i + 1) % 3}", i % 2) for i in range(60)]


def _brute(rows):
    groups = defaultdict(list)
    for k, a, b, c in rows:
        groups[tuple(sorted((a, b), key=lambda x: (x is None, x))), c].append(k)
    return {(min(g), k, len(g)) for g in groups.values() if len(g) > 1 for k in g}


@pytest.mark.parametrize("bits", [64, 1, 3])
def test_groups_match_brute_force_even_when_fingerprints_collide(spark, bits):
    df = spark.createDataFrame(ROWS, "k int, a string, b string, c int")
    out = [tuple(r) for r in duplicate_groups(df, "k", ["a", "b"], ["c"], bits=bits).collect()]
    assert len(out) == len(set(out)) and set(out) == _brute(ROWS)


def test_empty_repeated_and_clashing(spark):
    schema = "k int, a string, b string, c int, fp string, own string"
    assert duplicate_groups(spark.createDataFrame([], schema), "k", ["a", "b"], ["c"]).count() == 0
    twice = spark.createDataFrame([(1, "a", "b", 1, "", ""), (1, "a", "b", 1, "", "")], schema)
    assert [tuple(r) for r in duplicate_groups(twice, "k", ["a", "b"], ["c"]).collect()] == [(1, 1, 2)] * 2
