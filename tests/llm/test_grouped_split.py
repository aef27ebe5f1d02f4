import random

import pytest

from paronym.llm.components import components
from paronym.llm.grouped_split import related_groups, split_groups


def _brute(members):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, v in members:
        if r is not None:
            find(("r", r))
            if v is not None:
                parent[find(("r", r))] = find(("v", v))
    least = {}
    for kind, x in list(parent):
        if kind == "r":
            root = find((kind, x))
            least[root] = min(least.get(root, x), x)
    return {(x, least[find((k, x))]) for k, x in list(parent) if k == "r"}


def test_components_of_paths_stars_and_doubles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 901), (901, 900), (950, 950), (None, 1)]
    out = {r.v: r.root for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(200)}, 900: 900, 901: 900}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    members = [(i, f"m{rng.randrange(150)}") for i in range(120) for _ in range(rng.choice((1, 2)))]
    members += [(200, None), (None, "m1"), (201, ""), (202, ""), (203, "m3"), (203, "m3"), *((300 + i, "hot") for i in range(150))]
    df = spark.createDataFrame(members, "r int, v string")
    out = [tuple(r) for r in related_groups(df, "r", "v").collect()]
    assert len(out) == len(set(out)) and set(out) == _brute(members)


def test_split_keeps_groups_whole_and_near_the_shares(spark):
    rows = [(i, i % 700 if i > 900 else i // 300, int(i % 9 == 0)) for i in range(3000)] + [(5000, None, None)]
    df = spark.createDataFrame(rows, "k int, g int, l int")
    out = split_groups(df, "k", "g", "l", {"a": 0.7, "b": 0.15, "c": 0.15}, steps=4000).collect()
    assert len(out) == len([r for r in rows if r[1] is not None])
    of = {}
    for r in out:
        assert of.setdefault(r["group"], r.split) == r.split
    sizes = {s: sum(r.split == s for r in out) / len(out) for s in "abc"}
    positive = {r[0] for r in rows if r[2] == 1}
    labels = {s: sum(r.split == s and r.record in positive for r in out) / len(positive) for s in "abc"}
    for s, share in {"a": 0.7, "b": 0.15, "c": 0.15}.items():
        assert sizes[s] == pytest.approx(share, abs=0.02) and labels[s] == pytest.approx(share, abs=0.04)
    again = split_groups(df, "k", "g", "l", {"a": 0.7, "b": 0.15, "c": 0.15}, steps=4000).collect()
    assert sorted(out) == sorted(again)


def test_split_of_nothing_and_without_label(spark):
    empty = spark.createDataFrame([], "k int, g int, split string")
    assert split_groups(empty, "k", "g", None, {"a": 0.5, "b": 0.5}).count() == 0
    one = spark.createDataFrame([(1, 1, "x"), (1, 1, "x")], "k int, g int, split string")
    assert len({r.split for r in split_groups(one, "k", "g", None, {"a": 0.5, "b": 0.5}, steps=50).collect()}) == 1
