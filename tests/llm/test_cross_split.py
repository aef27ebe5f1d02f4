import random

from pyspark.sql import functions as F

from paronym.llm import cross_split
from paronym.llm.cross_split import band_candidates, deletion_candidates, minwise, overlaps
from paronym.session import cut_lineage


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _found(df):
    return sorted(tuple(r)[:3] for r in overlaps(df, "k", "a", "b", "s", "t").collect())


def _brute(rows):
    out = []
    for k, a, b, s in rows:
        for l, c, d, t in rows:
            if s == "t" and t not in ("t", None) and None not in (a, b, c, d, k, l):
                e = min(_edits(a, c) + _edits(b, d), _edits(a, d) + _edits(b, c))
                if e <= 2:
                    out.append((k, l, e))
    return sorted(out)


def _mutated(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice((s[:i] + rng.choice("abcé") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcé") + s[i + 1 :]))
    return s


def test_all_pairs_within_two_edits_are_found(spark):
    rng = random.Random(5)
    names = ["butaxuvesetugebrasil", "casa", "ab", "a", "", "studioçãogifu", "xelolusobagifu", "21"]
    rows = []
    for i in range(130):
        a, b = rng.choice(names), rng.choice(names)
        rows.append((i, _mutated(rng, a, rng.randrange(3)), _mutated(rng, b, rng.randrange(3)), rng.choice("ttev")))
    rows += [(900, "casa", "ab", "t"), (901, "ab", "casa", "e"), (902, None, "ab", "e"), (903, "casa", "ab", None), (904, "k" * 9000, "ab", "t"), (905, "k" * 9001, "ab", "v")]
    # A hot string and repeated rows.
    rows += [(1000 + i, "butaxuvesetugebrasil", f"parceiro{i * 7919 % 1000:03d}", "t" if i % 3 else "e") for i in range(60)]
    rows += [rows[-1], (2007, "x", "y", "t"), (2008, "x", "y", "e"), (2008, "x", "y", "e")]
    df = spark.createDataFrame(rows, "k int, a string, b string, s string")
    out = _found(df)
    assert out == _brute(rows)


def test_empty_table_clashing_columns_and_exact_jaccard(spark):
    schema = "k int, a string, b string, s string, t boolean, c int, x string"
    assert overlaps(spark.createDataFrame([], schema), "k", "a", "b", "s", "t").count() == 0
    rows = [(1, "u", "v", "t", True, 1, ""), (2, "v", "u", "e", None, 1, ""), (3, "butaxuvesetuge", "studiogifu", "t", None, 1, ""), (4, "butaxuvesetugee", "studiogifu", "e", None, 1, "")]
    grams = lambda s: {f"^{s}$"[i : i + 2] for i in range(len(s) + 1)}
    x, y = (grams(m) | grams("studiogifu") for m in ("butaxuvesetuge", "butaxuvesetugee"))
    out = sorted(tuple(r) for r in overlaps(spark.createDataFrame(rows, schema), "k", "a", "b", "s", "t").withColumn("jaccard", F.round("jaccard", 6)).collect())
    assert out == [(1, 2, 0, 1.0), (3, 4, 1, round(len(x & y) / len(x | y), 6))]


def _word(rng, n):
    return "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(n))


def _sides(spark, left, right):
    made = [(i, 0, x, y) for i, (x, y) in enumerate(left)], [(i, 0, x, y) for i, (x, y) in enumerate(right)]
    return [spark.createDataFrame(rows, "c bigint, o smallint, x string, y string") for rows in made]


def test_bands_of_each_mark_find_two_edits_in_long_strings(spark):
    rng = random.Random(9)
    probe = [(_word(rng, rng.randrange(10, 25)), _word(rng, rng.randrange(10, 25))) for _ in range(600)]
    index = [(_mutated(rng, x, i % 3), _mutated(rng, y, 2 - i % 3)) for i, (x, y) in enumerate(probe)]
    found = {(r.t, r.e) for r in band_candidates(*_sides(spark, index, probe)).collect()}
    assert sum((i, i) in found for i in range(600)) >= 594
    assert len(found) < 3000


def test_a_hot_mark_whose_partners_begin_alike_makes_few_candidates(spark):
    rng = random.Random(4)
    n = 2000
    names = [("hotmarkofmany", "casa" + _word(rng, 11)) for _ in range(n)]
    near = [(x, _mutated(rng, y, 2)) for x, y in names]
    found = [tuple(r) for r in band_candidates(*_sides(spark, near, names), heavy=1000).collect()]
    assert sum(t == e for t, e in found) >= 0.98 * n
    assert len(found) < 0.01 * n**2


def test_heavy_buckets_lose_no_near_pair(spark):
    rng = random.Random(4)
    names = [("hotmarkofmany", "mercadodecasa" + _word(rng, 3)) for _ in range(1500)] + [("hotmarkofmany", "k" * 90 + _word(rng, 10)) for _ in range(20)]
    near = [(x, _mutated(rng, y, 2)) for x, y in names]
    sides = _sides(spark, near, names)
    edits = lambda t, e: _edits(names[t][1], near[e][1])
    whole = {(r.t, r.e) for r in band_candidates(*sides, heavy=10**12).collect() if r.t == r.e}
    parted = {(r.t, r.e) for r in band_candidates(*sides, heavy=100).collect()}
    assert len(whole) > 1500 and all(edits(t, e) <= 2 for t, e in whole) and whole <= parted
    assert len(parted) < 0.06 * 1500**2


def test_deletions_meet_every_pair_within_two_edits_and_few_others(spark):
    rng = random.Random(8)
    probe = [(_mutated(rng, "casa", i % 3), _mutated(rng, "butaxuve", rng.randrange(3))) for i in range(60)] + [("", ""), ("", "a"), ("ab", "")]
    index = [(_mutated(rng, "casa", rng.randrange(3)), _mutated(rng, "butaxuve", i % 3)) for i in range(60)] + [("", ""), ("b", ""), ("ba", "")]
    found = {(r.t, r.e) for r in deletion_candidates(*_sides(spark, index, probe)).collect()}
    edits = {(t, e): _edits(x, u) + _edits(y, v) for t, (x, y) in enumerate(probe) for e, (u, v) in enumerate(index)}
    assert {p for p, n in edits.items() if n <= 2} <= found and all(edits[p] <= 4 for p in found)


def test_minwise_agrees_with_the_jaccard_similarity():
    rng = random.Random(2)
    a, b = _word(rng, 300), _word(rng, 300)
    texts = [a + b, a + _word(rng, 300)]
    grams = [{f"^{t}$"[i : i + 2] for i in range(len(t) + 1)} for t in texts]
    least = minwise(texts, 2000, 1)
    assert abs((least[0] == least[1]).mean() - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 0.05
    assert (minwise(["", "a"], 4, 1)[0] == minwise([""], 4, 1)[0]).all()


def test_few_deletion_keys_for_a_hot_mark_and_the_same_candidates_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    names = [("hotmarkofmany", "casa" + _word(rng, 8)) for _ in range(300)] + [("hotmarkofmani", "butaxuvesetu"), ("otmarkofmany", "butaxuvesetu")]
    near = [(_mutated(rng, x, i % 3), _mutated(rng, y, 2 - i % 3)) for i, (x, y) in enumerate(names)]
    sides = _sides(spark, near, names)
    made, keys = [], cross_split._deletion_keys

    def counted(part, parts):
        made.append(parts)
        return keys(part, parts)

    monkeypatch.setattr(cross_split, "_deletion_keys", counted)
    whole = {tuple(r) for r in deletion_candidates(*sides).collect()}
    assert set(made) == {1} and {(i, i) for i in range(302)} <= whole
    monkeypatch.setattr(cross_split, "PART_ROWS", 100)
    assert {tuple(r) for r in deletion_candidates(*sides).collect()} == whole and set(made) == {1, 4}


def test_marks_with_near_marks_on_one_side_only_have_keys_for_no_edits_in_both(spark):
    e, t = _sides(spark, [("hot", "butaxuve")], [("hot", "studiogi"), ("hat", "casa")])
    known = {r.s: tuple(r)[1:] for r in cross_split._known_strings(e, t, "x").collect()}
    assert known == {"hot": (True, True, False), "hat": (False, False, True)}
    assert all(not any(tuple(r)[1:]) for r in cross_split._known_strings(e, t, "y").collect())


def test_a_written_table_leaves_no_shuffle_files_and_no_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(1 for f in status.getAllFiles().mkString("\n").split("\n") if f.endswith(".data"))
    held = count()
    cut_lineage(spark.range(1000).repartition(3, "id"))
    assert count() <= held and spark.conf.get(name) == before
