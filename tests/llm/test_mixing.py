from collections import defaultdict

import pytest

from paronym.llm.mixing import mix_sources, route

TARGETS = "source string, weight double, max_uses int"


def _mix(spark, rows, targets, schema="k int, n int, s array<string>"):
    return mix_sources(spark.createDataFrame(rows, schema), "k", "n", "s", spark.createDataFrame(targets, TARGETS), circle=16)


def test_flow_prefers_fresh_text_and_keeps_caps():
    flows = route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": (0.5, 2), "b": (0.5, 1)}, 210)
    assert flows[("b",), "b"] == 10 and flows[("a", "b"), "b"] == 95
    assert flows[("a",), "a"] + flows[("a", "b"), "a"] == 105


def test_shares_and_uses(spark):
    rows = [(i, 1 + i % 13, ["big"]) for i in range(2000)] + [(5000 + i, 10, ["small"]) for i in range(50)] + [(9000 + i, 7, ["big", "other"]) for i in range(100)]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("other", 0.03, 2), ("absent", 0.1, 5)]
    mix = _mix(spark, rows, targets)
    report = {r.source: r for r in mix.report.collect()}
    total = sum(n for _, n, _ in rows)
    assert [s for s, r in sorted(report.items()) if r.short] == ["absent", "small"]
    chosen, uses = defaultdict(int), defaultdict(int)
    caps = {s: m for s, _, m in targets}
    belongs = {k: s for k, _, s in rows}
    for r in mix.selection.collect():
        assert r.uses <= caps[r.source] and r.source in belongs[r.key]
        chosen[r.source] += r.uses * r.tokens
        uses[r.key] += r.uses
    for s in ("big", "small", "other"):
        assert chosen[s] == pytest.approx(report[s].chosen, abs=40)
    assert report["small"].chosen == 1500 and chosen["small"] == 1500
    assert report["big"].chosen == pytest.approx(0.5 * total, abs=1)
    assert sum(r.share for r in report.values()) == pytest.approx(1)


def test_single_source_column_nulls_and_empty(spark):
    rows = [(1, 5, "a"), (2, None, "a"), (3, 4, None), (4, 6, "zz"), (4, 6, "a"), (4, 6, "a")]
    mix = _mix(spark, rows, [("a", 0.5, 1), ("b", None, None)], "k int, n int, s string")
    report = {r.source: r for r in mix.report.collect()}
    assert report["a"].tokens == 17 and report["a"].target == pytest.approx(11.5) and not report["a"].short
    assert sum(r.uses * r.tokens for r in mix.selection.collect()) in range(6, 18)
    nothing = _mix(spark, [], [("a", 0.5, 1)])
    assert nothing.selection.count() == 0 and nothing.report.collect()[0].chosen == 0
    assert _mix(spark, [(1, 5, ["a"])], []).selection.count() == 0


def test_report_gives_what_the_selection_takes(spark):
    rows = [(i, 1000, ["long"]) for i in range(4)] + [(100 + i, 1, ["fine"]) for i in range(1000)]
    mix = _mix(spark, rows, [("long", 0.05, 1), ("fine", 0.1, 1), ("absent", 0.1, 1)])
    taken = defaultdict(int)
    for r in mix.selection.collect():
        taken[r.source] += r.uses * r.tokens
    report = {r.source: r for r in mix.report.collect()}
    assert report["long"].chosen == 250 and report["long"].taken in (0, 1000)  # documents are taken whole
    assert {s: r.taken for s, r in report.items()} == {s: taken[s] for s in report}
    assert {s: r.share for s, r in report.items()} == pytest.approx({s: taken[s] / sum(taken.values()) for s in report})
