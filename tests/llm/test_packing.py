import random
from collections import defaultdict

import numpy as np
import pytest

from paronym.llm.packing import best_fit, pack_items
from paronym.llm.tokens import TOKENIZERS, VOCABULARY, text_tokens, token_count


def test_best_fit_holds_every_item_once():
    sizes = np.array([random.Random(1).randrange(1, 100) for _ in range(500)])
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= 1.1 * sizes.sum() / 100 + 1


@pytest.mark.parametrize("partitions,rows_per_task", [(1, 10_000), (9, 10_000), (9, 20)])
def test_every_item_is_packed_within_capacity(spark, partitions, rows_per_task):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.choice((rng.randrange(1, 40), rng.randrange(1, 101), rng.randrange(1, 350)))) for i in range(600)] + [("none", None), ("zero", 0), ("k1", 5), (None, 7), ("exact", 200)]
    out = pack_items(spark.createDataFrame(rows, "k string, n int"), "k", "n", capacity=100, partitions=partitions, rows_per_task=rows_per_task).collect()
    filled, parts = defaultdict(int), defaultdict(int)
    for r in out:
        parts[r.key] += r.tokens
        if r.container is not None:
            filled[r.container] += r.tokens
    assert all(v <= 100 for v in filled.values())
    assert all(filled[r.container] == r.filled for r in out if r.container)
    want = defaultdict(int)
    for k, n in rows:
        want[k] += n or 0
    assert parts == want
    assert {r.key for r in out if r.container is None} == {"none", "zero"}
    cut = {r.key for r in out if r.piece > 0}
    assert cut == {k for k, n in rows if n and n > 100}
    assert len(filled) <= (1.05 if rows_per_task > 20 else 1.15) * sum(filled.values()) / 100 + 2


def test_same_containers_again_and_empty_table(spark):
    df = spark.createDataFrame([(str(i), i % 90 + 1) for i in range(200)], "k string, n int")
    make = lambda d: sorted((r.container, r.key) for r in pack_items(d, "k", "n", capacity=100, partitions=4).collect())
    assert make(df) == make(df.repartition(7))
    assert pack_items(df.where("false"), "k", "n").count() == 0


def test_token_counts(spark):
    path = f"{TOKENIZERS}/{VOCABULARY}"
    long = "Apesar do prazo curto,  a nossa cliente\n\nrecusou 12 vendas. " * 5000
    assert text_tokens(long, path, block=1000) == text_tokens(long, path, block=10**9)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a marca"), (4, "x" * 3000)], "i int, t string")
    out = {r.i: r.n for r in df.select("i", token_count(df.t).alias("n")).collect()}
    assert out[1] is None and out[2] == 0 and out[3] == 2 and out[4] == text_tokens("x" * 3000, path)
