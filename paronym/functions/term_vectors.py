"""Weighted terms of texts in Arrow batches: counts, cosines of two texts, and cosines of the items of two texts.

A text comes as the list of its units (words, say), each of which stands for
some terms.  Terms are counted inside the batch, so no row is made for a term of
a text and nothing of it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import best_assignment, stem

#: The terms of one unit.
Terms = Callable[[str], list[str]]
#: Units worked on at once, texts of more being taken whole; entries of a task's memory before it is emptied.
_TOGETHER, _HELD = 20_000, 200_000


@lru_cache(1 << 16)
def known_stem(word: str) -> str:
    return stem(word)


def itself(unit: str) -> list[str]:
    return [unit]


def char_grams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """Character grams of a word padded by a blank on either side; larger sizes only if the word is as long."""
    padded = f" {word} "
    return [padded[i : i + n] for n in range(low, high + 1) if n == low or len(padded) >= n for i in range(max(len(padded) - n + 1, 1))]


def stem_grams(word: str) -> list[str]:
    """Character grams of a word's stem."""
    return char_grams(s) if (s := known_stem(word)) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_lists(words: pd.Series) -> pd.Series:
    """The stems of lists of words."""
    return words.map(lambda x: [] if x is None else [known_stem(w) for w in x])


def _pieces(batch: pa.RecordBatch, units: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of rows of few units; one row at least."""
    group = np.cumsum(units) // _TOGETHER
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(borders, borders[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths().fill_null(0), np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class _Known:
    """The numbers of the terms of each unit; without a vocabulary new terms get new numbers."""

    def __init__(self, terms: Terms, vocabulary: dict[str, int] | None = None) -> None:
        self.terms, self.fixed, self.ids, self.units = terms, vocabulary is not None, {} if vocabulary is None else vocabulary, {}

    def _of(self, unit: str) -> np.ndarray:
        if (made := self.units.get(unit)) is None:
            named = [self.ids.get(t) for t in self.terms(unit)] if self.fixed else [self.ids.setdefault(t, len(self.ids)) for t in self.terms(unit)]
            made = self.units[unit] = np.array([i for i in named if i is not None], np.int64)
        return made

    def entries(self, units: pa.Array, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, term, count)`` in order of units side by side and the numbers of their texts."""
        if self.fixed and len(self.units) > _HELD:
            self.units.clear()
        coded = units.dictionary_encode()
        each = [self._of(u) for u in coded.dictionary.to_pylist()]
        counts = np.array([len(x) for x in each], np.int64)
        index = np.asarray(coded.indices, np.int64)
        pool = np.concatenate([np.zeros(0, np.int64), *each])
        own = counts[index]
        term = pool[_spread((np.cumsum(counts) - counts)[index], own)]
        width = max(len(self.ids), 1)
        key, n = np.unique(np.repeat(text, own) * width + term, return_counts=True)
        return key // width, key % width, n


def term_sums(texts: DataFrame, units: str, terms: Terms) -> DataFrame:
    """``(term, tf, df)``, of parts of ``texts``: how often a term stands and in how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tf, df = _Known(terms), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(known.ids), pa.string()), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])

        for batch in batches:
            for piece in _pieces(batch, _sizes(batch.column(0))):
                lists = piece.column(0)
                _, term, n = known.entries(lists.flatten(), np.repeat(np.arange(len(lists)), _sizes(lists)), len(lists))
                size = len(known.ids)
                tf, df = (np.pad(x, (0, size - len(x))) + np.bincount(term, w, size).astype(np.int64) for x, w in ((tf, n), (df, None)))
                if size > _HELD:
                    yield out()
                    known, tf, df = _Known(terms), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    return texts.select(units).mapInArrow(run, "term string, tf bigint, df bigint")


def _collected(vocabulary: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Terms and their weights; a vocabulary has some ten thousand."""
    rows = vocabulary.select("term", "idf").collect()
    return {r.term: i for i, r in enumerate(rows)}, np.array([r.idf for r in rows], float)


def _weights(text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """Weights that make each text's vector one of length 1; counts are damped by the logarithm."""
    w = (np.log(n) + 1) * idf[term]
    return w / np.sqrt(np.bincount(text, w * w, texts))[text]


def text_cosines(pairs: DataFrame, key: str, left: str, right: str, vocabulary: DataFrame, terms: Terms) -> DataFrame:
    """``(key, cosine)`` of the texts whose units are in ``left`` and ``right``; 0 for a pair without a common term."""
    ids, idf = _collected(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(terms, ids)
        for batch in batches:
            for piece in _pieces(batch, _sizes(batch.column(1)) + _sizes(batch.column(2))):
                n, sides = piece.num_rows, []
                for lists in piece.columns[1:]:
                    text, term, count = known.entries(lists.flatten(), np.repeat(np.arange(n), _sizes(lists)), n)
                    sides.append((text * max(len(ids), 1) + term, _weights(text, term, count, idf, n), text))
                (ka, wa, text), (kb, wb, _) = sides
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.bincount(text[i], wa[i] * wb[j], n).astype(float))], names=[key, "cosine"])

    made = pairs.select(key, left, right)
    return made.mapInArrow(run, T.StructType([made.schema[key], T.StructField("cosine", T.DoubleType())]))


def _aligned(cells: np.ndarray) -> float:
    """Best assignment as a share of the smaller side."""
    rows = cells if cells.shape[0] <= cells.shape[1] else cells.T
    best = rows.argmax(axis=1)
    whole = float(rows.max(axis=1).sum()) if len(set(best.tolist())) == len(best) else best_assignment(rows)
    return whole / len(rows)


def item_cosines(pairs: DataFrame, key: str, left: str, right: str, vocabulary: DataFrame, terms: Terms) -> DataFrame:
    """``(key, best, top3, aligned)`` of the cosines between the items, lists of units, in ``left`` and those in ``right``.

    Items without a unit are dropped, and so is a pair of which no two items have a common term.
    """
    ids, idf = _collected(vocabulary)
    width = max(len(ids), 1)

    def side(lists: pa.Array, known: _Known) -> tuple[np.ndarray, ...]:
        """Items of each pair; pair and place of each entry with its key and weight."""
        items = lists.flatten()
        words = _sizes(items)
        held = np.flatnonzero(words > 0)
        pair = np.repeat(np.arange(len(lists)), _sizes(lists))[held]
        count = np.bincount(pair, minlength=len(lists))
        place = np.arange(len(held)) - np.repeat(np.cumsum(count) - count, count)
        item, term, n = known.entries(items.flatten(), np.repeat(np.arange(len(held)), words[held]), len(held))
        return count, pair[item], place[item], pair[item] * width + term, _weights(item, term, n, idf, len(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(terms, ids)
        for batch in batches:
            # An entry meets each item of the other side.
            for piece in _pieces(batch, 10 * (1 + _sizes(batch.column(1)) * _sizes(batch.column(2)))):
                (n, pair, r, ka, wa), (m, _, c, kb, wb) = (side(x, known) for x in piece.columns[1:])
                order = np.argsort(kb, kind="stable")
                kb, wb, c = kb[order], wb[order], c[order]
                begin = np.searchsorted(kb, ka, "left")
                met = np.searchsorted(kb, ka, "right") - begin
                j = _spread(begin, met)
                start = np.cumsum(n * m) - n * m
                cells = np.bincount(np.repeat(start[pair] + r * m[pair], met) + c[j], np.repeat(wa, met) * wb[j], int((n * m).sum()))
                listed = np.flatnonzero(np.bincount(pair[met > 0], minlength=piece.num_rows))
                out = []
                for i in listed.tolist():
                    x = cells[start[i] : start[i] + n[i] * m[i]]
                    top = sorted(x.tolist(), reverse=True)[:3]
                    out.append((top[0], sum(top) / len(top), _aligned(x.reshape(n[i], m[i]))))
                made = np.array(out, float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(listed)), *[pa.array(made[:, k]) for k in range(3)]], names=[key, "best", "top3", "aligned"])

    made = pairs.select(key, left, right)
    return made.mapInArrow(run, T.StructType([made.schema[key], *[T.StructField(x, T.DoubleType()) for x in ("best", "top3", "aligned")]]))
