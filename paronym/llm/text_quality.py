"""Per-document text quality statistics and the texts that aren't natural prose.

Texts are scanned in Arrow batches as arrays over their code points
(``text_scan``), so all statistics share one tokenisation of the whole text.
Common words aren't listed: they are learned from the collection, as the words
that stand in a share of all documents of a language and there in running text,
not among items.  Mergeable quantile sketches with fixed cells hold every
statistic's distribution by language; they are sums of counts, so they don't
depend on the order of the data.  Each value becomes a percentile and a robust
z-score, and a text is no prose if several of its statistics lie in the tails.

Languages with few documents lean on all languages together: every language's
distribution is its own plus that of all, weighed as ``lean`` documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text_scan import Scan, mixed, scan

STATISTICS = ["words", "mean_word_length", "symbol_share", "punctuated_lines", "whole_words", "running_words", "top_word", "common_words"]
#: Statistics without an upper end: their cells grow by one per cent; the others have a thousand cells from 0 to 1.
_OPEN = ("words", "mean_word_length")
_GROWTH = np.log(1.01)
#: Statistics whose tail tells against prose, and on which side.  Long words do so only where lines
#: don't close with punctuation, as neither sign alone tells a list from prose of its own.
_SIDES = {"symbol_share": 1, "whole_words": -1, "running_words": -1, "top_word": 1}

#: Least scales of the z-scores; a statistic that hardly varies in prose would else have tails everywhere.
_LEAST_SCALE = {"words": 1.0, "mean_word_length": 0.05, "symbol_share": 0.004, "punctuated_lines": 0.03, "whole_words": 0.03, "running_words": 0.03, "top_word": 0.01, "common_words": 0.03}

#: Characters scanned together; a longer text is scanned by itself.
_BLOCK = 1_000_000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[str]]]:
    """Keys, texts and languages of neighbouring rows, up to a number of characters."""
    for batch in batches:
        keys, texts, languages = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        first, held = 0, 0
        for i, text in enumerate(texts):
            texts[i] = text or ""
            if i > first and held + len(texts[i]) > _BLOCK:
                yield keys.slice(first, i - first), texts[first:i], languages[first:i]
                first, held = i, 0
            held += len(texts[i])
        if texts:
            yield keys.slice(first), texts[first:], languages[first:]


def _seen(least_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of a block in which a word stands, and in which it stands in running text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, languages in _blocks(batches):
            s = scan(texts)
            if not len(s.word):
                continue
            names = sorted(set(languages))
            spoken = np.array([names.index(x) for x in languages])[s.text]
            _, at, back = np.unique(mixed(s.word + mixed(s.text.astype(np.uint64))), return_index=True, return_inverse=True)
            running = np.bincount(back, s.sentence | (s.run >= least_run)) > 0
            _, first, again = np.unique(mixed(s.word[at] + mixed(spoken[at].astype(np.uint64))), return_index=True, return_inverse=True)
            one = at[first]
            yield pa.RecordBatch.from_pydict({
                "language": [names[i] for i in spoken[one]],
                "word": [s.joined[a:b] for a, b in zip(s.start[one].tolist(), s.end[one].tolist())],
                "docs": np.bincount(again).astype(np.int64),
                "running": np.bincount(again, running).astype(np.int64),
            })

    return run


def _texts(df: DataFrame, key: str | None, text: str, language: str | None) -> DataFrame:
    lang = F.lit("und") if language is None else F.coalesce(F.col(f"`{language}`").cast("string"), F.lit("und"))
    return df.select((F.lit(None).cast("int") if key is None else F.col(f"`{key}`")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"), lang.alias("language"))


def word_documents(df: DataFrame, text: str, language: str | None = None, least_run: int = 6) -> DataFrame:
    """``(language, word, docs, running)``: documents that hold a word, and that hold it in a run of ``least_run`` words or more or in a sentence."""
    seen = _texts(df, None, text, language).mapInArrow(_seen(least_run), "language string, word string, docs bigint, running bigint")
    return seen.groupBy("language", "word").agg(F.sum("docs").alias("docs"), F.sum("running").alias("running"))


def common_words(df: DataFrame, text: str, language: str | None = None, share: float = 0.01, running: float = 0.95, lean: int = 200, prior: int = 5) -> DataFrame:
    """``(language, word, share, running)`` of the words that make running text, by language.

    A word is common if it stands in ``share`` of a language's documents and,
    of those, in ``running`` in a run of some words; both are drawn towards all
    languages together.  They are at most ``1 / share`` times the mean number
    of different words of a document, however large the collection.
    """
    words = cut_lineage(word_documents(df, text, language))
    held = F.coalesce(F.col(f"`{language}`").cast("string"), F.lit("und")) if language else F.lit("und")
    totals = df.select(held.alias("language")).groupBy("language").agg(F.count("*").alias("n"))
    everything = totals.agg(F.sum("n").alias("all"))
    # A word that reaches the share in no language reaches half of it in none even with what all languages lend it.
    pooled = words.groupBy("word").agg(F.sum("docs").alias("d"), F.sum("running").alias("r"))
    made = words.join(pooled, "word").join(F.broadcast(totals), "language").crossJoin(F.broadcast(everything))
    part = (F.col("docs") + lean * F.col("d") / F.col("all")) / (F.col("n") + lean)
    rate = (F.col("running") + prior * (F.col("r") + 1) / (F.col("d") + 2)) / (F.col("docs") + prior)
    return made.select("language", "word", part.alias("share"), rate.alias("running")).where((F.col("share") >= share) & (F.col("running") >= running))


def _measured(words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Statistics of every text; ``words`` are the common ones."""
    known = np.unique(scan(words).word) if words else np.zeros(0, np.uint64)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    def top(s: Scan, n: int) -> np.ndarray:
        _, at, counts = np.unique(mixed(s.word + mixed(s.text.astype(np.uint64))), return_index=True, return_counts=True)
        most = np.zeros(n)
        np.maximum.at(most, s.text[at], counts)
        return most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, languages in _blocks(batches):
            s, n = scan(texts), len(texts)
            tally = lambda weights: np.bincount(s.text, weights, n)  # noqa: B023, E731
            words_ = np.bincount(s.text, minlength=n).astype(float)
            place = np.searchsorted(known, s.word)
            common = known[np.minimum(place, len(known) - 1)] == s.word if len(known) else np.zeros(len(s.word), bool)
            made = {
                "words": words_,
                "mean_word_length": share(tally(s.end - s.start), words_),
                "symbol_share": share(s.signs, s.solid),
                "punctuated_lines": share(s.ended, s.lines),
                "whole_words": share(tally(s.whole), words_),
                "running_words": share(tally(s.sentence | (s.run >= 5)), words_),
                "top_word": share(top(s, n), words_),
                "common_words": share(tally(common), words_),
            }
            yield pa.RecordBatch.from_pydict({"key": keys, "language": languages, **{c: made[c].astype(float) for c in STATISTICS}})

    return run


def document_statistics(df: DataFrame, key: str, text: str, language: str | None = None, common: list[str] | None = None) -> DataFrame:
    """``(key, language, *STATISTICS)`` for every row; a null language is ``und``; for null or blank text all are 0.

    ``words``; ``mean_word_length``; ``symbol_share`` of the characters that
    aren't blank; ``punctuated_lines``, the share of lines that end in
    punctuation; ``whole_words``, of words of letters or digits alone;
    ``running_words``, in runs of five words or more or in sentences; ``top_word``, of the most
    frequent word; ``common_words``, of the words of ``common`` (by default
    those of ``common_words``, of any language).  Keys may be null or repeated.
    """
    if common is None:
        common = sorted({r.word for r in common_words(df, text, language).select("word").distinct().collect()})  # bounded, see there
    rows = _texts(df, key, text, language)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_measured(common), f"key {kind}, language string, " + ", ".join(f"{s} double" for s in STATISTICS))


def cell(statistic: str) -> Column:
    """The cell of a statistic's sketch in which a value lies."""
    x = F.col(statistic)
    return F.when(x > 0, F.floor(F.log1p(x) / float(_GROWTH))).otherwise(0).cast("int") if statistic in _OPEN else F.floor(x * 1000).cast("int")


def cell_value(statistic: str, cells: np.ndarray) -> np.ndarray:
    return np.expm1((cells + 0.5) * _GROWTH) if statistic in _OPEN else (cells + 0.5) / 1000


def sketches(stats: DataFrame, *by: str) -> DataFrame:
    """``(language, *by, statistic, cell, n)``: sketches of any parts of the data merge by adding ``n``.

    A sketch has 1,001 cells, or some 2,300 up to ten thousand million.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), cell(s).alias("cell")) for s in STATISTICS]))
    return stats.select("language", *by, cells.alias("x")).groupBy("language", *by, "x.statistic", "x.cell").agg(F.count("*").alias("n"))


def _leaning(rows: list, languages: list[str], lean: int) -> dict[tuple[str, str], np.ndarray]:
    """Counts by cell of each (language, statistic), with those of all languages added as ``lean`` documents."""
    own: dict[tuple[str, str], np.ndarray] = {}
    pooled: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1001))
    for r in rows:
        for held in (own.setdefault((r.language, r.statistic), np.zeros(1001)), pooled[r.statistic]):
            if r.cell >= len(held):
                held.resize(2 * r.cell, refcheck=False)
            held[r.cell] += r.n
    for language, statistic in ((x, s) for x in languages for s in STATISTICS):
        counts = own.setdefault((language, statistic), np.zeros(1001))
        more = pooled[statistic] * lean / max(pooled[statistic].sum(), 1)
        if len(counts) < len(more):
            counts.resize(len(more), refcheck=False)
        counts[: len(more)] += more
    return own


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    return float(values[np.searchsorted(np.cumsum(counts), q * counts.sum())])


def _center(values: np.ndarray, counts: np.ndarray, least: float) -> tuple[float, float]:
    """Median and robust scale: the larger of the median deviation's and the deciles'."""
    middle = _quantile(values, counts, 0.5)
    away = np.abs(values - middle)
    order = np.argsort(away, kind="stable")
    deviation = 1.4826 * _quantile(away[order], counts[order], 0.5)
    deciles = (_quantile(values, counts, 0.9) - _quantile(values, counts, 0.1)) / 2.563
    return middle, max(deviation, deciles, least)


def _parting(values: np.ndarray, counts: np.ndarray, least_separation: float) -> float:
    """The value between the two modes, or five scales below the median if there is one mode."""
    n = counts.sum()
    mean = (counts * values).sum() / n
    spread = (counts * (values - mean) ** 2).sum() / n
    below, sums = np.cumsum(counts)[:-1], np.cumsum(counts * values)[:-1]
    above = n - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), (sums / below - (mean * n - sums) / above) ** 2 * below * above / n**2, 0.0)
    if spread > 1e-9 and between.max() / spread >= least_separation:
        best = np.flatnonzero(between >= between.max() * (1 - 1e-9))  # equal over an empty gap: its middle
        return float(values[best].mean())
    middle, scale = _center(values, counts, 0.03)
    return middle - 5 * scale


def flag_tails(stats: DataFrame, z_tail: float = 3.0, z_far: float = 25.0, least_separation: float = 0.7, lean: int = 200) -> DataFrame:
    """``stats`` with ``<statistic>_percentile`` and ``<statistic>_z`` of each statistic, and ``prose``.

    Percentiles are places in the language's distribution.  z-scores are taken
    against median and robust scale of the documents above the value that parts
    the two modes of ``common_words``.  A text is no prose if it has no word, if
    its share of common words lies below that value and another statistic in the
    tail (``z_tail``), or if any lies far out (``z_far``).  Few common words
    alone don't tell: a text may have words of its own.
    """
    stats = cut_lineage(stats)  # a few numbers a document, so that the texts are scanned once
    # A row for each cell of each language's sketches comes to the driver; their number doesn't grow with the documents.
    cells = sketches(stats).collect()
    languages = sorted({r.language for r in cells})
    held = _leaning(cells, languages, lean)
    cut = {x: _parting(cell_value("common_words", np.arange(len(held[x, "common_words"]))), held[x, "common_words"], least_separation) for x in languages}
    spark = stats.sparkSession
    cuts = spark.createDataFrame(list(cut.items()), "language string, cut double")
    upper = stats.join(F.broadcast(cuts), "language").where("common_words >= cut")
    modes = _leaning(sketches(upper).collect(), languages, lean)
    rows = []
    for language in cut:
        row = [language, cut[language]]
        for s in STATISTICS:
            counts = held[language, s]
            mode = modes[language, s]
            middle, scale = _center(cell_value(s, np.arange(len(mode))), mode, _LEAST_SCALE[s]) if mode.sum() else (0.0, 1.0)
            row += [middle, scale, (np.cumsum(counts) / max(counts.sum(), 1)).round(9).tolist()]
        rows.append(row)
    facts = spark.createDataFrame(rows, "language string, cut double, " + ", ".join(f"{s}_m double, {s}_s double, {s}_c array<double>" for s in STATISTICS))
    joined = stats.join(F.broadcast(facts), "language")
    z = {s: (F.col(s) - F.col(f"{s}_m")) / F.col(f"{s}_s") for s in STATISTICS}
    out = joined.select("key", "language", *STATISTICS, "cut", *[F.element_at(f"{s}_c", F.least(cell(s) + 1, F.size(f"{s}_c"))).alias(f"{s}_percentile") for s in STATISTICS], *[z[s].alias(f"{s}_z") for s in STATISTICS])

    def beyond(limit: float) -> Column:
        found = F.lit(False)
        for s, side in _SIDES.items():
            found = found | (F.col(f"{s}_z") * side >= limit)
        return found

    heavy = (F.col("mean_word_length_z") >= z_tail) & (F.col("punctuated_lines") < 0.5)
    prose = (F.col("words") > 0) & ~((F.col("common_words") < F.col("cut")) & (beyond(z_tail) | heavy)) & ~beyond(z_far)
    return out.withColumn("prose", prose).drop("cut")
