"""Statistics fitted on a corpus and looked up later: frequencies, class priors, weighted terms, scales.

Each fit is an aggregation that yields a small frame; each use is a join with a
stated default.  Sizes of the lookups are those of a vocabulary or of pairs of
45 classes; the optimizer broadcasts them while they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.term_vectors import Terms, term_sums
from ..functions.text import STRUCTURAL_WORDS, base_form, name_tokens


def token_frequencies(pairs: DataFrame, share: float = 0.01, extra: list[str] | None = None) -> DataFrame:
    """``(token, df, idf, generic)`` over both names of every pair.

    A token is generic if it stands in ``max(2, int(share * n))`` names or more
    and has three characters or more, or is a function word, or is in ``extra``.
    """
    names = pairs.select(F.explode(F.array("a", "b")).alias("name"))
    counts = names.groupBy("name").agg(F.count("*").alias("c"))  # each spelling is cut into tokens once
    df = counts.select("c", F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("token")).groupBy("token").agg(F.sum("c").alias("df"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    words = F.lit(False) if not extra else F.col("token").isin(*extra)
    frequent = (F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("n") * share).cast("bigint"))) & (F.length("token") >= 3)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return df.crossJoin(F.broadcast(total)).select("token", "df", idf.alias("idf"), (frequent | F.col("token").isin(*STRUCTURAL_WORDS) | words).alias("generic"))


def name_lookup(pairs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(name, looked)``: each distinct name with its tokens, in order, as (t, idf, generic); unseen tokens get 0 and false.

    Function words are generic whether seen or not.
    """
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    parts = names.select("name", F.posexplode_outer(name_tokens(F.col("name"))).alias("p", "token"))
    found = parts.join(frequencies.select("token", "idf", "generic"), "token", "left")
    one = F.struct("p", F.col("token").alias("t"), F.coalesce("idf", F.lit(0.0)).alias("idf"), F.coalesce("generic", F.col("token").isin(*STRUCTURAL_WORDS), F.lit(False)).alias("generic"))
    return found.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), one))).alias("looked"))


def class_pair_priors(pairs: DataFrame, alpha: float = 2.0, beta: float = 8.0, least: int = 1) -> DataFrame:
    """``(c1, c2, total, positives, prior, chi2, strength)`` of each unordered pair of known classes.

    The prior is smoothed; chi-square tests the pair against all others and is
    divided by the largest, at most 1; pairs seen less than ``least`` times get 0.
    """
    known = pairs.where((F.col("class_a") >= 0) & (F.col("class_b") >= 0)).select(F.least("class_a", "class_b").alias("c1"), F.greatest("class_a", "class_b").alias("c2"), "label")
    sums = known.groupBy("c1", "c2").agg(F.count("*").cast("double").alias("total"), F.sum("label").cast("double").alias("positives"))
    totals = sums.agg(F.sum("total").alias("n"), F.sum("positives").alias("np"))
    rows = sums.crossJoin(F.broadcast(totals))  # one row
    t, p, n, np_ = (F.col(c) for c in ("total", "positives", "n", "np"))
    cells = [(p, t * np_ / n), (t - p, t * (n - np_) / n), (np_ - p, (n - t) * np_ / n), ((n - np_) - (t - p), (n - t) * (n - np_) / n)]
    chi2 = sum((F.when(e > 0, (o - e) * (o - e) / e).otherwise(F.lit(0.0)) for o, e in cells), F.lit(0.0))
    made = rows.select("c1", "c2", "total", "positives", ((p + alpha) / (t + alpha + beta)).alias("prior"), F.when(t >= least, chi2).otherwise(F.lit(0.0)).alias("chi2"))
    top = made.agg(F.max("chi2").alias("top"))
    return made.crossJoin(F.broadcast(top)).select("c1", "c2", "total", "positives", "prior", "chi2", F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("chi2") / F.col("top"))).otherwise(F.lit(0.0)).alias("strength"))


def with_class_priors(pairs: DataFrame, priors: DataFrame, alpha: float = 2.0, beta: float = 8.0) -> DataFrame:
    """Add ``prior`` and ``strength``; an unseen pair has the prior of no evidence and no strength."""
    keyed = pairs.withColumns({"c1": F.least("class_a", "class_b"), "c2": F.greatest("class_a", "class_b")})
    found = keyed.join(priors.select("c1", "c2", "prior", "strength"), ["c1", "c2"], "left").drop("c1", "c2")
    return found.withColumns({"prior": F.coalesce("prior", F.lit(alpha / (alpha + beta))), "strength": F.coalesce("strength", F.lit(0.0))})


def word_terms(text: str):
    """Words of two characters or more and neighbouring pairs of them."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?U)\\b\\w\\w+\\b"), 0)
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    # As an element of an array the words are found once a text, not once for each pair of them.
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w)), F.lit(0))


def char_words(text: str):
    """The words whose grams are a text's terms."""
    return F.filter(F.split(F.lower(F.col(text)), "\\s+"), lambda w: w != "")


def char_terms(text: str, low: int = 3, high: int = 5):
    """Character grams inside words padded by a blank on either side; a word of no more than the gram's size counts once in all."""
    words = F.transform(char_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    none = F.array().cast("array<string>")

    def grams(w):
        windows = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        # The first size takes words that are shorter, too; larger sizes only words that are longer than the size before.
        return F.concat(*[windows(n) if n == low else F.when(F.length(w) >= n, windows(n)).otherwise(none) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def tfidf_vocabulary(counts: DataFrame, total: DataFrame, least_df: int = 3, max_terms: int = 20_000) -> DataFrame:
    """``(term, tf, df, idf)`` of term counts (ident, copies, term, n) and the one row ``docs`` of all texts.

    A text counts as often as it has copies.  The vocabulary keeps terms of
    ``least_df`` texts or more, of those the most frequent, by total count and
    then by name.
    """
    sums = counts.groupBy("term").agg(F.sum(F.col("n") * F.col("copies")).alias("tf"), F.sum("copies").alias("df")).where(F.col("df") >= least_df)
    return _kept(sums, total, max_terms)


def _kept(sums: DataFrame, total: DataFrame, max_terms: int) -> DataFrame:
    kept = sums.orderBy(F.desc("tf"), "term").limit(max_terms)
    return kept.crossJoin(F.broadcast(total)).select("term", "tf", "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fitted_vocabulary(texts: DataFrame, units: str, terms: Terms, least_df: int = 3, max_terms: int = 20_000) -> DataFrame:
    """The same vocabulary of texts that come as lists of ``units``; a task brings one row a term."""
    sums = term_sums(texts, units, terms).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= least_df)
    return _kept(sums, texts.agg(F.count("*").alias("docs")), max_terms)


def term_counts(texts: DataFrame, ident: str, terms, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Term counts ``(ident, copies, term, n)`` and the one row ``docs``; without a column of ``copies`` each text stands for itself."""
    times = F.lit(1).cast("bigint") if copies is None else F.col(copies)
    counts = texts.select(F.col(ident).alias("ident"), times.alias("copies"), F.explode(terms).alias("term")).groupBy("ident", "copies", "term").agg(F.count("*").alias("n"))
    return counts, texts.agg(F.coalesce(F.sum(times), F.lit(0)).alias("docs"))


def tfidf_vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vectors ``(ident, term, weight)`` of length 1 over the vocabulary's terms; term counts are damped by the logarithm."""
    raw = counts.join(vocabulary.select("term", "idf"), "term").select("ident", "term", ((F.log("n") + 1) * F.col("idf")).alias("w"))
    norms = raw.groupBy("ident").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "ident").select("ident", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(texts: DataFrame, ident: str, terms, least_df: int = 3, max_terms: int = 20_000, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``(term, tf, df, idf)`` and vectors ``(ident, term, weight)`` of length 1, both of the same texts."""
    counts, total = term_counts(texts, ident, terms, copies)
    vocabulary = tfidf_vocabulary(counts, total, least_df, max_terms)
    return vocabulary, tfidf_vectors(counts, vocabulary)


def vector_cosines(pairs: DataFrame, key: str, left: str, right: str, vectors: DataFrame) -> DataFrame:
    """``(key, cosine)`` of sparse vectors named by ``left`` and ``right``; a pair without a common term isn't listed."""
    a = pairs.select(key, F.col(left).alias("ident")).join(vectors, "ident").select(key, "term", F.col("weight").alias("wa"))
    b = pairs.select(key, F.col(right).alias("ident")).join(vectors, "ident").select(key, "term", F.col("weight").alias("wb"))
    return a.join(b, [key, "term"]).groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mean, scale)``: population deviation, 1 for a column without variance."""
    sums = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale")) for i, c in enumerate(columns)]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def scaled(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    """``df`` with its columns standardised; the scaler has one row a column."""
    by = {r["column"]: (r["mean"], r["scale"]) for r in fitted.collect()}
    return df.withColumns({c: (F.col(f"`{c}`") - by[c][0]) / by[c][1] for c in columns})
