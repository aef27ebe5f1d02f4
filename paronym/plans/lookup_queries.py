"""Queries of fitted lookups, sampling, metrics and reports over the trade-mark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.term_vectors import Terms, char_grams, itself, text_cosines
from ..operators import lookups as lk
from ..operators import metrics as mt
from ..operators import sampling as sp
from ..sources.tables import table
from . import sqltext as q
from .pair_queries import _with, clean

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _add(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# Fitted on names: tokens of two characters or more that aren't numbers.
_NAME_TOKENS = f"""
nomes AS (SELECT a AS nome FROM pares UNION ALL SELECT b FROM pares),
partes AS (SELECT unnest(list_distinct(list_filter({q.tokens(q.base('nome'))}, lambda v_: length(v_) >= 2 AND NOT regexp_matches(v_, '^[0-9]+$')))) AS token FROM nomes),
freq AS (SELECT token, count(*) AS df, (SELECT count(*) FROM nomes) AS n FROM partes GROUP BY 1),
idf AS (SELECT token, df, ln((1 + n)::double / (1 + df)) + 1 AS idf, (df >= greatest(2, floor(n * 0.01)) AND length(token) >= 3) OR token IN ({q.words(tx.STRUCTURAL_WORDS)}) AS generic FROM freq)"""


@_add(_with("," + _NAME_TOKENS, "SELECT token, df, round(idf, 6) AS idf, generic FROM idf"))
def token_idf(spark: SparkSession, folder: str) -> DataFrame:
    return _round(lk.token_frequencies(clean(spark, folder)), "idf")


@_add(_with("," + _NAME_TOKENS, "SELECT token, df FROM idf WHERE generic"))
def generic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return lk.token_frequencies(clean(spark, folder)).where("generic").select("token", "df")


_LOOKED = f""", {_NAME_TOKENS},
lado AS (SELECT pair_id, list_filter({q.tokens(q.base('a'))}, lambda v_: length(v_) >= 2 AND NOT regexp_matches(v_, '^[0-9]+$')) AS ta, list_filter({q.tokens(q.base('b'))}, lambda v_: length(v_) >= 2 AND NOT regexp_matches(v_, '^[0-9]+$')) AS tb FROM pares),
comuns AS (SELECT pair_id, unnest(list_intersect(list_distinct(ta), list_distinct(tb))) AS token FROM lado),
achado AS (SELECT pair_id, count(*) AS n, max(idf) AS maior, avg(idf) AS media, bool_and(generic) AS so FROM comuns JOIN idf USING (token) GROUP BY 1)"""


@_add(_with(_LOOKED, "SELECT pair_id, coalesce(n, 0) AS comuns, round(coalesce(maior, 0), 6) AS idf_max, round(coalesce(media, 0), 6) AS idf_media, coalesce(so, false)::int AS so_genericos FROM lado LEFT JOIN achado USING (pair_id)"))
def shared_token_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that both names share, with their weight and whether all are generic."""
    pairs = clean(spark, folder).select("pair_id", "a", "b")
    looked = lk.name_lookup(pairs, lk.token_frequencies(pairs))
    df = pairs.join(looked.withColumnsRenamed({"name": "a", "looked": "la"}), "a").join(looked.select(F.col("name").alias("b"), F.transform("looked", lambda x: x["t"]).alias("tb")), "b")
    shared = F.array_distinct(F.transform(F.filter("la", lambda x: F.array_contains("tb", x["t"])), lambda x: F.struct(x["t"].alias("t"), x["idf"].alias("idf"), x["generic"].alias("g"))))
    df = df.select("pair_id", shared.alias("s"))
    idfs = F.transform("s", lambda x: x["idf"])
    n = F.size("s")
    made = df.select("pair_id", n.alias("comuns"), F.coalesce(F.array_max(idfs), F.lit(0.0)).alias("idf_max"), F.when(n > 0, F.aggregate(idfs, F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(0.0)).alias("idf_media"), ((n > 0) & F.forall("s", lambda x: x["g"])).cast("int").alias("so_genericos"))
    return _round(made, "idf_max", "idf_media")


_PRIOR = """, k AS (SELECT least(ca, cb) AS c1, greatest(ca, cb) AS c2, y FROM pares WHERE ca >= 0 AND cb >= 0),
s AS (SELECT c1, c2, count(*)::double AS t, sum(y)::double AS p FROM k GROUP BY 1, 2), g AS (SELECT *, sum(t) OVER () AS n, sum(p) OVER () AS np FROM s),
x AS (SELECT *, CASE WHEN t * np > 0 THEN (p - t * np / n) ^ 2 / (t * np / n) ELSE 0 END + CASE WHEN t * (n - np) > 0 THEN ((t - p) - t * (n - np) / n) ^ 2 / (t * (n - np) / n) ELSE 0 END
    + CASE WHEN (n - t) * np > 0 THEN ((np - p) - (n - t) * np / n) ^ 2 / ((n - t) * np / n) ELSE 0 END + CASE WHEN (n - t) * (n - np) > 0 THEN (((n - np) - (t - p)) - (n - t) * (n - np) / n) ^ 2 / ((n - t) * (n - np) / n) ELSE 0 END AS chi2 FROM g)"""


@_add(_with(_PRIOR, "SELECT c1, c2, t AS total, p AS positives, round((p + 2) / (t + 10), 6) AS prior, round(chi2, 4) AS chi2, round(least(1, chi2 / max(chi2) OVER ()), 6) AS strength FROM x"))
def class_pair_prior(spark: SparkSession, folder: str) -> DataFrame:
    return _round(lk.class_pair_priors(clean(spark, folder)), "prior", "strength").withColumn("chi2", F.round("chi2", 4))


@_add(_with(_PRIOR, "SELECT pair_id, round(coalesce((p + 2) / (t + 10), 0.2), 6) AS prior FROM pares LEFT JOIN x ON x.c1 = least(ca, cb) AND x.c2 = greatest(ca, cb)"))
def class_prior_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pairs = clean(spark, folder)
    return _round(lk.with_class_priors(pairs, lk.class_pair_priors(pairs)), "prior").select("pair_id", "prior")


# Weighted terms of the descriptions, in base form so that both engines cut words alike.
def _specs(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder).select("pair_id", tx.base_form(F.col("spec_a")).alias("sa"), tx.base_form(F.col("spec_b")).alias("sb"))


def _documents(specs: DataFrame) -> DataFrame:
    return specs.select(F.explode(F.array(F.struct(F.concat(F.col("pair_id").cast("string"), F.lit("a")).alias("ident"), F.col("sa").alias("spec")), F.struct(F.concat(F.col("pair_id").cast("string"), F.lit("b")).alias("ident"), F.col("sb").alias("spec")))).alias("x")).select("x.*")


def _terms_sql(kind: str) -> str:
    if kind == "word":
        return "list_concat(w, list_transform(range(1, len(w)), lambda i_: w[i_] || ' ' || w[i_ + 1]))"
    return "flatten(list_transform(p, lambda u_: flatten(list_transform([3, 4, 5], lambda n_: CASE WHEN n_ = 3 OR length(u_) >= n_ THEN list_transform(range(1, greatest(length(u_) - n_ + 2, 2)), lambda i_: substr(u_, i_, n_)) ELSE [] END))))"


def _tfidf_sql(kind: str, size: int) -> str:
    return f""", d AS (SELECT pair_id || 'a' AS ident, {q.base('sa')} AS s FROM pares UNION ALL SELECT pair_id || 'b', {q.base('sb')} FROM pares),
c AS (SELECT ident, list_filter(string_split(s, ' '), lambda v_: length(v_) >= 2) AS w, list_transform(list_filter(string_split(s, ' '), lambda v_: v_ <> ''), lambda v_: ' ' || v_ || ' ') AS p FROM d),
t AS (SELECT ident, unnest({_terms_sql(kind)}) AS term FROM c), n AS (SELECT ident, term, count(*) AS n FROM t GROUP BY 1, 2),
v AS (SELECT term, sum(n)::bigint AS tf, count(*) AS df FROM n GROUP BY 1 HAVING count(*) >= 3 ORDER BY tf DESC, term LIMIT {size}),
i AS (SELECT term, tf, df, ln((1 + (SELECT count(*) FROM d))::double / (1 + df)) + 1 AS idf FROM v),
r AS (SELECT ident, term, (ln(n) + 1) * idf AS w FROM n JOIN i USING (term)), l AS (SELECT ident, term, w / sqrt(sum(w * w) OVER (PARTITION BY ident)) AS w FROM r)"""


_COSINE = "SELECT p.pair_id, round(coalesce(sum(x.w * y.w), 0), 5) AS cosseno FROM pares p LEFT JOIN (l x JOIN l y ON x.term = y.term AND x.ident = left(y.ident, length(y.ident) - 1) || 'a' AND right(y.ident, 1) = 'b') ON x.ident = p.pair_id || 'a' GROUP BY 1"


def _cosines(spark: SparkSession, folder: str, units, terms: Terms, size: int) -> DataFrame:
    pairs = _specs(spark, folder).select("pair_id", units("sa").alias("ua"), units("sb").alias("ub"))
    vocabulary = lk.fitted_vocabulary(pairs.select(F.explode(F.array("ua", "ub")).alias("u")), "u", terms, max_terms=size)
    return text_cosines(pairs, "pair_id", "ua", "ub", vocabulary, terms).select("pair_id", F.round("cosine", 5).alias("cosseno"))


@_add(_with(_tfidf_sql("word", 20_000), "SELECT term, tf, df, round(idf, 6) AS idf FROM i"))
def tfidf_word_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return _round(lk.tfidf(_documents(_specs(spark, folder)), "ident", lk.word_terms("spec"))[0], "idf")


@_add(_with(_tfidf_sql("word", 20_000), "SELECT term, round(idf, 6) AS idf FROM i WHERE NOT contains(term, ' ')"))
def unigram_idf(spark: SparkSession, folder: str) -> DataFrame:
    return _round(lk.tfidf(_documents(_specs(spark, folder)), "ident", lk.word_terms("spec"))[0], "idf").where(~F.contains(F.col("term"), F.lit(" "))).select("term", "idf")


@_add(_with(_tfidf_sql("word", 20_000), _COSINE))
def tfidf_word_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _cosines(spark, folder, lk.word_terms, itself, 20_000)


@_add(_with(_tfidf_sql("char", 10_000), _COSINE))
def tfidf_char_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _cosines(spark, folder, lk.char_words, char_grams, 10_000)


@_add("SELECT 'l_quantity' AS \"column\", round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS scale FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem UNION ALL SELECT 'l_one', 1, 1 FROM (SELECT 1)")
def scaler_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("l_one"))
    return _round(lk.scaler(rows, ["l_quantity", "l_tax", "l_one"]), "mean", "scale")


# Sampling.
_NUMBERED = ", h AS (SELECT pair_id, y, md5(pair_id || ':42') AS h FROM pares), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, pair_id) - 1 AS k, count(*) OVER (PARTITION BY y) AS n FROM h)"


@_add(_with(_NUMBERED, "SELECT pair_id, y AS label, CASE WHEN k < floor(n * 0.15 + 0.5) THEN 'teste' WHEN k < floor(n * 0.15 + 0.5) + floor(n * 0.15 + 0.5) THEN 'validacao' ELSE 'treino' END AS split FROM r"))
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return sp.stratified_split(clean(spark, folder).select("pair_id", "label"), "pair_id", "label")


@_add(_with(_NUMBERED, "SELECT pair_id, y AS label FROM r WHERE y = 1 OR k < 3 * (SELECT sum(y) FROM r)"))
def balance_undersample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.undersampled(clean(spark, folder).select("pair_id", "label"), "pair_id", "label")


_DRAW = "(('0x' || substr(md5(draw || ':42'), 1, 15))::bigint % n)"


@_add(_with(_NUMBERED, f", d AS (SELECT i AS draw, (SELECT max(n) FROM r WHERE y = 1) AS n FROM range((SELECT count(*) FROM r WHERE y = 0)) t(i)) SELECT pair_id, y AS label, NULL::bigint AS draw FROM r WHERE y = 0 UNION ALL SELECT r.pair_id, 1, d.draw FROM d JOIN r ON r.y = 1 AND r.k = {_DRAW.replace('% n', '% d.n')}"))
def balance_oversample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.oversampled(clean(spark, folder).select("pair_id", "label"), "pair_id", "label")


@_add(_with(", h AS (SELECT pair_id, row_number() OVER (ORDER BY md5(pair_id || ':42'), pair_id) - 1 AS k, count(*) OVER () AS n FROM pares), d AS (SELECT i AS draw, (SELECT max(n) FROM h) AS n FROM range((SELECT floor(max(n) * 0.5)::bigint FROM h)) t(i))", f"SELECT h.pair_id, d.draw FROM d JOIN h ON h.k = {_DRAW.replace('% n', '% d.n')}"))
def bootstrap_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.bootstrap(clean(spark, folder).select("pair_id"), "pair_id", 0.5)


@_add(_with("", "SELECT round((count(*) - sum(y))::double / greatest(sum(y), 1), 6) AS pos_weight FROM pares"))
def class_weight(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sp.class_weight(clean(spark, folder), "label"), "pos_weight")


@_add(_with("", "SELECT pair_id, a, b, ca AS class_a, cb AS class_b, false AS swapped FROM pares UNION ALL SELECT pair_id, b, a, cb, ca, true FROM pares"))
def symmetry_augment(spark: SparkSession, folder: str) -> DataFrame:
    return sp.swapped(clean(spark, folder).select("pair_id", "a", "b", "class_a", "class_b"), [("a", "b"), ("class_a", "class_b")])


@_add(_with("", "SELECT pair_id, y AS label FROM pares ORDER BY md5(pair_id || ':42'), pair_id LIMIT 600"))
def validation_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.hash_sample(clean(spark, folder).select("pair_id", "label"), "pair_id", 600)


# Scored pairs: the last debug record of each pair with its label.
_SCORED = """, u AS (SELECT * FROM depuracao QUALIFY row_number() OVER (PARTITION BY debug_id ORDER BY gerado_em DESC NULLS LAST) = 1),
o AS (SELECT pair_id, max(res.final) AS score, max(greatest(res.vetores.orto, res.vetores.fon)) AS other FROM u GROUP BY 1), z AS (SELECT pares.pair_id, a, b, ca, cb, y, score, other FROM o JOIN pares USING (pair_id) WHERE score IS NOT NULL)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """``(pair_id, a, b, class_a, class_b, y, score, other)``: the last record of each debug_id, the best of a pair."""
    newest = Window.partitionBy("debug_id").orderBy(F.col("gerado_em").desc_nulls_last())
    last = table(spark, folder, "depuracao").withColumn("n", F.row_number().over(newest)).where("n = 1")
    best = last.groupBy("pair_id").agg(F.max("res.final").alias("score"), F.max(F.greatest("res.vetores.orto", "res.vetores.fon")).alias("other"))
    return best.where("score is not null").join(clean(spark, folder), "pair_id").select("pair_id", "a", "b", "class_a", "class_b", F.col("label").alias("y"), "score", "other")


_CURVE = _SCORED + """, e AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM z GROUP BY 1),
k AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM e WINDOW w AS (ORDER BY score DESC))"""
_CELLS = "sum((score >= {0} AND y = 1)::int) AS tp, sum((score >= {0} AND y = 0)::int) AS fp, sum((score < {0} AND y = 1)::int) AS fn, sum((score < {0} AND y = 0)::int) AS tn"
_RATES = "tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, tn::bigint AS tn, round(CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::double / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
_GRID = _SCORED + f", q AS (SELECT t.i / 100.0::double AS threshold, {_CELLS.format('(t.i / 100.0::double)')} FROM z, range(5, 96) t(i) GROUP BY 1)"


@_add(_with(_SCORED, f"SELECT {_RATES} FROM (SELECT {_CELLS.format('0.5')} FROM z)"))
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.confusion(scored(spark, folder), 0.5), "precision", "recall", "f1")


@_add(_with(_CURVE, "SELECT round(sum(n * (tp - p) + 0.5 * n * p) / max(np * nn), 6) AS roc_auc FROM k"))
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.roc_auc(scored(spark, folder)), "roc_auc")


@_add(_with(_CURVE, "SELECT round(sum(p * tp::double / (tp + fp)) / max(np), 6) AS average_precision FROM k"))
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.average_precision(scored(spark, folder)), "average_precision")


@_add(_with(_CURVE, "SELECT score, round(fp::double / nn, 6) AS fpr, round(tp::double / np, 6) AS tpr FROM k"))
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.roc_curve(scored(spark, folder)), "fpr", "tpr")


@_add(_with(_CURVE, "SELECT score, round(tp::double / (tp + fp), 6) AS precision, round(tp::double / np, 6) AS recall FROM k"))
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.pr_curve(scored(spark, folder)), "precision", "recall")


@_add(_with(_CURVE, "SELECT round(coalesce(max(tp::double / np) FILTER (tp::double / (tp + fp) >= 0.2), 0), 6) AS recall FROM k"))
def recall_at_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.recall_at_precision(scored(spark, folder), 0.2), "recall")


@_add(_with(_GRID, f"SELECT threshold, {_RATES} FROM q"))
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.threshold_grid(scored(spark, folder)), "precision", "recall", "f1")


@_add(_with(_GRID + f", w AS (SELECT threshold, tp::double / nullif(tp + fn, 0) AS rr, 2 * tp::double / nullif(2 * tp + fp + fn, 0) AS ff, tp, fp, fn, tn FROM q)", f"SELECT threshold, {_RATES} FROM w ORDER BY coalesce(rr >= 0.85, false) DESC, CASE WHEN rr >= 0.85 THEN ff ELSE rr END DESC NULLS LAST, CASE WHEN rr >= 0.85 THEN rr ELSE ff END DESC NULLS LAST, threshold LIMIT 1"))
def threshold_search(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.best_threshold(scored(spark, folder)), "precision", "recall", "f1")


@_add(_with(_SCORED + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, pair_id) - 1 AS k, count(*) OVER () AS n FROM z)", "SELECT greatest(0, ((k * 10 + n - 2) // greatest(n - 1, 1)) - 1)::int AS decile, min(score) AS lowest, max(score) AS highest, count(*) AS pairs, sum(y)::bigint AS positives, round(avg(y), 6) AS rate FROM r GROUP BY 1"))
def score_deciles(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.deciles(scored(spark, folder)), "rate")


@_add(_with(_SCORED, "SELECT y, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, " + ", ".join(f"round(quantile_cont(score, {p}), 4) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM z GROUP BY 1"))
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    made = _round(mt.score_distribution(scored(spark, folder)), "mean", "deviation")
    return made.withColumns({p: F.round(p, 4) for p in ("p10", "p25", "p50", "p75", "p90")})


@_add(_with(_SCORED, "SELECT pair_id, score FROM z WHERE y = 0 AND score >= 0.5 ORDER BY score DESC, pair_id LIMIT 10"))
def top_false_positives(spark: SparkSession, folder: str) -> DataFrame:
    return mt.false_positives(scored(spark, folder), 0.5, top=10).select("pair_id", "score")


@_add(_with(_SCORED, "SELECT pair_id, score FROM z WHERE y = 1 AND score < 0.5 ORDER BY score, pair_id LIMIT 10"))
def top_false_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mt.false_negatives(scored(spark, folder), 0.5, top=10).select("pair_id", "score")


@_add(_with(_SCORED, "SELECT pair_id, score FROM z WHERE y = 0 ORDER BY score DESC, pair_id LIMIT 50"))
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return sp.hard_negatives(scored(spark, folder), 50).select("pair_id", "score")


@_add(_with(_SCORED, "SELECT sum((y = 0)::int)::bigint AS negatives, sum((y = 1)::int)::bigint AS positives, sum((y = 0 AND score >= 0.5)::int)::bigint AS fp, sum((y = 1 AND score < 0.5)::int)::bigint AS fn, round(sum((y = 0 AND score >= 0.5)::int)::double / sum((y = 0)::int), 6) AS fp_share, round(sum((y = 1 AND score < 0.5)::int)::double / sum((y = 1)::int), 6) AS fn_share FROM z"))
def error_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _round(mt.error_rates(scored(spark, folder), 0.5), "fp_share", "fn_share")


@_add(_with(_SCORED, "SELECT pair_id, a, b, score, '' AS veredito, '' AS comentario FROM z WHERE y = 0 AND score >= 0.26 AND score >= 0.9 ORDER BY score DESC, pair_id LIMIT 200"))
def audit_export(spark: SparkSession, folder: str) -> DataFrame:
    return mt.audit_sheet(scored(spark, folder), columns=["pair_id", "a", "b", "score", "spec_a"])


_TWICE = ", ".join(f"e{s} AS (SELECT {s} AS s, sum(y) AS p, sum(1 - y) AS n FROM z GROUP BY 1), k{s} AS (SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM e{s} WINDOW w AS (ORDER BY s DESC))" for s in ("score", "other"))


_EACH = " UNION ALL ".join(f"SELECT '{s}' AS modelo, sum(n * (tp - p) + 0.5 * n * p) / max(np * nn) AS roc, sum(p * tp::double / (tp + fp)) / max(np) AS ap, coalesce(max(tp::double / np) FILTER (tp::double / (tp + fp) >= 0.2), 0) AS rp FROM k{s}" for s in ("score", "other"))


@_add(_with(_SCORED + ", " + _TWICE + f", m AS ({_EACH}), b AS (SELECT * FROM m WHERE modelo = 'score')", "SELECT m.modelo, round(m.roc, 6) AS roc_auc, round(m.ap, 6) AS average_precision, round(m.rp, 6) AS recall, round(m.roc - b.roc, 6) AS delta_roc_auc, round(m.ap - b.ap, 6) AS delta_average_precision, round(m.rp - b.rp, 6) AS delta_recall FROM m, b"))
def compare_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking metrics of both scores over the same pairs, recall at a precision of 0.2, and how far each is from the first."""
    base = scored(spark, folder)
    return _round(mt.comparison(base, ["score", "other"], 0.2), "roc_auc", "average_precision", "recall", "delta_roc_auc", "delta_average_precision", "delta_recall").withColumnRenamed("model", "modelo")


@_add(_with(_SCORED + ", " + _TWICE + ", m AS (" + " UNION ALL ".join(f"SELECT '{s}' AS model, sum(p * tp::double / (tp + fp)) / max(np) AS average_precision FROM k{s}" for s in ("score", "other")) + ")", "SELECT model, round(average_precision, 6) AS average_precision, row_number() OVER w AS position, round(average_precision - lead(average_precision) OVER w, 6) AS lead, coalesce(average_precision - lead(average_precision) OVER w >= 0.01, false) AS decides FROM m WINDOW w AS (ORDER BY average_precision DESC, model)"))
def model_ranking(spark: SparkSession, folder: str) -> DataFrame:
    base = scored(spark, folder)
    models = [mt.average_precision(base.select("y", F.col(n).alias("score"))).withColumn("model", F.lit(n)) for n in ("score", "other")]
    return _round(mt.ranking(models[0].unionByName(models[1])), "average_precision", "lead")


@_add(_with(_SCORED + ", i AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, covar_pop({c}, y) / (stddev_pop({c}) * stddev_pop(y) + 1e-12) AS importance FROM z" for c in ("score", "other")) + "), s AS (SELECT feature, importance, greatest(importance, 0) / nullif(sum(greatest(importance, 0)) OVER (), 0) AS share FROM i)", "SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS position, round(coalesce(share, 0), 6) AS share, round(least(1, sum(coalesce(share, 0)) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)), 6) AS running FROM s"))
def cumulative_importance(spark: SparkSession, folder: str) -> DataFrame:
    found = mt.label_correlations(scored(spark, folder), ["score", "other"]).withColumnRenamed("correlation", "importance")
    return _round(mt.cumulative_importance(found), "share", "running").drop("importance")


@_add(_with(_SCORED, "SELECT CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, y, count(*) AS n FROM z GROUP BY 1, 2"))
def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).groupBy(mt.at_threshold(0.5).alias("pred"), "y").agg(F.count("*").alias("n"))
