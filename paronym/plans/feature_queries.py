"""Blocks of the feature table as queries of their own, with SQL where it can give them, and what is drawn from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.composite import DRIVERS
from ..operators import features as ft
from ..operators import lookups as lk
from ..operators import metrics as mt
from ..operators import pairs as pr
from ..operators import sampling as sp
from ..operators.report import evaluation_report
from . import sqltext as q
from .lookup_queries import _CELLS, _CURVE, _NAME_TOKENS, _SCORED, scored
from .pair_queries import _BASED, _BESTS, _NONE, _PREFIX, _SUFFIX, _TWO, _score_ctes, _with, clean

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, key: str = "pair_id") -> DataFrame:
    return df.select(key, *[F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in df.columns if c != key])


def _block(name: str, columns: dict[str, str], ctes: str, source: str) -> None:
    """A block that needs nothing fitted; ``columns`` are its columns and their SQL over ``source``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(ft.feature_block(name, ft.with_forms(clean(spark, folder)), None, ft.Fitted(None, None, ())))

    QUERIES[f"block_{name}"] = run
    SQL[f"block_{name}"] = _with(ctes, "SELECT pair_id, " + ", ".join(f"round(({s})::double, 6) AS {c}" for c, s in columns.items()) + f" FROM {source}")


# The longest common subsequence by rows of bits, for strings of up to 60 characters.
_FULL = "((1::bigint << length(x)::int) - 1)"
_MASK = "coalesce(list_sum(list_transform(range(0, length(x)), lambda i_: CASE WHEN substr(x, i_ + 1, 1) = c_ THEN 1::bigint << i_::int ELSE 0::bigint END)), 0)::bigint"
_STEP = f"((v_ + (v_ & m_)) | (v_ - (v_ & m_))) & {_FULL}"
SUBSEQUENCE = f"(length(x) - bit_count(list_reduce(list_transform({q.chars('y')}, lambda c_: {_MASK}), lambda v_, m_: {_STEP}, {_FULL})))"
_LCS = q.guarded("x", "y", f"{SUBSEQUENCE}::double / greatest(length(x), length(y))").replace("THEN 1.0 WHEN", "THEN 0.0 WHEN", 1)

_top = "greatest(length(x), length(y))"
_over = lambda s: f"CASE WHEN {_top} = 0 THEN 0.0 ELSE ({s})::double / {_top} END"
_block("graphic", dict(zip(ft.GRAPHIC, [
    q.edit("x", "y"), q.guarded("x", "y", "jaro_similarity(x, y)"), q.guarded("x", "y", "jaro_winkler_similarity(x, y)"), q.guarded("x", "y", f"1.0::double - damerau_levenshtein(x, y)::double / {_top}"),
    q.jaccard("bx", "by_"), q.jaccard("cx", "cy"), q.overlap("cx", "cy"), _LCS, _over(_PREFIX), _over(_SUFFIX),
    q.guarded("x", "y", f"least(length(x), length(y))::double / {_top}"), "abs(length(x) - length(y))",
    "(x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)))::int", q.edit("ox", "oy"),
])), _TWO, "h")

_SCORE = _BASED + _score_ctes("based", "s")
_COMPACT = _SCORE + f""", c AS (SELECT *, replace(nx, ' ', '') AS cx, replace(ny, ' ', '') AS cy FROM s),
d AS (SELECT *, {q.key('cx')} AS ka, {q.key('cy')} AS kb FROM c)"""
_block("phonetic", dict(zip(ft.PHONETIC, [
    q.edit("k1", "k2"), "(ka = kb AND ka <> '')::int", "1.0 - levenshtein(ka, kb)::double / greatest(length(ka), length(kb), 1)", f"({q.collapsed('cx')} = {q.collapsed('cy')})::int",
    f"{_NONE} list_sum({_BESTS}) / len(g1) END", f"{_NONE} list_max({_BESTS}) END", f"{_NONE} len(list_filter(g1, lambda p_: p_.k <> '' AND len(list_filter(g2, lambda o_: o_.k = p_.k)) > 0))::double / len(g1) END",
])), _COMPACT, "d")

_RUN = "coalesce(list_max(list_transform(range(1, length(v_) + 1), lambda i_: coalesce(list_max(list_filter(range(1, length(v_) - i_ + 2), lambda n_: contains(u_, substr(v_, i_, n_)))), 0))), 0)"
_CELL = f"flatten(list_transform(w1, lambda v_: list_transform(w2, lambda u_: {{'n': {_RUN}, 'c': {_RUN}::double / greatest(length(v_), length(u_))}})))"
_TOKEN = _SCORE + f", c AS (SELECT *, list_max({_CELL}) AS best, len(list_intersect(list_distinct(w1), list_distinct(w2))) AS common FROM s)"
_only = lambda a, b: f"len(list_filter(list_distinct({a}), lambda t_: NOT list_contains({b}, t_)))"
_block("token", dict(zip(ft.TOKEN, [
    "len(w1)", "len(w2)", "abs(len(w1) - len(w2))", "common", _only("w1", "w2"), _only("w2", "w1"), "(common > 0)::int", "common",
    "coalesce(best.n, 0)", "coalesce(best.c, 0)", "coalesce(best.c, 0)", "j", "v", "z",
])), _TOKEN, "c")

_NUMERAL = f""", f AS (SELECT pair_id, a, b, regexp_matches(a || b, '[0-9]') AS hd, {q.base('a')} AS nx, {q.base('b')} AS ny FROM pares),
r AS (SELECT pair_id, {q.base(q.literal('a'))} AS x, ny AS y FROM f WHERE hd UNION ALL SELECT pair_id, {q.base(q.cardinal('a'))}, ny FROM f WHERE hd
    UNION ALL SELECT pair_id, nx, {q.base(q.literal('b'))} FROM f WHERE hd UNION ALL SELECT pair_id, nx, {q.base(q.cardinal('b'))} FROM f WHERE hd),
t AS (SELECT pair_id, {q.strict('x')} AS x, {q.strict('y')} AS y, array_to_string(list_transform({q.tokens('x')}, lambda v_: {q.key('v_')}), '') AS kx, array_to_string(list_transform({q.tokens('y')}, lambda v_: {q.key('v_')}), '') AS ky FROM r),
e AS (SELECT pair_id, {q.edit('x', 'y')} AS o, {q.edit('kx', 'ky')} AS f FROM t), m AS (SELECT pair_id, max(o) AS ho, min(o) AS lo, max(f) AS hf, min(f) AS lf FROM e GROUP BY 1),
n AS (SELECT f.pair_id, f.hd, m.* EXCLUDE (pair_id) FROM f LEFT JOIN m USING (pair_id))"""
_block("numeral", dict(zip(ft.NUMERAL, ["hd::int", *[f"coalesce({c}, 0)" for c in ("ho", "lo", "ho - lo", "hf", "lf", "hf - lf")]])), _NUMERAL, "n")

_FIELDS = {"final": "final", "orto": "o", "fon": "f", "token": "t", "anagram": "g", "fuzzy": "z"}
_block("composite", {c: _FIELDS[f] for c, f in ft.COMPOSITE.items()} | {f'"{c}"': f"(driver = '{DRIVERS[d]}')::int" for d, c in ft.DRIVER_COLUMNS.items()}, _SCORE, "s")


def block_class(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the classes; those of the most frequent ones are named by their rank."""
    pairs = clean(spark, folder)
    top = tuple(r.classe for r in pr.top_classes(pairs).collect())  # 15 rows
    made = ft.feature_block("class", pairs, None, ft.Fitted(None, None, top))
    return _rounded(made.withColumnsRenamed({f"cls_{s}_top_{c}": f"cls_{s}_rank_{i + 1}" for s in "ab" for i, c in enumerate(top)}))


_TOP = ", t AS (SELECT list(classe ORDER BY n DESC, classe) AS top FROM (SELECT classe, count(*) AS n FROM (SELECT ca AS classe FROM pares UNION ALL SELECT cb FROM pares) WHERE classe >= 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15))"
_SIDES = ", ".join(f"coalesce(c{s} = top[{i}], false)::double AS cls_{s}_rank_{i}" for s in "ab" for i in range(1, 16)) + ", " + ", ".join(f"(c{s} >= 0 AND NOT list_contains(top, c{s}))::double AS cls_{s}_top_other" for s in "ab")
QUERIES["block_class"] = block_class
SQL["block_class"] = _with(_TOP, f"SELECT pair_id, (ca = cb AND ca >= 0)::double AS cls_same, CASE WHEN ca >= 0 AND cb >= 0 THEN abs(ca - cb)::double ELSE 0 END AS cls_diff_abs, (ca >= 0)::double AS cls_a_known, (cb >= 0)::double AS cls_b_known, {_SIDES} FROM pares, t")

# The common subsequence of the pair queries can be checked as well.
SQL["lcs_subsequence"] = _with(_TWO, f"SELECT pair_id, round({_LCS}, 6) AS valor FROM h")


def block_columns(spark: SparkSession, folder: str) -> DataFrame:
    """How many columns each group of the feature table has (A25, A26)."""
    names = spark.createDataFrame([(c,) for c in ft.feature_names(tuple(range(1, 16)))], "feature string")
    return names.groupBy(mt.group_of(F.col("feature")).alias("grupo")).agg(F.count("*").alias("colunas"))


_COUNTS = {"grafia": 14, "fonetica": 7, "palavras": 14, "numeros": 7, "composto": 12, "especificacao": 16, "classe": 36, "interacao": 12, "genericos": 28, "cosseno": 6, "avancado": 10}
QUERIES["block_columns"] = block_columns
SQL["block_columns"] = "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {n}::bigint)" for g, n in _COUNTS.items()) + ") AS t(grupo, colunas)"


def block_generic(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of generic tokens, containment, radicals and signs against a collision."""
    pairs = clean(spark, folder)
    made = ft.feature_block("generic", ft.with_forms(pairs), None, ft.Fitted(lk.token_frequencies(pairs), None, ()))
    return _rounded(made.drop("ia", "ib"))


_longest = lambda t: f"coalesce(list_reduce({t}, lambda s_, v_: CASE WHEN length(v_) > length(s_) THEN v_ ELSE s_ END, ''), '')"
_radical = lambda own, every: f"CASE WHEN len(list_filter({own}, lambda v_: length(v_) >= 4)) > 0 THEN {_longest(f'list_filter({own}, lambda v_: length(v_) >= 4)')} WHEN len({own}) > 0 THEN {_longest(own)} ELSE {_longest(every)} END"
_texts = lambda items: f"list_transform({items}, lambda v_: v_.t)"
_LOOKED = f""",{_NAME_TOKENS},
tk AS (SELECT DISTINCT nome, list_filter({q.tokens(q.base('nome'))}, lambda v_: length(v_) >= 2 AND NOT regexp_matches(v_, '^[0-9]+$')) AS t FROM nomes),
ex AS (SELECT nome, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM tk),
lk AS (SELECT nome, list({{'t': token, 'i': idf, 'g': generic}} ORDER BY p) AS l FROM ex JOIN idf USING (token) GROUP BY 1),
p1 AS (SELECT pair_id, ca, cb, replace({q.base('a')}, ' ', '') AS cx, replace({q.base('b')}, ' ', '') AS cy, coalesce(x.l, []) AS la, coalesce(y.l, []) AS lb FROM pares LEFT JOIN lk x ON x.nome = a LEFT JOIN lk y ON y.nome = b),
p2 AS (SELECT *, {_texts('la')} AS ta, {_texts('lb')} AS tb, {_texts('list_filter(la, lambda v_: NOT v_.g)')} AS ia, {_texts('list_filter(lb, lambda v_: NOT v_.g)')} AS ib FROM p1),
p3 AS (SELECT *, list_distinct(list_filter(la, lambda v_: list_contains(tb, v_.t))) AS sh, len(list_intersect(list_distinct(ia), list_distinct(ib))) AS common,
    len(list_filter(la, lambda v_: v_.g))::double / greatest(len(ta), 1) AS ga, len(list_filter(lb, lambda v_: v_.g))::double / greatest(len(tb), 1) AS gb,
    array_to_string(ia, '') AS ja, array_to_string(ib, '') AS jb, array_to_string(ia, ' ') AS pa, array_to_string(ib, ' ') AS pb, {_radical('ia', 'ta')} AS ra, {_radical('ib', 'tb')} AS rb FROM p2),
p4 AS (SELECT *, (len(sh) > 0 AND len(list_filter(sh, lambda v_: NOT v_.g)) = 0) AS allg, (ca >= 0 AND cb >= 0 AND ca <> cb) AS apart, {_PREFIX.replace('(x', '(cx').replace('(y', '(cy').replace(' length(y)', ' length(cy)')} AS px FROM p3)"""
_both = lambda x, y, c: f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE {c} END"
_strong = lambda l, t: f"len(list_distinct(list_filter({_texts(f'list_filter({l}, lambda v_: NOT v_.g AND length(v_.t) >= 4 AND v_.i >= 3.0)')}, lambda v_: NOT list_contains({t}, v_))))"
_GENERIC = dict(zip([*ft.GENERIC, *ft.CONTAIN, *ft.RADICAL, *ft.AGAINST[1:]], [
    "ga", "gb", "greatest(ga, gb)", "len(list_distinct(ia))", "len(list_distinct(ib))", "common", "common::double / greatest(len(list_distinct(list_concat(ia, ib))), 1)",
    "coalesce(list_max(list_transform(sh, lambda v_: v_.i)), 0)", "CASE WHEN len(sh) = 0 THEN 0 ELSE list_sum(list_transform(sh, lambda v_: v_.i)) / len(sh) END", "allg::int",
    "(cx <> '' AND contains(cy, cx))::int", "(cy <> '' AND contains(cx, cy))::int", "(ja <> '' AND contains(jb, ja))::int", "(jb <> '' AND contains(ja, jb))::int", "px", "px::double / greatest(least(length(cx), length(cy)), 1)",
    "length(ra)", "length(rb)", _both("ra", "rb", f"greatest({q.edit('ra', 'rb')}, jaro_winkler_similarity(ra, rb))"), _both("ra", "rb", f"({q.key('ra')} = {q.key('rb')})::int"),
    _both("pa", "pb", q.edit("pa", "pb")), _both("pa", "pb", "jaro_winkler_similarity(pa, pb)"), "abs(length(pa) - length(pb))",
    "(allg AND apart)::int", "(abs(length(cx) - length(cy)) >= 15 AND len(list_intersect(list_distinct(ta), list_distinct(tb))) = 0)::int", _strong("la", "tb"), _strong("lb", "ta"),
]))
QUERIES["block_generic"] = block_generic
SQL["block_generic"] = _with(_LOOKED, "SELECT pair_id, " + ", ".join(f"round(({v})::double, 6) AS {c}" for c, v in _GENERIC.items()) + " FROM p4")


def _feature_table(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Graphic columns and two of the classes, with the label as ``y``."""
    pairs = clean(spark, folder)
    none = ft.Fitted(None, None, ())
    made = ft.feature_block("graphic", ft.with_forms(pairs), None, none).join(ft.feature_block("class", pairs, None, none), "pair_id").join(pairs.select("pair_id", F.col("label").alias("y")), "pair_id")
    return made, [*ft.GRAPHIC, "cls_same", "cls_diff_abs"]


_LONG = f"""WITH g AS ({SQL['block_graphic'].replace(', 6) AS graf_', ', 15) AS graf_')}), c AS ({SQL['block_class']}),
w AS (SELECT g.*, cls_same, cls_diff_abs, greatest(0, least(1, coalesce(label, 0))) AS y FROM g JOIN c USING (pair_id) JOIN marca_pares USING (pair_id)),
l AS (UNPIVOT w ON {', '.join([*ft.GRAPHIC, 'cls_same', 'cls_diff_abs'])} INTO NAME feature VALUE x)"""
_CORRELATION = "covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y) + 1e-12)"


def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, deviation and extremes of feature columns, and whether one is constant."""
    made = mt.feature_stats(*_feature_table(spark, folder))
    return made.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "lowest", "highest")], "constant")


def feature_label_corr(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of feature columns with the label."""
    return mt.label_correlations(*_feature_table(spark, folder)).select("feature", F.round("correlation", 6).alias("correlation"))


def importance_by_block(spark: SparkSession, folder: str) -> DataFrame:
    """Sum, mean, share and largest of the absolute correlations of each group (A23)."""
    found = mt.label_correlations(*_feature_table(spark, folder)).select("feature", F.abs("correlation").alias("importance"))
    return mt.importance_by_group(found).select("grupo", "colunas", *[F.round(c, 6).alias(c) for c in ("soma", "media", "parte")], "maior")


QUERIES |= {"feature_stats": feature_stats, "feature_label_corr": feature_label_corr, "importance_by_block": importance_by_block}
SQL["feature_stats"] = _LONG + " SELECT feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, stddev_pop(x) < 1e-9 AS constant FROM l GROUP BY 1"
SQL["feature_label_corr"] = _LONG + f" SELECT feature, round({_CORRELATION}, 6) AS correlation FROM l GROUP BY 1"
SQL["importance_by_block"] = _LONG + f""", k AS (SELECT feature, abs({_CORRELATION}) AS i, CASE WHEN feature LIKE 'graf_%' THEN 'grafia' ELSE 'classe' END AS grupo FROM l GROUP BY 1)
SELECT grupo, count(*) AS colunas, round(sum(i), 6) AS soma, round(avg(i), 6) AS media, round(sum(i) / (SELECT sum(i) FROM k), 6) AS parte, first(feature ORDER BY i DESC, feature) AS maior FROM k GROUP BY 1"""


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """120 pairs, 24 of them with label 1 (O4)."""
    return sp.stratified_union(clean(spark, folder), "pair_id", "label", 120, 24).select("pair_id", "label")


QUERIES["stratified_sample"] = stratified_sample
_PICK = "(SELECT pair_id, y AS label FROM pares WHERE y {0} ORDER BY md5(pair_id || ':42'), pair_id LIMIT {1})"
SQL["stratified_sample"] = _with("", f"SELECT * FROM {_PICK.format('= 1', 24)} UNION ALL SELECT * FROM {_PICK.format('<> 1', 96)}")


def mixup(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and labels blended row by row (P6)."""
    made = sp.mixed_up(scored(spark, folder).select("pair_id", "score", "other", "y"), "pair_id", ["score", "other"], "y")
    return _rounded(made)


QUERIES["mixup"] = mixup
_UNIT = "((('0x' || substr(md5(pair_id || ':{0}'), 1, 12))::bigint + 0.5::double) / (16::double ^ 12))"
SQL["mixup"] = _with(_SCORED + f""", n AS (SELECT *, row_number() OVER (ORDER BY md5(pair_id || ':42'), pair_id) AS r, row_number() OVER (ORDER BY md5(pair_id || ':43'), pair_id) AS s, {_UNIT.format(44)} ^ 5 AS u, {_UNIT.format(45)} ^ 5 AS v FROM z),
p AS (SELECT m.*, CASE WHEN m.u + m.v > 0 THEN m.u / (m.u + m.v) ELSE 1.0 END AS w, o.score AS os, o.other AS oo, o.y AS oy FROM n m JOIN n o ON o.s = m.r)""",
    "SELECT pair_id, round(w * score + (1 - w) * os, 6) AS score, round(w * other + (1 - w) * oo, 6) AS other, round(w * y + (1 - w) * oy, 6) AS y FROM p")


def verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The traffic light of the stored scores."""
    base = scored(spark, folder)
    one = mt.roc_auc(base).crossJoin(mt.average_precision(base)).crossJoin(mt.confusion(base, 0.5).select("recall", "f1")).crossJoin(mt.error_rates(base, 0.5).select("fn_share"))  # one row each
    return mt.verdict(one).withColumns({c: F.round(c, 6) for c in ("roc_auc", "average_precision", "recall", "f1", "fn_share")})


QUERIES["verdict"] = verdict
# The lights' limits, stated again, so that a wrong limit shows.
_LIGHT = "CASE WHEN {0} >= {1} THEN 'verde' WHEN {0} >= {2} THEN 'amarelo' ELSE 'vermelho' END AS cor_{0}"
_LIGHTS = ", ".join(_LIGHT.format(*x) for x in (("roc_auc", 0.90, 0.80), ("average_precision", 0.65, 0.30), ("recall", 0.85, 0.70), ("f1", 0.45, 0.30)))
SQL["verdict"] = _with(_CURVE + f""", c AS (SELECT {_CELLS.format('0.5')} FROM z), a AS (SELECT sum(n * (tp - p) + 0.5 * n * p) / max(np * nn) AS roc_auc, sum(p * tp::double / (tp + fp)) / max(np) AS average_precision FROM k),
m AS (SELECT a.*, tp::double / (tp + fn) AS recall, 2 * tp::double / (2 * tp + fp + fn) AS f1, fn::double / (tp + fn) AS fn_share FROM a, c), l AS (SELECT *, {_LIGHTS}, CASE WHEN fn_share > 0.30 THEN 'vermelho' ELSE 'verde' END AS cor_fn FROM m)""",
    "SELECT * REPLACE (round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fn_share, 6) AS fn_share), CASE WHEN list_contains([cor_roc_auc, cor_average_precision, cor_recall, cor_f1, cor_fn], 'vermelho') THEN 'não recomendado' WHEN list_contains([cor_roc_auc, cor_average_precision, cor_recall, cor_f1, cor_fn], 'amarelo') THEN 'monitorar' ELSE 'pronto' END AS veredito FROM l")


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation report of the stored scores, line by line (K10)."""
    lines = evaluation_report(scored(spark, folder).select("pair_id", "y", "score"))
    return spark.createDataFrame(list(enumerate(lines, 1)), "linha int, texto string")


QUERIES["report_lines"] = report_lines
