"""Queries over the pair table: forms, similarities, the composite score, what is known about the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.arrow import stems, string_similarities
from ..functions.composite import CARDINAL, DRIVERS, LITERAL, directional_score, likeness, symmetric_score
from ..operators import pairs as pr
from ..sources.tables import table
from . import sqltext as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return pr.clean_pairs(table(spark, folder, "marca_pares"))


def _with(ctes: str, select: str) -> str:
    return f"WITH {q.PAIRS}{ctes} {select}"


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _unary(name: str, column: Callable[[Column, Column], Column], sql: str, source: str = "a", ctes: str = "") -> None:
    """A query of one form of a name; ``sql`` sees the raw text x, its base form n and its words t."""
    QUERIES[name] = lambda spark, folder: clean(spark, folder).select("pair_id", F.col(source).alias("x")).select("pair_id", column(F.col("x"), tx.base_form(F.col("x"))).alias("valor"))
    forms = f", f AS (SELECT pair_id, {source} AS x, {q.base(source)} AS n FROM pares), w AS (SELECT *, {q.tokens('n')} AS t FROM f){ctes}"
    SQL[name] = _with(forms, f"SELECT pair_id, {sql} AS valor FROM w")


_joined = lambda c: F.array_join(c, "|")
_join = lambda c: f"array_to_string({c}, '|')"

_unary("base_normalize", lambda X, N: N, "n")
_unary("collapse_repeats", lambda X, N: tx.collapse_repeats(X), q.collapsed("x"))
_unary("strict_clean", lambda X, N: tx.strict_form(X), q.strict("x"))
_unary("digits_literal", lambda X, N: tx.digits_as_words(X), q.literal("x"))
_unary("digits_cardinal", lambda X, N: tx.numbers_as_words(X), q.cardinal("x"))
_unary("literal_cardinal_forms", lambda X, N: F.concat_ws("|", tx.literal_and_cardinal(X)["literal"], tx.literal_and_cardinal(X)["cardinal"]), f"{q.base(q.literal('x'))} || '|' || {q.base(q.cardinal('x'))}")
_unary("phonetic_key", lambda X, N: tx.phonetic_key(N), q.key("n"))
_unary("phonetic_code", lambda X, N: sim.phonetic_code(tx.tokens(X)), f"array_to_string(list_transform(t, lambda v_: {q.key('v_')}), '')")
_unary("tokenize", lambda X, N: _joined(tx.tokens(X)), _join("t"))
_unary("name_tokens", lambda X, N: _joined(tx.name_tokens(X)), _join("list_filter(t, lambda v_: length(v_) >= 2 AND NOT regexp_matches(v_, '^[0-9]+$'))"))
_unary("structural_filter", lambda X, N: _joined(tx.without_structural(tx.tokens(X))), _join(q.without_structural("t")))
_unary("char_bigrams", lambda X, N: _joined(F.array_sort(tx.char_ngrams(N, 2))), _join(f"list_sort({q.ngrams('n', 2)})"))
_unary("char_trigrams", lambda X, N: _joined(F.array_sort(tx.char_ngrams(N, 3))), _join(f"list_sort({q.ngrams('n', 3)})"))
_unary("padded_trigrams", lambda X, N: _joined(tx.padded_trigrams(N)), _join("CASE WHEN n = '' THEN [] ELSE list_transform(range(1, length(n) + 3), lambda i_: substr('  ' || n || '  ', i_, 3)) END"))
_unary("longest_token", lambda X, N: tx.longest(tx.tokens(X)), "coalesce(list_reduce(t, lambda s_, v_: CASE WHEN length(v_) > length(s_) THEN v_ ELSE s_ END, ''), '')")

_SPEC = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
_unary("spec_items", lambda X, N: _joined(tx.spec_items(X)), _join("list_filter(list_transform(regexp_split_to_array(x, '[;\\n]+'), lambda v_: regexp_replace(v_, '^\\s+|\\s+$', '', 'g')), lambda v_: v_ <> '')"), "spec_a")
_SPEC_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(x)), '[;,\\[\\]()/:.\\-]', ' ', 'g'), '\\s+'), lambda v_: length(v_) > 2 AND NOT regexp_matches(v_, '^[0-9]+$') AND v_ NOT IN ({q.words(tx.NOISE_WORDS)}))"
_unary("spec_tokens", lambda X, N: _joined(tx.spec_tokens(X, tx.NOISE_WORDS)), _join(_SPEC_TOKENS), "spec_a")
_unary("spec_stem_set", lambda X, N: _joined(F.array_sort(tx.spec_stems(tx.spec_tokens(X, tx.NOISE_WORDS)))), _join(f"list_sort(list_distinct({_SPEC_TOKENS}))"), "spec_a")
_count = lambda anchors: f"len(list_filter(s, lambda v_: regexp_matches(v_, '^({'|'.join(anchors)})')))"
_unary(
    "activity_kind", lambda X, N: tx.activity_kind(tx.spec_tokens(X, tx.NOISE_WORDS)),
    "CASE WHEN p = 0 AND v = 0 THEN 'misto' WHEN p >= 2 * greatest(v, 1) THEN 'produto' WHEN v >= 2 * greatest(p, 1) THEN 'servico' ELSE 'misto' END", "spec_a",
    f", z AS (SELECT pair_id, {_SPEC_TOKENS} AS s FROM w), y AS (SELECT pair_id, {_count(tx.PRODUCT_ANCHORS)} AS p, {_count(tx.SERVICE_ANCHORS)} AS v FROM z)",
)
SQL["activity_kind"] = SQL["activity_kind"].rsplit("FROM w", 1)[0] + "FROM y"
SQL["spec_items"], SQL["spec_tokens"], SQL["spec_stem_set"], SQL["activity_kind"] = (SQL[k].replace("SELECT pair_id, spec_a AS x", "SELECT pair_id, sa AS x").replace("lower(coalesce(spec_a, ''))", "lower(coalesce(sa, ''))") for k in ("spec_items", "spec_tokens", "spec_stem_set", "activity_kind"))


def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the names' 64-bit sketches; the hash is Spark's own."""
    return clean(spark, folder).select("pair_id", _r(sim.hamming_similarity(tx.simhash64(tx.compact_form(F.col("a"))), tx.simhash64(tx.compact_form(F.col("b"))))).alias("valor"))


def stemmed_words(spark: SparkSession, folder: str) -> DataFrame:
    """Stem of every distinct word of the descriptions; each word is stemmed once."""
    words = clean(spark, folder).select(F.explode(F.array("spec_a", "spec_b")).alias("s")).select(F.explode(F.split(F.regexp_replace(F.lower("s"), "[^\\p{L}]+", " "), " ")).alias("palavra")).where("palavra <> ''").distinct()
    return words.select("palavra", stems("palavra").alias("radical"))


QUERIES["simhash_similarity"] = simhash
QUERIES["stemmed_words"] = stemmed_words

# Two names: x and y are strict forms, nx and ny base forms, tx and ty words, gx and gy grams.
_TWO = f""", f AS (SELECT pair_id, a, b, {q.base('a')} AS nx, {q.base('b')} AS ny, {q.strict('a')} AS x, {q.strict('b')} AS y FROM pares),
g AS (SELECT *, {q.tokens('nx')} AS tx, {q.tokens('ny')} AS ty, {q.ngrams('x', 2)} AS bx, {q.ngrams('y', 2)} AS by_, {q.ngrams('x', 3)} AS cx, {q.ngrams('y', 3)} AS cy FROM f),
h AS (SELECT *, array_to_string(list_transform(tx, lambda v_: {q.key('v_')}), '') AS kx, array_to_string(list_transform(ty, lambda v_: {q.key('v_')}), '') AS ky,
      array_to_string(list_sort({q.chars('x')}), '') AS ox, array_to_string(list_sort({q.chars('y')}), '') AS oy FROM g)"""


def _binary(name: str, columns: dict[str, tuple[Callable[..., Column], str]]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = clean(spark, folder).select("pair_id", "a", "b").withColumns({"nx": tx.base_form(F.col("a")), "ny": tx.base_form(F.col("b")), "x": tx.strict_form(F.col("a")), "y": tx.strict_form(F.col("b"))})
        df = df.withColumns({"tx": tx.tokens(F.col("a")), "ty": tx.tokens(F.col("b"))})
        named = [F.col(c) for c in ("x", "y", "nx", "ny", "tx", "ty")]
        return df.select("pair_id", *[_r(c(*named)).alias(n) for n, (c, _) in columns.items()])

    QUERIES[name] = run
    SQL[name] = _with(_TWO, "SELECT pair_id, " + ", ".join(f"round(({s})::double, 6) AS {n}" for n, (_, s) in columns.items()) + " FROM h")


_PREFIX = "list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda i_: substr(x, 1, i_) = substr(y, 1, i_)))"
_SUFFIX = "list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda i_: right(x, i_) = right(y, i_)))"
_binary("lev_similarity", {"valor": (lambda A, B, NA, NB, TA, TB: sim.edit_similarity(A, B), q.edit("x", "y"))})
_binary("ngram_jaccard", {"bi": (lambda A, B, NA, NB, TA, TB: sim.jaccard(tx.char_ngrams(A, 2), tx.char_ngrams(B, 2)), q.jaccard("bx", "by_")), "tri": (lambda A, B, NA, NB, TA, TB: sim.jaccard(tx.char_ngrams(A, 3), tx.char_ngrams(B, 3)), q.jaccard("cx", "cy"))})
_binary("ngram_overlap", {"tri": (lambda A, B, NA, NB, TA, TB: sim.overlap(tx.char_ngrams(A, 3), tx.char_ngrams(B, 3)), q.overlap("cx", "cy"))})
_binary("anagram", {"valor": (lambda A, B, NA, NB, TA, TB: sim.anagram_similarity(F.col("a"), F.col("b")), q.edit("ox", "oy"))})
_binary("phonetic_similarity", {"valor": (lambda A, B, NA, NB, TA, TB: sim.phonetic_similarity(NA, NB), q.edit("kx", "ky"))})
_binary("prefix_suffix", {"prefixo": (lambda A, B, NA, NB, TA, TB: sim.common_prefix(A, B), _PREFIX), "sufixo": (lambda A, B, NA, NB, TA, TB: sim.common_suffix(A, B), _SUFFIX)})
_SHORT, _LONG = "CASE WHEN length(x) <= length(y) THEN x ELSE y END", "CASE WHEN length(x) <= length(y) THEN y ELSE x END"
_binary("lcs_substring", {"valor": (lambda A, B, NA, NB, TA, TB: sim.common_substring(A, B), f"coalesce(list_max(list_transform(range(1, length({_SHORT}) + 1), lambda i_: coalesce(list_max(list_filter(range(1, length({_SHORT}) - i_ + 2), lambda n_: contains({_LONG}, substr({_SHORT}, i_, n_)))), 0))), 0)")})
_binary("containment", {"contem": (lambda A, B, NA, NB, TA, TB: sim.contains_other(A, B).cast("int"), "CASE WHEN x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) THEN 1 ELSE 0 END"), "razao": (lambda A, B, NA, NB, TA, TB: sim.ratio(F.length(A), F.length(B)), "CASE WHEN length(x) = 0 AND length(y) = 0 THEN 1 WHEN length(x) = 0 OR length(y) = 0 THEN 0 ELSE least(length(x), length(y))::double / greatest(length(x), length(y)) END")})
_binary("token_sets", {"comuns": (lambda A, B, NA, NB, TA, TB: F.size(F.array_intersect(TA, TB)), "len(list_intersect(list_distinct(tx), list_distinct(ty)))"), "so_a": (lambda A, B, NA, NB, TA, TB: F.size(F.array_except(TA, TB)), "len(list_filter(list_distinct(tx), lambda v_: NOT list_contains(ty, v_)))"), "so_b": (lambda A, B, NA, NB, TA, TB: F.size(F.array_except(TB, TA)), "len(list_filter(list_distinct(ty), lambda v_: NOT list_contains(tx, v_)))"), "jaccard": (lambda A, B, NA, NB, TA, TB: sim.jaccard(TA, TB), q.jaccard("tx", "ty")), "inclusao": (lambda A, B, NA, NB, TA, TB: sim.overlap(TA, TB), q.overlap("tx", "ty"))})


def string_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro, Jaro-Winkler, Damerau and common subsequence of the strict forms, computed once a distinct pair."""
    df = clean(spark, folder).select("pair_id", tx.strict_form(F.col("a")).alias("x"), tx.strict_form(F.col("b")).alias("y"))
    made = df.select("x", "y").distinct().withColumn("e", string_similarities("x", "y"))
    return df.join(made, ["x", "y"]).select("pair_id", *[_r(F.col("e")[n]).alias(n) for n in ("jaro", "jaro_winkler", "damerau")])


def common_subsequences(spark: SparkSession, folder: str) -> DataFrame:
    df = clean(spark, folder).select("pair_id", tx.strict_form(F.col("a")).alias("x"), tx.strict_form(F.col("b")).alias("y"))
    made = df.select("x", "y").distinct().withColumn("e", string_similarities("x", "y"))
    return df.join(made, ["x", "y"]).select("pair_id", _r(F.col("e")["subsequence"]).alias("valor"))


QUERIES |= {"string_distances": string_distances, "lcs_subsequence": common_subsequences}
SQL["string_distances"] = _with(_TWO, f"SELECT pair_id, round({q.guarded('x', 'y', 'jaro_similarity(x, y)')}, 6) AS jaro, round({q.guarded('x', 'y', 'jaro_winkler_similarity(x, y)')}, 6) AS jaro_winkler, round({q.guarded('x', 'y', '1.0::double - damerau_levenshtein(x, y)::double / greatest(length(x), length(y))')}, 6) AS damerau FROM h")


# Soft token overlap and the composite score in SQL, from two texts in base form nx and ny of a relation.
def _score_ctes(source: str, tag: str) -> str:
    best = f"list_max(list_transform(gm, lambda o_: greatest(CASE WHEN p_.k = o_.k THEN 1.0::double ELSE {q.edit('p_.k', 'o_.k')} END, {q.edit('p_.w', 'o_.w')})))"
    gain = f"CASE WHEN list_contains(wm, p_.w) THEN 1.0::double ELSE coalesce({best}, 0.0) END"
    keyed = lambda t: f"list_transform({t}, lambda v_: {{'w': v_, 'k': {q.key('v_')}}})"
    return f""", {tag}1 AS (SELECT *, {q.strict('nx')} AS x, {q.strict('ny')} AS y, {q.tokens('nx')} AS w1, {q.tokens('ny')} AS w2 FROM {source}),
{tag}2 AS (SELECT *, {keyed('w1')} AS g1, {keyed('w2')} AS g2, array_to_string(list_sort({q.chars('x')}), '') AS ox, array_to_string(list_sort({q.chars('y')}), '') AS oy FROM {tag}1),
{tag}3 AS (SELECT *, CASE WHEN len(w1) <= len(w2) THEN g1 ELSE g2 END AS gf, CASE WHEN len(w1) <= len(w2) THEN g2 ELSE g1 END AS gm, CASE WHEN len(w1) <= len(w2) THEN w2 ELSE w1 END AS wm,
    array_to_string(list_transform(g1, lambda v_: v_.k), '') AS k1, array_to_string(list_transform(g2, lambda v_: v_.k), '') AS k2 FROM {tag}2),
{tag}4 AS (SELECT *, {q.edit('x', 'y')} AS o, {q.edit('ox', 'oy')} AS g, {q.edit('k1', 'k2')} AS f, {q.jaccard('w1', 'w2')} AS j, CASE WHEN len(w1) = 0 AND len(w2) = 0 THEN 1.0 ELSE {q.overlap('w1', 'w2')} END AS v,
    CASE WHEN len(w1) = 0 AND len(w2) = 0 THEN 1.0::double WHEN len(gf) = 0 THEN 0.0 ELSE list_sum(list_transform(list_transform(gf, lambda p_: {gain}), lambda s_: CASE WHEN s_ >= 0.85 THEN 1.0::double ELSE s_ END)) / len(gf) END AS z,
    least(len(w1), len(w2)) AS few, greatest(len(w1), len(w2)) AS many, CASE WHEN len(w1) = 1 THEN g1[1] ELSE g2[1] END AS one, CASE WHEN len(w1) = 1 THEN g2 ELSE g1 END AS oth FROM {tag}3),
{tag}5 AS (SELECT *, greatest(j, v, z) AS t, coalesce(z >= 1.0 AND few = 1 AND (o >= 0.2 OR f >= 0.25) AND length(one.w) = 4 AND list_max(list_transform(oth, lambda u_: length(u_.w))) >= 4
    AND len(list_filter(oth, lambda u_: u_.k = one.k)) > 0 AND len(list_filter(oth, lambda u_: levenshtein(u_.w, one.w) <= 1)) > 0, false) AS c FROM {tag}4),
{tag}6 AS (SELECT *, CASE WHEN g >= 0.95 THEN greatest(o, f, t, g) ELSE greatest(o, f, t) END AS d, (o >= 0.8 OR f >= 0.8) AS st, g >= 0.95 AS an, (j = 0 AND v = 0) AS ap FROM {tag}5),
{tag} AS (SELECT *, (0.4::double * ((o + f + t + g) / 4) + 0.6::double * d)
    * CASE WHEN NOT st AND NOT an AND NOT c AND ap AND o <= 0.5 AND f <= 0.5 THEN 0.1::double ELSE 1.0 END
    * CASE WHEN NOT st AND NOT an AND NOT c AND ap AND z >= 0.9 AND greatest(o, f) < 0.55 THEN 0.1::double ELSE 1.0 END
    * CASE WHEN NOT c AND ap AND z >= 0.9 AND o < 0.35 THEN 0.1::double ELSE 1.0 END
    * CASE WHEN NOT c AND ap AND z >= 0.9 AND few = 1 AND many >= 2 AND greatest(o, f) < 0.7 THEN 0.1::double ELSE 1.0 END
    * CASE WHEN NOT an AND NOT c AND j <= 0.2 AND z >= 0.5 AND o < 0.5 AND f < 0.8 THEN 0.1::double ELSE 1.0 END
    * CASE WHEN NOT st AND NOT an AND ap AND len(w1) = 1 AND len(w2) = 1 THEN 0.1::double ELSE 1.0 END AS final,
    CASE WHEN d = f THEN '{DRIVERS['fon']}' WHEN d = o THEN '{DRIVERS['orto']}' WHEN d = z AND z > v THEN '{DRIVERS['fuzzy']}' WHEN d = v AND v > j THEN '{DRIVERS['overlap']}' WHEN d = t THEN '{DRIVERS['token']}' ELSE '{DRIVERS['none']}' END AS driver FROM {tag}6)"""


_BASED = f", based AS (SELECT pair_id, {q.base('a')} AS nx, {q.base('b')} AS ny FROM pares)"
_COMPONENTS = {"final": "final", "orto": "o", "fon": "f", "token": "t", "anagram": "g", "fuzzy": "z"}


def token_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = clean(spark, folder).select("pair_id", sim.token_metrics(tx.tokens(F.col("a")), tx.tokens(F.col("b"))).alias("m"))
    return df.select("pair_id", *[_r(F.col("m")[x]).alias(x) for x in ("jaccard", "overlap", "fuzzy")])


def phonetic_token_match(spark: SparkSession, folder: str) -> DataFrame:
    df = clean(spark, folder).select("pair_id", sim.phonetic_matches(tx.tokens(F.col("a")), tx.tokens(F.col("b"))).alias("m"))
    return df.select("pair_id", *[_r(F.col("m")[x]).alias(x) for x in ("mean", "max", "equal_share")])


def heuristic_single(spark: SparkSession, folder: str) -> DataFrame:
    """Score and components of the first name against the second."""
    s = F.col("s")
    return directional_score(clean(spark, folder), "a", "b", "s").select("pair_id", *[_r(s[n]).alias(n) for n in _COMPONENTS], s["driver"].alias("driver"))


def heuristic_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    """The better of all readings and directions."""
    s = F.col("s")
    return symmetric_score(clean(spark, folder), "a", "b", "s").select("pair_id", _r(s["final"]).alias("final"), s["driver"].alias("driver"), s["via"].alias("via"))


def heuristic_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """The score from 0 to 100."""
    return likeness(clean(spark, folder), "a", "b", "valor").select("pair_id", _r(F.col("valor")).alias("valor"))


def heuristic_top_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty pairs of different names that score highest."""
    s = F.col("s")
    scored = symmetric_score(clean(spark, folder), "a", "b", "s").select("pair_id", _r(s["final"]).alias("final"), s["driver"].alias("driver"))
    return scored.where("final < 1").orderBy(F.desc("final"), "pair_id").limit(20)


QUERIES |= {"token_metrics": token_metrics, "phonetic_token_match": phonetic_token_match, "heuristic_single": heuristic_single, "heuristic_symmetric": heuristic_symmetric, "heuristic_likeness": heuristic_likeness, "heuristic_top_pairs": heuristic_top_pairs}
SQL["token_metrics"] = _with(_BASED + _score_ctes("based", "s"), "SELECT pair_id, round(j::double, 6) AS jaccard, round(v::double, 6) AS overlap, round(z, 6) AS fuzzy FROM s")
SQL["heuristic_single"] = _with(_BASED + _score_ctes("based", "s"), "SELECT pair_id, " + ", ".join(f"round({c}::double, 6) AS {n}" for n, c in _COMPONENTS.items()) + ", driver FROM s")
_MATCH = f"list_max(list_transform(list_filter(g2, lambda o_: o_.k <> ''), lambda o_: CASE WHEN o_.k = p_.k THEN 1.0::double ELSE {q.edit('p_.k', 'o_.k')} END))"
_BESTS = f"list_transform(g1, lambda p_: CASE WHEN p_.k = '' THEN 0.0::double ELSE coalesce({_MATCH}, 0.0) END)"
_NONE = "CASE WHEN len(g1) = 0 OR len(g2) = 0 THEN 0.0::double ELSE"
SQL["phonetic_token_match"] = _with(_BASED + _score_ctes("based", "s"), f"SELECT pair_id, round({_NONE} list_sum({_BESTS}) / len(g1) END, 6) AS mean, round({_NONE} list_max({_BESTS}) END, 6) AS max, round({_NONE} len(list_filter(g1, lambda p_: p_.k <> '' AND len(list_filter(g2, lambda o_: o_.k = p_.k)) > 0))::double / len(g1) END, 6) AS equal_share FROM s")
_READINGS = f""", readings AS (
    SELECT pair_id, 0 AS i, '{LITERAL}' AS via, {q.base('a')} AS nx, {q.base('b')} AS ny FROM pares WHERE NOT regexp_matches(a || b, '[0-9]')
    UNION ALL SELECT pair_id, 1, '{LITERAL}', {q.base('b')}, {q.base('a')} FROM pares WHERE NOT regexp_matches(a || b, '[0-9]')
    UNION ALL SELECT pair_id, 0, '{LITERAL}', {q.base(q.literal('a'))}, {q.base('b')} FROM pares WHERE regexp_matches(a || b, '[0-9]')
    UNION ALL SELECT pair_id, 1, '{CARDINAL}', {q.base(q.cardinal('a'))}, {q.base('b')} FROM pares WHERE regexp_matches(a || b, '[0-9]')
    UNION ALL SELECT pair_id, 2, '{LITERAL}', {q.base(q.literal('b'))}, {q.base('a')} FROM pares WHERE regexp_matches(a || b, '[0-9]')
    UNION ALL SELECT pair_id, 3, '{CARDINAL}', {q.base(q.cardinal('b'))}, {q.base('a')} FROM pares WHERE regexp_matches(a || b, '[0-9]'))"""
_BEST = _READINGS + _score_ctes("readings", "s") + ", best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY final DESC, i) = 1)"
SQL["heuristic_symmetric"] = _with(_BEST, "SELECT pair_id, round(final, 6) AS final, driver, via FROM best")
SQL["heuristic_likeness"] = _with(_BEST, "SELECT pair_id, round(final * 100, 6) AS valor FROM best")
SQL["heuristic_top_pairs"] = _with(_BEST, "SELECT pair_id, round(final, 6) AS final, driver FROM best WHERE round(final, 6) < 1 ORDER BY 2 DESC, 1 LIMIT 20")


# The data set itself.
def clean_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder)


def eda_summary(spark: SparkSession, folder: str) -> DataFrame:
    made = pr.summary(clean(spark, folder))
    return made.select("pares", "positivos", *[_r(F.col(c)).alias(c) for c in ("taxa", "taxa_mesma_classe", "taxa_outra_classe", "parte_mesma_classe")])


def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pr.null_counts(table(spark, folder, "marca_pares"), [*pr.REQUIRED, "label"])


def dropped_rows(spark: SparkSession, folder: str) -> DataFrame:
    return pr.dropped_rows(table(spark, folder, "marca_pares"))


_TEXTS = {"a": "a", "b": "b", "spec_a": "sa", "spec_b": "sb"}
_STATS = ["media", "desvio", "minimo", "p25", "p50", "p75", "maximo"]


def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return pr.length_stats(clean(spark, folder), list(_TEXTS)).select("coluna", *[_r(F.col(c)).alias(c) for c in _STATS])


def top_classes(spark: SparkSession, folder: str) -> DataFrame:
    return pr.top_classes(clean(spark, folder))


def class_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and positives by both classes, by the first and overall."""
    made = clean(spark, folder).rollup("class_a", "class_b").agg(F.grouping_id().alias("nivel"), F.count("*").alias("pares"), F.sum("label").alias("positivos"))
    return made.select("class_a", "class_b", F.col("nivel").cast("int").alias("nivel"), "pares", "positivos")


QUERIES |= {f.__name__: f for f in (clean_pairs, eda_summary, null_counts, dropped_rows, length_stats, top_classes, class_rollup)}
SQL["clean_pairs"] = _with("", "SELECT pair_id, a, b, ca AS class_a, cb AS class_b, sa AS spec_a, sb AS spec_b, y AS label FROM pares")
SQL["eda_summary"] = _with("", "SELECT count(*) AS pares, sum(y)::bigint AS positivos, round(avg(y), 6) AS taxa, round(avg(y) FILTER (ca = cb), 6) AS taxa_mesma_classe, round(avg(y) FILTER (ca <> cb), 6) AS taxa_outra_classe, round(avg((ca = cb)::int), 6) AS parte_mesma_classe FROM pares")
SQL["null_counts"] = " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos FROM marca_pares" for c in (*pr.REQUIRED, "label"))
SQL["dropped_rows"] = _with("", "SELECT (SELECT count(*) FROM marca_pares) AS linhas, (SELECT count(*) FROM pares) AS mantidas, (SELECT count(*) FROM marca_pares) - (SELECT count(*) FROM pares) AS descartadas")
SQL["length_stats"] = _with("", " UNION ALL ".join(f"SELECT '{n}' AS coluna, round(avg(length({c})), 6) AS media, round(stddev_samp(length({c})), 6) AS desvio, min(length({c}))::double AS minimo, quantile_cont(length({c}), 0.25)::double AS p25, quantile_cont(length({c}), 0.5)::double AS p50, quantile_cont(length({c}), 0.75)::double AS p75, max(length({c}))::double AS maximo FROM pares" for n, c in _TEXTS.items()))
SQL["top_classes"] = _with("", "SELECT classe, count(*) AS n FROM (SELECT ca AS classe FROM pares UNION ALL SELECT cb FROM pares) WHERE classe >= 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
SQL["class_rollup"] = _with("", "SELECT ca AS class_a, cb AS class_b, grouping(ca, cb)::int AS nivel, count(*) AS pares, sum(y)::bigint AS positivos FROM pares GROUP BY ROLLUP (ca, cb)")


def embedding_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each vector and the next."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    made = e.join(near, "vec_id")
    return made.select("vec_id", F.round(sim.cosine(F.col("embedding"), F.col("other")), 5).alias("cosseno"), F.round(sim.shifted_cosine(F.col("embedding"), F.col("other")), 5).alias("cosseno_eps"), F.round(F.greatest(sim.norm(F.col("embedding")), sim.norm(F.col("other"))), 5).alias("norma"))


QUERIES["embedding_cosine"] = embedding_cosine
_D = "list_transform({}, lambda v_: v_::double)"
_NORM = "sqrt(list_sum(list_transform({0}, lambda v_: v_ * v_)))"
SQL["embedding_cosine"] = f"""WITH e AS (SELECT vec_id, {_D.format('embedding')} AS u FROM embeddings), p AS (SELECT x.vec_id, x.u, y.u AS w FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(u, w), 5) AS cosseno, round(list_dot_product(u, w) / (({_NORM.format('u')} + 1e-9) * ({_NORM.format('w')} + 1e-9)), 5) AS cosseno_eps, round(greatest({_NORM.format('u')}, {_NORM.format('w')}), 5) AS norma FROM p"""
