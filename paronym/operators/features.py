"""The wide feature table of name pairs, block by block.

Blocks are added in staged projections, so that no single projection grows past
what the code generator takes.  Pairs go in as ``clean_pairs`` gives them; the
order and names of the columns are pinned in ``feature_names``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import hashed_vector, string_similarities
from ..functions.composite import DRIVERS, directional_score
from ..functions.similarity import (
    anagram_similarity,
    common_prefix,
    common_substring,
    common_suffix,
    contains_other,
    cosine,
    edit_similarity,
    hamming_similarity,
    jaccard,
    matches_words,
    norm,
    overlap,
    phonetic_matches,
    phonetic_similarity,
    ratio,
    token_metrics,
)
from ..functions.term_vectors import Terms, char_grams, item_cosines, itself, stem_grams, stem_lists, text_cosines
from ..functions.text import (
    NOISE_WORDS,
    activity_kind,
    base_form,
    char_ngrams,
    collapse_repeats,
    compact_form,
    has_digit,
    literal_and_cardinal,
    longest,
    phonetic_key,
    simhash64,
    spec_items,
    spec_stems,
    spec_tokens,
    strict_form,
    tokens,
)
from ..session import cut_lineage
from .lookups import char_words, fitted_vocabulary, name_lookup, with_class_priors, word_terms


def stop_words() -> list[str]:
    """Words of descriptions that say nothing: those of the language, as Spark lists them, without accents, and of the trade."""
    language = StopWordsRemover.loadDefaultStopWords("portuguese")
    bare = ["".join(ch for ch in unicodedata.normalize("NFD", w) if not unicodedata.combining(ch)) for w in language]
    return sorted({*language, *bare, *NOISE_WORDS})


#: An encoder gives the vector column of a text column; ``unit`` asks for vectors of length 1.
Encoder = Callable[..., Column]


@dataclass(frozen=True)
class Fitted:
    """What the features look up: token frequencies, class-pair priors, the classes with a column of their own, stop words of descriptions, term weights, an encoder.

    The term weights ``(term, idf)`` of words and of characters are fitted on
    the stemmed descriptions of both sides; without them they are fitted on the
    pairs at hand.
    """

    frequencies: DataFrame
    priors: DataFrame
    classes: tuple[int, ...]
    stop_words: tuple[str, ...] = ()
    words: DataFrame | None = None
    chars: DataFrame | None = None
    encoder: Encoder = hashed_vector


# Names of the columns by block.
GRAPHIC = [
    "graf_levenshtein", "graf_jaro", "graf_jaro_winkler", "graf_damerau", "graf_jaccard_bigram", "graf_jaccard_trigram", "graf_overlap_trigram",
    "graf_lcs_norm", "graf_prefix_norm", "graf_suffix_norm", "graf_len_ratio", "graf_len_diff_abs", "graf_contains", "graf_anagram",
]
PHONETIC = [
    "fon_global_sim", "fon_key_eq", "fon_key_lev_sim", "fon_after_dedup_eq", "fon_token_mean", "fon_token_max", "fon_token_eq_share",
]
TOKEN = [
    "n_tokens_a", "n_tokens_b", "n_tokens_diff", "n_tokens_common", "n_tokens_excl_a", "n_tokens_excl_b", "brand_word_exact_overlap_any",
    "brand_word_exact_overlap_count", "brand_cross_token_substring_len", "brand_cross_token_substring_norm", "brand_cross_token_cov_min",
    "tok_jaccard", "tok_overlap", "tok_fuzzy",
]
NUMERAL = [
    "num_has_digits", "num_orto_best", "num_orto_worst", "num_orto_spread", "num_fon_best", "num_fon_worst", "num_fon_spread",
]
#: Columns of the composite score and the fields that they hold; columns of what drives it.
COMPOSITE = {"ofta_final": "final", "ofta_orto": "orto", "ofta_fon": "fon", "ofta_token": "token", "ofta_anagram": "anagram", "ofta_fuzzy": "fuzzy"}
DRIVER_COLUMNS = {"none": "ofta_driver_geral", "orto": "ofta_driver_ortografia", "fon": "ofta_driver_fonética", "fuzzy": "ofta_driver_aproximação", "overlap": "ofta_driver_inclusão", "token": "ofta_driver_palavras"}
SPEC = [
    "spec_lex_jaccard", "spec_lex_overlap", "spec_lex_n_common", "spec_lex_n_excl_a", "spec_lex_n_excl_b", "spec_lex_n_total_a", "spec_lex_n_total_b",
    "spec_lex_size_ratio", "spec_lex_size_diff_abs", "spec_lex_idf_avg_common",
]
KIND = [
    "spec_same_activity_kind", "spec_any_misto", "spec_kind_a_produto", "spec_kind_a_servico", "spec_kind_b_produto", "spec_kind_b_servico",
]
INTERACTION = [
    "inter_nome_x_spec_word", "inter_nome_x_spec_emb", "inter_nome_x_spec_max", "inter_nome_x_same_cls", "inter_spec_x_same_cls",
    "inter_nome_alto_e_spec_alta", "inter_nome_alto_e_spec_baixa", "inter_nome_baixo_e_spec_alta", "inter_classe_diff_mas_emb_alto",
    "inter_classe_igual_e_spec_proxima", "inter_proxy_nome", "inter_proxy_spec",
]
GENERIC = [
    "name_generic_share_a", "name_generic_share_b", "name_generic_share_max", "name_unique_token_a", "name_unique_token_b", "shared_unique_count",
    "shared_unique_jaccard", "shared_token_idf_max", "shared_token_idf_mean", "shared_only_generics",
]
CONTAIN = [
    "contain_a_in_b", "contain_b_in_a", "contain_after_strip_a_in_b", "contain_after_strip_b_in_a", "contain_radical_share",
    "contain_radical_share_norm",
]
RADICAL = [
    "radical_a_len", "radical_b_len", "radical_lev_sim", "radical_phonetic_eq", "lev_pure_norm", "lev_pure_jaro_winkler", "lev_pure_size_diff_abs",
]
AGAINST = [
    "against_distinct_market", "against_only_generic_overlap", "against_size_disparity", "against_unique_strong_a", "against_unique_strong_b",
]
COSINE = [
    "spec_cosine_tfidf_word", "spec_cosine_tfidf_char", "spec_cosine_emb", "brand_emb_cosine", "brand_emb_cosine_normalized", "brand_emb_norm_max",
]
ADVANCED = [
    "spec_item_max_cosine_tfidf", "spec_item_top3_mean_cosine", "spec_item_align_score", "brand_a_token_in_spec_b", "brand_b_token_in_spec_a",
    "cls_pair_prior_pos", "cls_pair_chi2_strength", "brand_longest_common_substring_norm", "fon_concat_metaphone_eq", "brand_simhash_hamming_norm",
]


def class_columns(classes: tuple[int, ...]) -> list[str]:
    sides = [f"cls_{s}_top_{c}" for s in "ab" for c in (*classes, "other")]
    return ["cls_same", "cls_diff_abs", "cls_a_known", "cls_b_known", *sides]


def feature_names(classes: tuple[int, ...]) -> list[str]:
    """All columns in their order: 162 with 15 classes."""
    return [
        *GRAPHIC, *PHONETIC, *TOKEN, *NUMERAL, *COMPOSITE, *DRIVER_COLUMNS.values(), *SPEC, *KIND, *class_columns(classes), *INTERACTION, *GENERIC, *CONTAIN, *RADICAL, *AGAINST, *COSINE,
        *ADVANCED,
    ]


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _num(c: Column) -> Column:
    return c.cast("double")


def _words(text: Column, stop_words: tuple[str, ...]) -> Column:
    return spec_tokens(text, list(stop_words) or ["\u0000"])


def stemmed(texts: DataFrame, text: str, stop_words: tuple[str, ...]) -> DataFrame:
    """``(text, stems, stem_text)`` of each distinct text: its words without stop words, stemmed, in order; and these joined by blanks.

    A word is stemmed once a task.
    """
    each = texts.select(F.col(text)).distinct()
    return each.select(text, stem_lists(_words(F.col(text), stop_words)).alias("stems")).withColumn("stem_text", F.array_join("stems", " "))


def with_stems(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Add ``sa_toks`` and ``sb_toks``, the stems of both descriptions."""
    return df.withColumns({f"s{s}_toks": stem_lists(_words(F.col(f"spec_{s}"), fitted.stop_words)) for s in "ab"})


def spec_stem_table(pairs: DataFrame, fitted: Fitted) -> DataFrame:
    """``(spec, stems, stem_text)`` of every distinct description of either side."""
    return stemmed(pairs.select(F.explode(F.array("spec_a", "spec_b")).alias("spec")), "spec", fitted.stop_words)


def description_weights(pairs: DataFrame, fitted: Fitted, units: Callable[[str], Column], terms: Terms, size: int) -> DataFrame:
    """``(term, tf, df, idf)`` of the stemmed descriptions of both sides, copies counted."""
    words = pairs.select(F.explode(F.array("spec_a", "spec_b")).alias("spec")).select(_words(F.col("spec"), fitted.stop_words).alias("words"))
    texts = words.select(F.array_join(stem_lists("words"), " ").alias("spec"))
    return cut_lineage(fitted_vocabulary(texts.select(units("spec").alias("units")), "units", terms, max_terms=size))


def fit_term_weights(pairs: DataFrame, fitted: Fitted) -> Fitted:
    """``fitted`` with the weights of words and characters of the stemmed descriptions of both sides, copies counted."""
    return replace(fitted, words=description_weights(pairs, fitted, word_terms, itself, 20_000), chars=description_weights(pairs, fitted, char_words, char_grams, 10_000))


def with_forms(pairs: DataFrame) -> DataFrame:
    """Normal forms that several blocks share."""
    made = {}
    for s in "ab":
        c = F.col(s)
        made |= {f"{s}_base": base_form(c), f"{s}_strict": strict_form(c), f"{s}_compact": compact_form(c), f"{s}_toks": tokens(c)}
    return pairs.withColumns(made)


def graphic(df: DataFrame) -> DataFrame:
    a, b = F.col("a_strict"), F.col("b_strict")
    top = F.greatest(F.length(a), F.length(b))
    edits = df.select("a_strict", "b_strict").distinct().withColumn("e", string_similarities("a_strict", "b_strict"))
    df = df.join(edits, ["a_strict", "b_strict"])
    bi, tri = (char_ngrams(a, 2), char_ngrams(b, 2)), (char_ngrams(a, 3), char_ngrams(b, 3))
    e = F.col("e")
    made = [
        edit_similarity(a, b), e["jaro"], e["jaro_winkler"], e["damerau"], jaccard(*bi), jaccard(*tri), overlap(*tri), e["subsequence"],
        _share(common_prefix(a, b), top), _share(common_suffix(a, b), top), ratio(F.length(a), F.length(b)), _num(F.abs(F.length(a) - F.length(b))),
        _flag(contains_other(a, b)), anagram_similarity(F.col("a"), F.col("b")),
    ]
    return df.withColumns(dict(zip(GRAPHIC, made))).drop("e")


def phonetic(df: DataFrame) -> DataFrame:
    a, b = F.col("a_compact"), F.col("b_compact")
    df = df.withColumns({"ka": phonetic_key(a), "kb": phonetic_key(b), "pm": phonetic_matches(F.col("a_toks"), F.col("b_toks"))})
    ka, kb, pm = F.col("ka"), F.col("kb"), F.col("pm")
    near = F.lit(1.0) - F.levenshtein(ka, kb) / F.greatest(F.length(ka), F.length(kb), F.lit(1))
    made = [phonetic_similarity(F.col("a_base"), F.col("b_base")), _flag((ka == kb) & (ka != "")), near, _flag(collapse_repeats(a) == collapse_repeats(b)), pm["mean"], pm["max"], pm["equal_share"]]
    return df.withColumns(dict(zip(PHONETIC, made))).drop("pm")


def token_block(df: DataFrame) -> DataFrame:
    a, b = F.col("a_toks"), F.col("b_toks")
    common = F.size(F.array_intersect(a, b))

    def cell(x: Column, y: Column) -> Column:
        n = common_substring(x, y)
        return F.struct(n.alias("n"), F.least(n / F.length(x), n / F.length(y)).alias("cover"), F.greatest(F.length(x), F.length(y)).alias("top"))

    cells = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: cell(x, y))))
    best = F.aggregate(cells, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("cover"), F.lit(1).alias("top")), lambda s, c: F.when((c["n"] > s["n"]) | ((c["n"] == s["n"]) & (c["cover"] > s["cover"])), c).otherwise(s))
    df = df.withColumns({"best": best, "tm": token_metrics(a, b)})
    m, t = F.col("best"), F.col("tm")
    made = [F.size(a), F.size(b), F.abs(F.size(a) - F.size(b)), common, F.size(F.array_except(a, b)), F.size(F.array_except(b, a)), (common > 0).cast("int"), common, m["n"], m["n"] / m["top"], m["cover"], t["jaccard"], t["overlap"], t["fuzzy"]]
    return df.withColumns({n: _num(c) for n, c in zip(TOKEN, made)}).drop("best", "tm")


def numeral(df: DataFrame) -> DataFrame:
    df = df.withColumns({"la": literal_and_cardinal(F.col("a")), "lb": literal_and_cardinal(F.col("b")), "hd": has_digit(F.col("a")) | has_digit(F.col("b"))})
    sides = [(F.col("la")["literal"], F.col("b_base")), (F.col("la")["cardinal"], F.col("b_base")), (F.col("a_base"), F.col("lb")["literal"]), (F.col("a_base"), F.col("lb")["cardinal"])]
    df = df.withColumns({"no": F.when(F.col("hd"), F.array(*[edit_similarity(strict_form(x), strict_form(y)) for x, y in sides])), "nf": F.when(F.col("hd"), F.array(*[phonetic_similarity(x, y) for x, y in sides]))})
    zero = F.lit(0.0)
    made = [_flag(F.col("hd"))]
    for c in ("no", "nf"):
        high, low = F.array_max(c), F.array_min(c)
        made += [F.coalesce(high, zero), F.coalesce(low, zero), F.coalesce(high - low, zero)]
    return df.withColumns(dict(zip(NUMERAL, made))).drop("la", "lb", "hd", "no", "nf")


def composite(df: DataFrame) -> DataFrame:
    df = directional_score(df, "a_base", "b_base", "ofta")
    s = F.col("ofta")
    made = {name: s[field] for name, field in COMPOSITE.items()} | {name: _flag(s["driver"] == DRIVERS[d]) for d, name in DRIVER_COLUMNS.items()}
    return df.withColumns(made).drop("ofta")


def spec_block(df: DataFrame) -> DataFrame:
    """Words of the descriptions; ``sa_toks`` and ``sb_toks`` are the stems."""
    df = df.withColumns({f"s{x}": F.array_distinct(f"s{x}_toks") for x in "ab"} | {f"k{x}x": activity_kind(F.col(f"s{x}_toks")) for x in "ab"})
    a, b = F.col("sa"), F.col("sb")
    common = F.size(F.array_intersect(a, b))
    shared = df.select("pair_id", F.explode(F.array_intersect("sa", "sb")).alias("term"))
    docs = df.select(F.explode(F.array("sa", "sb")).alias("s"))
    total = docs.agg(F.count("*").alias("n"))
    idf = docs.select(F.explode("s").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 3").crossJoin(F.broadcast(total)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    mean = shared.join(idf, "term", "left").groupBy("pair_id").agg(F.avg(F.coalesce("idf", F.lit(0.0))).alias("idf_mean"))
    df = df.join(mean, "pair_id", "left")
    na, nb = F.size(a), F.size(b)
    made = [jaccard(a, b), overlap(a, b), common, na - common, nb - common, na, nb, ratio(na, nb), F.abs(na - nb), F.coalesce("idf_mean", F.lit(0.0))]
    ka, kb = F.col("kax"), F.col("kbx")
    kinds = [(ka == kb) & (ka != "misto"), (ka == "misto") | (kb == "misto"), ka == "produto", ka == "servico", kb == "produto", kb == "servico"]
    return df.withColumns({n: _num(c) for n, c in zip(SPEC, made)} | {n: _flag(c) for n, c in zip(KIND, kinds)}).drop("idf_mean", "kax", "kbx")


def class_block(df: DataFrame, fitted: Fitted) -> DataFrame:
    a, b = F.col("class_a"), F.col("class_b")
    known = (a >= 0, b >= 0)
    made = [_flag((a == b) & known[0]), F.when(known[0] & known[1], _num(F.abs(a - b))).otherwise(F.lit(0.0)), _flag(known[0]), _flag(known[1])]
    for side, ok in ((a, known[0]), (b, known[1])):
        made += [_flag(side == c) for c in fitted.classes] + [_flag(ok & ~side.isin(*fitted.classes) if fitted.classes else ok)]
    return df.withColumns(dict(zip(class_columns(fitted.classes), made)))


def generic_block(df: DataFrame, fitted: Fitted) -> DataFrame:
    looked = name_lookup(df, fitted.frequencies)
    for s in "ab":
        df = df.join(looked.select(F.col("name").alias(s), F.col("looked").alias(f"l{s}")), s, "left")
    df = df.withColumns({f"t{s}": F.transform(f"l{s}", lambda x: x["t"]) for s in "ab"} | {f"i{s}": F.transform(F.filter(f"l{s}", lambda x: ~x["generic"]), lambda x: x["t"]) for s in "ab"})
    la, ta, tb, ia, ib = (F.col(c) for c in ("la", "ta", "tb", "ia", "ib"))
    shared = F.array_intersect(ta, tb)
    # Every shared token stands in the first list with its figures.
    df = df.withColumn("sh", F.array_distinct(F.transform(F.filter(la, lambda x: F.array_contains(tb, x["t"])), lambda x: F.struct(x["t"].alias("t"), x["idf"].alias("idf"), x["generic"].alias("generic")))))
    sh = F.col("sh")
    share = lambda n, t: F.size(F.filter(F.col(n), lambda x: x["generic"])) / F.greatest(F.size(t), F.lit(1))
    idfs = F.transform(sh, lambda x: x["idf"])
    both = F.size(F.array_intersect(ia, ib))
    made = [
        share("la", ta), share("lb", tb), F.greatest(share("la", ta), share("lb", tb)), F.size(F.array_distinct(ia)), F.size(F.array_distinct(ib)), both,
        both / F.greatest(F.size(F.array_union(ia, ib)), F.lit(1)), F.coalesce(F.array_max(idfs), F.lit(0.0)),
        _share(F.aggregate(idfs, F.lit(0.0), lambda s, x: s + x), F.size(sh)), (F.size(sh) > 0) & F.forall(sh, lambda x: x["generic"]),
    ]
    df = df.withColumns({n: _num(c) for n, c in zip(GENERIC, made)} | {"n_shared": F.size(shared)})
    a, b = F.col("a_compact"), F.col("b_compact")
    ja, jb = F.array_join(ia, ""), F.array_join(ib, "")
    prefix = common_prefix(a, b)
    contain = [(a != "") & F.contains(b, a), (b != "") & F.contains(a, b), (ja != "") & F.contains(jb, ja), (jb != "") & F.contains(ja, jb), prefix, prefix / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))]
    df = df.withColumns({n: _num(c) for n, c in zip(CONTAIN, contain)})

    def radical(own: Column, every: Column) -> Column:
        large = F.filter(own, lambda t: F.length(t) >= 4)
        return F.when(F.size(large) > 0, longest(large)).when(F.size(own) > 0, longest(own)).otherwise(longest(every))

    df = df.withColumns({"ra": radical(ia, ta), "rb": radical(ib, tb), "pa": F.array_join(ia, " "), "pb": F.array_join(ib, " ")})
    words = df.select(F.col("ra").alias("x"), F.col("rb").alias("y")).union(df.select("pa", "pb")).distinct().withColumn("jw", string_similarities("x", "y")["jaro_winkler"])
    for x, y, n in (("ra", "rb", "jr"), ("pa", "pb", "jp")):
        df = df.join(words.select(F.col("x").alias(x), F.col("y").alias(y), F.col("jw").alias(n)), [x, y])
    ra, rb, pa, pb = (F.col(c) for c in ("ra", "rb", "pa", "pb"))
    none = lambda x, y, c: F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(c)
    lengths = F.abs(F.length(a) - F.length(b))
    pure = [
        F.length(ra), F.length(rb), none(ra, rb, F.greatest(edit_similarity(ra, rb), F.col("jr"))), none(ra, rb, _flag(phonetic_key(ra) == phonetic_key(rb))),
        none(pa, pb, edit_similarity(pa, pb)), none(pa, pb, F.col("jp")), F.abs(F.length(pa) - F.length(pb)),
    ]
    other = (F.col("class_a") >= 0) & (F.col("class_b") >= 0) & (F.col("class_a") != F.col("class_b"))
    strong = lambda l, t: F.size(F.array_distinct(F.filter(F.transform(F.filter(F.col(l), lambda x: ~x["generic"] & (F.length(x["t"]) >= 4) & (x["idf"] >= 3.0)), lambda x: x["t"]), lambda t_: ~F.array_contains(t, t_))))
    against = {"against_only_generic_overlap": _flag((F.col("shared_only_generics") == 1) & other), "against_size_disparity": _flag((lengths >= 15) & (F.col("n_shared") == 0)), "against_unique_strong_a": _num(strong("la", tb)), "against_unique_strong_b": _num(strong("lb", ta))}
    return df.withColumns({n: _num(c) for n, c in zip(RADICAL, pure)} | against).drop("ra", "rb", "pa", "pb", "jr", "jp", "sh", "n_shared")


def item_matches(df: DataFrame, fitted: Fitted, key: str = "pair_id") -> DataFrame:
    """``(key, best, top3, aligned)`` of the character cosines between the stemmed items of both descriptions.

    Items without a stem are dropped.  They are weighted by the fitted
    characters; a pair's items meet inside one batch, so nothing is shuffled.
    """
    chars = description_weights(df, fitted, char_words, char_grams, 10_000) if fitted.chars is None else fitted.chars
    items = lambda c: F.filter(F.transform(spec_items(F.col(c)), lambda x: _words(x, fitted.stop_words)), lambda x: F.size(x) > 0)
    return item_cosines(df.select(key, items("spec_a").alias("ia"), items("spec_b").alias("ib")), key, "ia", "ib", chars, stem_grams)


def _vector_cosines(df: DataFrame, encoder: Encoder, a: Column, b: Column, out: str, longest_norm: str | None = None, unit: bool = False) -> DataFrame:
    if compare := getattr(encoder, "cosines", None):
        made = df.withColumn("v0", compare(a, b, unit=unit))
        return made.withColumns({out: F.col("v0")["cosine"]} | ({longest_norm: F.col("v0")["length"]} if longest_norm else {})).drop("v0")
    made = df.withColumns({"v0": encoder(a, unit=unit), "v1": encoder(b, unit=unit)}).withColumn(out, F.coalesce(cosine(F.col("v0"), F.col("v1")), F.lit(0.0)))
    if longest_norm:
        made = made.withColumn(longest_norm, F.coalesce(F.greatest(norm(F.col("v0")), norm(F.col("v1"))), F.lit(0.0)))
    return made.drop("v0", "v1")


#: Characters of a name that an encoder sees.
ENCODED = 200


def cosine_block(df: DataFrame, specs: DataFrame, fitted: Fitted) -> DataFrame:
    """Cosines of the stemmed descriptions, by words, by characters and by the encoder's vectors, and of the names' vectors."""
    made = cut_lineage(df.select("pair_id", "a", "b", "a_base", "b_base", *[F.array_join(f"s{s}_toks", " ").alias(f"t{s}") for s in "ab"]))
    for name, units, terms, vocabulary in (("spec_cosine_tfidf_word", word_terms, itself, fitted.words), ("spec_cosine_tfidf_char", char_words, char_grams, fitted.chars)):
        found = text_cosines(made.select("pair_id", units("ta").alias("ua"), units("tb").alias("ub")), "pair_id", "ua", "ub", vocabulary, terms)
        made = made.join(found.withColumnRenamed("cosine", name), "pair_id")
    made = _vector_cosines(made, fitted.encoder, F.col("ta"), F.col("tb"), "spec_cosine_emb", unit=True)
    for columns, out, length in ((("a", "b"), "brand_emb_cosine", "brand_emb_norm_max"), (("a_base", "b_base"), "brand_emb_cosine_normalized", None)):
        made = _vector_cosines(made, fitted.encoder, *[F.substring(c, 1, ENCODED) for c in columns], out, length)
    return made.select("pair_id", *COSINE)


def advanced(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Item matches, names in descriptions, class priors, concatenated names; ``ia`` and ``ib`` are the informative tokens."""
    df = df.join(item_matches(df.select("pair_id", "spec_a", "spec_b"), fitted), "pair_id", "left")
    df = with_class_priors(df, fitted.priors)
    own = {s: spec_stems(F.col(f"s{s}_toks")) for s in "ab"}
    anchored = lambda mine, words: F.size(F.filter(F.filter(mine, lambda t: F.length(t) >= 4), lambda t: matches_words(t, words)))
    a, b = F.col("a_compact"), F.col("b_compact")
    zero = F.lit(0.0)
    made = [
        F.coalesce("best", zero), F.coalesce("top3", zero), F.coalesce("aligned", zero), anchored(F.col("ia"), own["b"]), anchored(F.col("ib"), own["a"]),
        F.col("prior"), F.col("strength"), common_substring(a, b) / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)),
        _flag((phonetic_key(a) == phonetic_key(b)) & (a != "") & (b != "")), hamming_similarity(simhash64(a), simhash64(b)),
    ]
    return df.withColumns({n: _num(c) for n, c in zip(ADVANCED, made)})


def interactions(df: DataFrame) -> DataFrame:
    n, same, emb = F.col("ofta_final"), F.col("cls_same"), F.col("spec_cosine_emb")
    s = F.greatest("spec_cosine_tfidf_word", "spec_cosine_tfidf_char", "spec_cosine_emb")
    made = [
        n * F.col("spec_cosine_tfidf_word"), n * emb, n * s, n * same, s * same, _flag((n >= 0.70) & (s >= 0.60)), _flag((n >= 0.70) & (s <= 0.30)),
        _flag((n <= 0.40) & (s >= 0.60)), (1 - same) * emb, same * s, n, s,
    ]
    market = _flag((F.col("class_a") >= 0) & (F.col("class_b") >= 0) & (F.col("class_a") != F.col("class_b")) & (emb < 0.30))
    return df.withColumns(dict(zip(INTERACTION, made)) | {"against_distinct_market": market})


BLOCKS = ("graphic", "phonetic", "token", "numeral", "composite", "spec", "class", "generic", "cosine", "advanced")


def prepared(pairs: DataFrame, fitted: Fitted) -> tuple[DataFrame, DataFrame, Fitted]:
    """The pairs with the forms that blocks share, the stems of every description, and ``fitted`` with term weights."""
    if fitted.words is None or fitted.chars is None:
        fitted = fit_term_weights(pairs, fitted)
    return cut_lineage(with_stems(with_forms(pairs), fitted)), spec_stem_table(pairs, fitted), fitted


def feature_block(name: str, forms: DataFrame, specs: DataFrame, fitted: Fitted, generic: DataFrame | None = None) -> DataFrame:
    """One of ``BLOCKS`` as ``(pair_id, *columns)``; ``generic`` brings informative tokens and gives them to ``advanced``."""
    if name == "cosine":
        return cosine_block(forms, specs, fitted)
    if name == "advanced":
        held = feature_block("generic", forms, specs, fitted) if generic is None else generic
        made = advanced(forms.join(held.select("pair_id", "ia", "ib"), "pair_id"), fitted)
    else:
        made = {
            "graphic": graphic, "phonetic": phonetic, "token": token_block, "numeral": numeral, "composite": composite, "spec": spec_block,
            "class": lambda d: class_block(d, fitted), "generic": lambda d: generic_block(d, fitted),
        }[name](forms)
    names = feature_names(fitted.classes)
    more = ["ia", "ib"] if name == "generic" else []
    return made.select("pair_id", *[F.col(f"`{c}`") for c in made.columns if c in names], *more)


def enriched(pairs: DataFrame, fitted: Fitted) -> DataFrame:
    """``pairs``, whose ``pair_id`` is unique, with all features; a null never comes out of a feature.

    Every block is written once and the blocks meet by key: one plan of all of
    them would take longer to optimize than to run.
    """
    forms, specs, fitted = prepared(pairs, fitted)
    df, generic = pairs, None
    for name in BLOCKS:
        part = cut_lineage(feature_block(name, forms, specs, fitted, generic))
        if name == "generic":
            generic = part
            part = part.drop("ia", "ib")
        df = df.join(part, "pair_id")
    return interactions(df).select(*pairs.columns, *[F.col(f"`{c}`") for c in feature_names(fitted.classes)])
