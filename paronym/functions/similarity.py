"""Similarities of two strings, token lists, sets and vectors, as column expressions.

Strings go in already normalised; nothing returns null for strings that aren't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import phonetic_key, strict_form


def once(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of the values, each computed a single time; inside lambdas nothing else keeps an expression from being repeated."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(held, lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]


def guarded(a: Column, b: Column, value: Column) -> Column:
    """1 for two empty strings, 0 for one, else ``value``."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(value)


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer string."""
    return once(lambda x, y: guarded(x, y, F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))), a, b)


def _sorted_chars(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def anagram_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the sorted characters of the strict forms."""
    return edit_similarity(_sorted_chars(strict_form(a)), _sorted_chars(strict_form(b)))


def phonetic_code(toks: Column) -> Column:
    return F.array_join(F.transform(toks, phonetic_key), "")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the words' joined phonetic keys."""
    return edit_similarity(phonetic_code(F.filter(F.split(a, " "), lambda t: t != "")), phonetic_code(F.filter(F.split(b, " "), lambda t: t != "")))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard(a: Column, b: Column) -> Column:
    """Common share of the union of two sets; 1 if both are empty."""
    return once(_jaccard, a, b)


def _overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def overlap(a: Column, b: Column) -> Column:
    """Common share of the smaller of two sets; 0 if either is empty."""
    return once(_overlap, a, b)


def _common_prefix(a: Column, b: Column) -> Column:
    least = F.least(F.length(a), F.length(b))
    return F.array_max(F.filter(F.sequence(F.lit(0), least), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    return once(_common_prefix, a, b)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def _common_substring(short: Column, long: Column) -> Column:
    found = lambda n: F.exists(F.sequence(F.lit(1), F.length(short) - n + 1), lambda i: F.contains(long, F.substring(short, i, n)))
    return F.when(F.length(short) == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), found)), F.lit(0)))


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common run: the lengths are few, so each is tried as a set of windows."""
    shorter = lambda x, y: F.length(x) <= F.length(y)
    return once(lambda x, y: once(_common_substring, F.when(shorter(x, y), x).otherwise(y), F.when(shorter(x, y), y).otherwise(x)), a, b)


def ratio(a: Column, b: Column) -> Column:
    """The smaller as a share of the larger; 1 for two zeros, 0 for one."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def contains_other(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _with_keys(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.struct(t.alias("t"), phonetic_key(t).alias("k")))


def _fuzzy(few: Column, many: Column) -> Column:
    """Mean over the first list's tokens, with keys, of their best match in the second."""
    near = lambda x, o: F.greatest(edit_similarity(x["k"], o["k"]), edit_similarity(x["t"], o["t"]))
    best = lambda x: F.when(F.exists(many, lambda o: o["t"] == x["t"]), F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(many, lambda o: near(x, o))), F.lit(0.0)))
    total = F.aggregate(F.transform(few, best), F.lit(0.0), lambda s, x: s + F.when(x >= 0.85, F.lit(1.0)).otherwise(x))
    return F.when(F.size(few) == 0, F.lit(0.0)).otherwise(total / F.size(few))


def fuzzy_tokens(a: Column, b: Column) -> Column:
    """Soft overlap of two token lists, seen from the one with fewer tokens, the first of equals.

    A token counts 1 if the other list holds it or the best of key and spelling
    similarity reaches 0.85, else that best.  Equal keys are wholly similar.
    """
    swap = lambda x, y: F.size(x) > F.size(y)
    return once(lambda x, y: once(_fuzzy, F.when(swap(x, y), y).otherwise(x), F.when(swap(x, y), x).otherwise(y)), _with_keys(a), _with_keys(b))


def token_metrics(a: Column, b: Column) -> Column:
    """Jaccard, overlap and fuzzy overlap of two token lists; all 1 if both are empty."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    one = lambda c: F.when(none, F.lit(1.0)).otherwise(c)
    return F.struct(one(jaccard(a, b)).alias("jaccard"), one(overlap(a, b)).alias("overlap"), one(fuzzy_tokens(a, b)).alias("fuzzy"))


def _phonetic_matches(keys: Column, others: Column) -> Column:
    best = lambda k: F.when(k == "", F.lit(0.0)).otherwise(F.coalesce(F.array_max(F.transform(F.filter(others, lambda o: o != ""), lambda o: edit_similarity(k, o))), F.lit(0.0)))
    found = F.transform(keys, lambda k: F.struct(best(k).alias("s"), (F.array_contains(others, k) & (k != "")).alias("e")))
    n = F.size(keys)
    none = (n == 0) | (F.size(others) == 0)
    zero = F.lit(0.0)

    def shares(f: Column) -> Column:
        return F.struct(
            F.when(none, zero).otherwise(F.aggregate(f, zero, lambda s, x: s + x["s"]) / n).alias("mean"),
            F.when(none, zero).otherwise(F.coalesce(F.array_max(F.transform(f, lambda x: x["s"])), zero)).alias("max"),
            F.when(none, zero).otherwise(F.size(F.filter(f, lambda x: x["e"])) / n).alias("equal_share"),
        )

    return once(shares, found)


def phonetic_matches(a: Column, b: Column) -> Column:
    """For each token of the first list its best key similarity in the second: mean, maximum and share of equal keys."""
    return once(_phonetic_matches, F.transform(a, phonetic_key), F.transform(b, phonetic_key))


def matches_words(token: Column, words: Column) -> Column:
    """Whether a token stands among words, or shares its first four letters with one and contains it or is contained."""
    near = lambda w: (F.length(token) >= 4) & (F.startswith(w, F.substring(token, 1, 4)) | F.startswith(token, F.substring(w, 1, 4))) & (F.contains(w, token) | F.contains(token, w))
    return F.array_contains(words, token) | F.exists(words, near)


def hamming_similarity(x: Column, y: Column) -> Column:
    """Share of equal bits of two 64-bit numbers."""
    return F.lit(1.0) - F.bit_count(x.bitwiseXOR(y)) / 64


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two dense vectors; 0 if either has no length."""
    return F.when((norm(u) == 0) | (norm(v) == 0), F.lit(0.0)).otherwise(dot(u, v) / (norm(u) * norm(v)))


def shifted_cosine(u: Column, v: Column) -> Column:
    """Cosine with 1e-9 added to each norm."""
    return dot(u, v) / ((norm(u) + F.lit(1e-9)) * (norm(v) + F.lit(1e-9)))
