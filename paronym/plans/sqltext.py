"""Pieces of DuckDB SQL that mirror the column functions; used to check queries, never to run them."""

from __future__ import annotations

from ..functions.text import DIGITS, NAMED_NUMBERS, SOUNDS, STRUCTURAL_WORDS, TEENS


def words(items: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def base(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text(x)})), '[^a-z0-9]+', ' ', 'g'))"


def chars(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i_: substr({x}, i_, 1))"


def collapsed(x: str) -> str:
    """Runs of one character, except line breaks, become one."""
    return f"array_to_string(list_filter({chars(x)}, lambda c_, n_: n_ = 1 OR c_ = chr(10) OR c_ <> substr({x}, n_ - 1, 1)), '')"


def strict(x: str) -> str:
    """Strict form of a column reference."""
    return f"replace({base(collapsed(x))}, ' ', '')"


def tokens(x: str) -> str:
    """Words of an already normalised text."""
    return f"list_filter(string_split({x}, ' '), lambda t_: t_ <> '')"


def literal(x: str) -> str:
    out = text(x)
    for digit, word in enumerate(DIGITS):
        out = f"replace({out}, '{digit}', ' {word} ')"
    return out


def _number(x: str) -> str:
    big = f"try_cast({x} AS bigint)"
    named = " ".join(f"WHEN {big} = {n} THEN ' {w} '" for n, w in NAMED_NUMBERS.items())
    return (
        f"CASE {named} WHEN {big} < 10 THEN ' ' || list_extract([{words(DIGITS)}], CAST({big} + 1 AS int)) || ' ' "
        f"WHEN {big} BETWEEN 10 AND 19 THEN ' ' || list_extract([{words(TEENS)}], CAST({big} - 9 AS int)) || ' ' "
        f"WHEN {big} % 100 = 0 AND {big} <= 900 THEN ' ' || list_extract([{words(DIGITS)}], CAST({big} // 100 + 1 AS int)) || 'centos ' "
        f"ELSE {literal(x)} END"
    )


def cardinal(x: str) -> str:
    parts = f"regexp_extract_all({text(x)}, '[0-9]+|[^0-9]+')"
    return f"array_to_string(list_transform({parts}, lambda p_: CASE WHEN regexp_matches(p_, '^[0-9]') THEN {_number('p_')} ELSE p_ END), '')"


def key(x: str) -> str:
    """Phonetic key of a normalised word; runs must be collapsed by the caller's ``x``."""
    out = f"regexp_replace({collapsed(x)}, '[^a-z]', '', 'g')"
    for pattern, sound in SOUNDS:
        out = f"regexp_replace({out}, '{pattern}', '{sound}', 'g')"
    return f"list_extract(list_transform([{out}], lambda k_: upper(substr(k_, 1, 1) || regexp_replace(substr(k_, 2), '[aeiou]', '', 'g'))), 1)"


def guarded(a: str, b: str, value: str) -> str:
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE {value} END"


def edit(a: str, b: str) -> str:
    return guarded(a, b, f"1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))")


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::double / {union} END"


def overlap(a: str, b: str) -> str:
    least = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {least} = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::double / {least} END"


def ngrams(x: str, n: int) -> str:
    grams = f"list_distinct(list_transform(range(1, greatest(length({x}) - {n} + 2, 1)), lambda i_: substr({x}, i_, {n})))"
    return f"CASE WHEN length({x}) = 0 THEN []::varchar[] WHEN length({x}) < {n} THEN [{x}] ELSE {grams} END"


def without_structural(toks: str) -> str:
    return f"list_filter({toks}, lambda t_: t_ NOT IN ({words(STRUCTURAL_WORDS)}))"


#: Usable pairs with the cleaned columns that most queries start from.
PAIRS = """
pares AS (
    SELECT pair_id, trim(marca_monitorada, chr(32) || chr(9) || chr(10) || chr(13)) AS a, trim(marca_colidente, chr(32) || chr(9) || chr(10) || chr(13)) AS b,
           coalesce(classe_marca_monitorada, -1) AS ca, coalesce(classe_marca_colidente, -1) AS cb,
           coalesce(especificacao_monitorado, '') AS sa, coalesce(especificacao_colidente, '') AS sb,
           greatest(0, least(1, coalesce(label, 0))) AS y
    FROM marca_pares
    WHERE regexp_matches(marca_monitorada, '[^\\s\\p{Z}]') AND regexp_matches(marca_colidente, '[^\\s\\p{Z}]')
)"""
