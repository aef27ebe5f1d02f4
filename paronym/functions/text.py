"""Normalisation and tokens of names and descriptions, as column expressions.

Every function takes null as the empty string and never returns null.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits as words, and numbers with a word of their own.
DIGITS = ["zero", "um", "dois", "três", "quatro", "cinco", "seis", "sete", "oito", "nove"]
TEENS = ["dez", "onze", "doze", "treze", "quatorze", "quinze", "dezesseis", "dezessete", "dezoito", "dezenove"]
NAMED_NUMBERS = {100: "cem", 1000000: "um milhao", 2024: "dois mil e vinte quatro"}

# Function words that carry no identity in a name.
STRUCTURAL_WORDS = [
    "a", "o", "as", "os", "e", "da", "de", "do", "das", "dos", "no", "na", "nos", "nas", "em", "com", "por", "para", "ou", "que", "se", "ao", "aos",
    "the", "of", "for", "and", "to",
]

# Beginnings of stems that point to goods and to services.
PRODUCT_ANCHORS = [
    "produt", "merc", "fabric", "bebid", "alimen", "vest", "veicul", "moveis", "cosmet", "perfum", "calcad", "brinq", "eletronic", "veler", "cerveja",
    "vinho", "remed", "medic", "papel", "limpez", "saboner",
]
SERVICE_ANCHORS = [
    "servic", "consult", "assess", "ensin", "educ", "formac", "transport", "armazen", "host", "saas", "softw", "publi", "marketing", "design",
    "agenc", "constru", "instala", "manut", "reparo", "represent",
]

# Words of descriptions that say nothing, besides the stop words of the language.
NOISE_WORDS = [
    "comercio", "comercial", "atraves", "qualquer", "meio", "para", "uso", "fins", "servico", "servicos", "produto", "produtos", "outros", "outras",
    "tipo", "tipos", "destinado", "destinada", "destinados", "destinadas", "exceto", "inclui", "incluindo", "diversos", "varios", "variados",
    "preparacoes", "preparados", "fabricacao", "venda", "varejo", "atacado", "ramo",
]


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Precomposed letters whose canonical decomposition is an ASCII letter with marks, and those letters."""
    source, target = [], []
    for code in range(0xC0, 0x2200):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalnum() and all(0x300 <= ord(p) <= 0x36F for p in parts[1:]):
            source.append(ch)
            target.append(parts[0])
    return "".join(source), "".join(target)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def unaccented(c: Column) -> Column:
    """ASCII letters without their marks; letters that don't decompose stay."""
    source, target = _accents()
    return F.regexp_replace(F.translate(c, source, target), "[\\u0300-\\u036f]+", "")


def collapse_repeats(c: Column) -> Column:
    """Any run of one character becomes one."""
    return F.regexp_replace(text_or_empty(c), "(.)\\1+", "$1")


def base_form(c: Column) -> Column:
    """Lower case, no accents, anything but ASCII letters and digits a single blank."""
    return F.trim(F.regexp_replace(unaccented(F.lower(text_or_empty(c))), "[^a-z0-9]+", " "))


def compact_form(c: Column) -> Column:
    """The base form without blanks."""
    return F.replace(base_form(c), F.lit(" "), F.lit(""))


def strict_form(c: Column) -> Column:
    """Repeats collapsed first, then the base form without blanks."""
    return compact_form(collapse_repeats(c))


def digits_as_words(c: Column) -> Column:
    """Every digit becomes its word with a blank on either side."""
    out = text_or_empty(c)
    for digit, word in enumerate(DIGITS):
        out = F.replace(out, F.lit(str(digit)), F.lit(f" {word} "))
    return out


def _word(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f" {w} ") for w in words]), F.greatest(at.cast("int"), F.lit(0)) + 1)


def number_words(digits: Column) -> Column:
    """A run of digits as a cardinal: named numbers, single digits, teens and round hundreds; else digit by digit."""
    value = F.when(F.length(digits) <= 18, digits.cast("bigint"))
    named = F.lit(None).cast("string")
    for number, word in NAMED_NUMBERS.items():
        named = F.when(value == number, F.lit(f" {word} ")).otherwise(named)
    hundreds = F.concat(F.rtrim(_word(DIGITS, F.least(value / 100, F.lit(9)))), F.lit("centos "))
    return (
        F.when(named.isNotNull(), named)
        .when(value < 10, _word(DIGITS, F.least(value, F.lit(9))))
        .when(value.between(10, 19), _word(TEENS, F.least(value - 10, F.lit(9))))
        .when((value % 100 == 0) & (value <= 900), hundreds)
        .otherwise(digits_as_words(digits))
    )


def numbers_as_words(c: Column) -> Column:
    """Every run of digits becomes its cardinal."""
    parts = F.regexp_extract_all(text_or_empty(c), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number_words(p)).otherwise(p)), "")


def literal_and_cardinal(c: Column) -> Column:
    """Base forms with numbers spelled digit by digit and as cardinals."""
    return F.struct(base_form(digits_as_words(c)).alias("literal"), base_form(numbers_as_words(c)).alias("cardinal"))


def has_digit(c: Column) -> Column:
    return text_or_empty(c).rlike("[0-9]")


# Spellings of one sound and that sound, in the order in which they are replaced.
SOUNDS = [("ph", "f"), ("y", "i"), ("ce|ci", "s"), ("ch", "x"), ("qu|k", "k"), ("xc", "s"), ("h", ""), ("w", "u")]


def phonetic_key(c: Column) -> Column:
    """First letter and consonants of a normalised word by sound, in capitals."""
    out = F.regexp_replace(collapse_repeats(c), "[^a-z]", "")
    for pattern, sound in SOUNDS:
        out = F.regexp_replace(out, pattern, sound)
    return F.upper(F.regexp_replace(out, "(?<!^)[aeiou]", ""))


def tokens(c: Column) -> Column:
    """Words of the base form."""
    return F.filter(F.split(base_form(c), " "), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    """Words of two characters or more that aren't numbers."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))


def without_structural(toks: Column) -> Column:
    """Tokens without function words; repeated ones stay."""
    return F.filter(toks, lambda t: ~t.isin(*STRUCTURAL_WORDS))


def char_ngrams(c: Column, n: int) -> Column:
    """The set of n-grams; a shorter text is its own only gram, an empty one has none."""
    text = text_or_empty(c)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(grams)


def padded_trigrams(c: Column) -> Column:
    """All trigrams, repeated ones too, of the text with two blanks on either side; an empty text has none."""
    text = F.concat(F.lit("  "), text_or_empty(c), F.lit("  "))
    return F.when(F.length(text) == 4, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def simhash64(c: Column) -> Column:
    """Sign of each bit's votes over the trigrams' 64-bit hashes; 0 for an empty text."""
    hashes = F.transform(padded_trigrams(c), lambda g: F.xxhash64(g))
    bit = lambda h, i: F.call_function("getbit", h, i) == 1
    votes = F.aggregate(hashes, F.array_repeat(F.lit(0), 64), lambda s, h: F.transform(s, lambda v, i: v + F.when(bit(h, i), 1).otherwise(-1)))
    one = F.lit(1).cast("bigint")
    bits = F.transform(votes, lambda v, i: F.when(v >= 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(hashes) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b)))


def spec_items(c: Column) -> Column:
    """Items of a description, parted by semicolons and line breaks."""
    return F.filter(F.transform(F.split(text_or_empty(c), "[;\\n]+"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


# Letters without decomposition and their usual transliteration.
TRANSLITERATED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th"}


def spec_tokens(c: Column, stop_words: list[str]) -> Column:
    """Words of a description: transliterated, lower case, without numbers, short words and stop words."""
    out = unaccented(text_or_empty(c))
    for letter, plain in TRANSLITERATED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    words = F.split(F.regexp_replace(F.lower(out), "[;,\\[\\]()/:.\\-]", " "), "\\s+")
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop_words))


def activity_kind(toks: Column) -> Column:
    """``produto``, ``servico`` or ``misto`` by anchors at the beginning of words."""
    count = lambda anchors: F.size(F.filter(toks, lambda t: t.rlike("^(" + "|".join(anchors) + ")")))
    p, s = count(PRODUCT_ANCHORS), count(SERVICE_ANCHORS)
    return F.when((p == 0) & (s == 0), "misto").when(p >= 2 * F.greatest(s, F.lit(1)), "produto").when(s >= 2 * F.greatest(p, F.lit(1)), "servico").otherwise("misto")


def spec_stems(toks: Column) -> Column:
    """Distinct stems of three characters or more."""
    return F.array_distinct(F.filter(toks, lambda t: F.length(t) >= 3))


def longest(toks: Column) -> Column:
    """The longest token, the first of equals; empty for none."""
    return F.aggregate(toks, F.lit(""), lambda s, t: F.when(F.length(t) > F.length(s), t).otherwise(s))
