"""Code point tables of the plain form, built from the Unicode data that Python carries.

Only the look-alike pairs are written out; everything else follows from rules.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that look just like a Latin letter, and that letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "հ": "h", "ո": "n", "ս": "u",
}

#: Invisible characters outside the format category.
INVISIBLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"}
INVISIBLE |= {chr(x) for x in (*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}
#: Control characters that only part lines or words stay.
LAYOUT = {"\t", "\n", "\r", "\x0b", "\x0c", "\x85"}


def _decomposed(ch: str) -> str:
    """``ch`` in separate code points of ordinary width; compatibility forms other than width and joined letters stay."""
    if ch in INVISIBLE:
        return ""
    category = unicodedata.category(ch)
    if category == "Cf" or (category == "Cc" and ch not in LAYOUT):
        return ""
    if category == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    if not parts[0].startswith("<"):
        return "".join(_decomposed(chr(int(p, 16))) for p in parts)
    target = [chr(int(p, 16)) for p in parts[1:]]
    joined = parts[0] == "<compat>" and len(target) > 1 and category[0] == "L" and all(unicodedata.category(t) in ("Lu", "Ll") for t in target)
    if parts[0] in ("<wide>", "<narrow>") or joined:
        return "".join(map(_decomposed, target))
    return ch


def composed(text: str, lookalikes: dict[str, str] | None = None) -> str:
    """The plain form of ``text``, one string at a time: the definition that the distributed operator has to meet."""
    known = LOOKALIKES if lookalikes is None else lookalikes
    apart = "".join(known.get(c, c) for ch in text for c in _decomposed(ch))
    return unicodedata.normalize("NFC", apart)


@lru_cache(maxsize=4)
def code_points(lookalikes: tuple[tuple[str, str], ...] = tuple(LOOKALIKES.items())) -> tuple[tuple[str, str, tuple[tuple[str, int], ...]], ...]:
    """Rows ``(code point, composed image, ((part, combining class), ...))`` of every code point that isn't simply itself."""
    known, rows = dict(lookalikes), []
    for number in (*range(0x323B0), *range(0xE0000, 0xE0200)):
        ch = chr(number)
        if 0xAC00 <= number < 0xE000 or unicodedata.category(ch) in ("Cn", "Co"):
            continue  # Hangul syllables, surrogates, nothing
        apart = "".join(known.get(c, c) for c in _decomposed(ch))
        parts = tuple((c, unicodedata.combining(c)) for c in apart)
        if parts != ((ch, 0),):
            rows.append((ch, unicodedata.normalize("NFC", apart), parts))
    return tuple(rows)


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Two code points, first and second, to the one that canonical composition makes of them."""
    pairs = {}
    for number in range(0x20000):
        ch = chr(number)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            two = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", two) == ch:
                pairs[two] = ch
    return pairs


@lru_cache(maxsize=4)
def joining(lookalikes: tuple[tuple[str, str], ...] = tuple(LOOKALIKES.items())) -> str:
    """Code points that may change or merge with what stands before them: text with one needs reordering and composing."""
    seconds = {pair[1] for pair in compositions()}
    found = {ch for ch, _, parts in code_points(lookalikes) if parts and (parts[0][1] or parts[0][0] in seconds)}
    return "".join(sorted(found | seconds))


@lru_cache(maxsize=1)
def merging_starters() -> tuple[str, ...]:
    """Code points of class 0 that compose with the starter before them."""
    return tuple(sorted({pair[1] for pair in compositions() if not unicodedata.combining(pair[1])}))
