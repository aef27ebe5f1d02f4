"""Words, runs and characters of many texts at once, as arrays over their code points.

A word is what stands between blanks, in lower case and without the punctuation
around it.  A run is what stands between marks that part items: line breaks,
tabs, semicolons, bars, bullets, three blanks in a row, a slash between blanks.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

#: Ordinary punctuation around a word; other signs stay, so that broken text doesn't look like words.
OUTER = ".,;:!?\"'()[]¿¡«»…“”*-–—|•·/"
#: Signs that may stand inside a word or a number.
INNER = "'’-.,/%"
BREAKS = "\n\r\x0b\x0c\x85  "
PARTING = ";|•·\t" + BREAKS
ENDS, STOPS, CLOSERS = ".!?:…", ".!?…", "\"'”’)]"

_SOLID, _CORE, _PART, _BREAK, _END, _CLOSER, _SIGN, _STOP, _KNOWN = (1 << i for i in range(9))
_BASE = 0x9E3779B97F4A7C15
_flags = np.zeros(0x110000, np.uint16)
_counts = np.zeros(0x110000, np.int64)  # letters, digits and inner signs, 20 bits each
_hashes = np.zeros(0x110000, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _learn(code: int) -> None:
    ch, flags, count = chr(code), _KNOWN, 0
    category = unicodedata.category(ch)
    if not (ch.isspace() or category[0] == "Z"):
        flags |= _SOLID
        if ch not in OUTER:
            flags |= _CORE
        if category[0] in "LM":
            count = 1
        elif category[0] == "N":
            count = 1 << 20
        else:
            flags |= _SIGN
    if ch in INNER:
        count = 1 << 40
    for chars, flag in ((PARTING, _PART), (BREAKS, _BREAK), (ENDS, _END), (CLOSERS, _CLOSER), (STOPS, _STOP)):
        flags |= flag if ch in chars else 0
    _flags[code], _counts[code], _hashes[code] = flags, count, mixed(np.array([code + 1], np.uint64))[0]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64th."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


@dataclass
class Scan:
    """One entry a word: the number of its text, its hash, its place in ``joined``, whether it is letters or digits alone, the words of its run, and whether that closes like a sentence.

    ``lines`` (that hold anything), ``ended`` (with closing punctuation),
    ``solid`` and ``signs`` (characters) are counts by text.
    """

    joined: str
    text: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    run: np.ndarray
    sentence: np.ndarray
    lines: np.ndarray
    ended: np.ndarray
    solid: np.ndarray
    signs: np.ndarray


def scan(texts: list[str]) -> Scan:
    """Scan one text or more; none may be null."""
    lower = [t.lower() for t in texts]
    joined = "\n".join(lower) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = _flags[codes]
    if not flags.all():
        for code in set(codes[flags == 0].tolist()):
            _learn(code)
        flags = _flags[codes]
    ends = np.cumsum([len(t) + 1 for t in lower])
    begins = np.concatenate([[0], ends[:-1]])
    total = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64)

    solid = (flags & _SOLID) != 0
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    core = np.flatnonzero(flags & _CORE)
    of = np.cumsum(opens, dtype=np.int32)[core]  # the number of the core character's token
    turn = np.flatnonzero(of[1:] != of[:-1]) + 1 if len(of) else of
    start = core[np.concatenate([[0], turn])] if len(of) else core
    end = core[np.concatenate([turn - 1, [len(core) - 1]])] + 1 if len(of) else core

    # Prefix sums weighted with powers give every word's hash by one difference.
    power, inverse = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_hashes[codes] * power[: len(codes)], out=sums[1:])
    word = mixed((sums[end] - sums[start]) * inverse[start])

    kinds = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(_counts[codes], out=kinds[1:])
    held = kinds[end] - kinds[start]
    letters, digits, inner = held & 0xFFFFF, (held >> 20) & 0xFFFFF, held >> 40
    size = end - start
    whole = ((letters + inner == size) & (letters > inner)) | ((digits + inner == size) & (digits > inner))

    parting = (flags & _PART) != 0
    parting[2:] |= ~(solid[2:] | solid[1:-1] | solid[:-2])
    slash = np.flatnonzero(codes[1:-1] == ord("/")) + 1
    parting[slash[~solid[slash - 1] & ~solid[slash + 1]]] = True
    run_of = np.cumsum(parting, dtype=np.int32)[start]
    run = np.bincount(run_of)[run_of] if len(start) else start
    # A run that closes like a sentence is running text from its second word on.
    closing = np.concatenate([np.flatnonzero(run_of[1:] != run_of[:-1]), [len(start) - 1]]) if len(start) else start
    stops = (flags[end[closing]] & _STOP) != 0
    sentence = np.repeat(stops, np.diff(closing, prepend=-1)) & (run > 1)

    broken = np.flatnonzero(flags & _BREAK)
    line_begins = np.concatenate([[0], broken[:-1] + 1])
    filled = np.add.reduceat(solid, line_begins, dtype=np.int64) > 0
    last = np.flatnonzero((flags & (_SOLID | _CLOSER)) == _SOLID)
    place = np.searchsorted(last, broken) - 1
    at = last[np.maximum(place, 0)] if len(last) else np.zeros(len(broken), np.int64)
    ended = filled & (place >= 0) & (at >= line_begins) & ((flags[at] & _END) != 0)
    line_text = np.searchsorted(ends, line_begins, "right")
    n = len(texts)
    count = lambda mask: np.bincount(line_text[mask], minlength=n)
    return Scan(joined, np.searchsorted(ends, start, "right"), word, start, end, whole, run, sentence, count(filled), count(ended), total(solid), total((flags & _SIGN) != 0))
