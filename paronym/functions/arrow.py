"""Functions that built-in expressions can't give: Arrow batches, one call a batch.

Each is used on distinct pairs of strings, so a value is computed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity; 1 for two empty strings, 0 for one."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [y for y, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common beginning of up to four characters, above 0.7 only."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return score + 0.1 * start * (1 - score)


def damerau(a: str, b: str) -> int:
    """Edits and exchanges of neighbours that turn one string into the other, any part being edited again."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        here = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), here
            same = x == y
            if same:
                here = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[x] = i
    return d[-1][-1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = 0
    for y in b:
        held = row | masks.get(y, 0)
        row = held & ~(held - (row << 1 | 1))
    return row.bit_count()


#: Strings up to this length are compared many at once; longer ones, which are few, one by one.
_TOGETHER = 128


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows of one array, filled up, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = np.full((len(texts), max(int(sizes.max(initial=0)), 1)), fill, np.int64)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, sizes


def jaro_many(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Jaro and Jaro-Winkler similarity of strings side by side."""
    (a, la), (b, lb) = _codes(first, -1), _codes(second, -2)
    n, every, at = len(first), np.arange(len(first)), np.arange(b.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    taken, found = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        free = (b == a[:, i : i + 1]) & ~taken & (at >= i - reach) & (at <= i + reach)
        hit = free.any(axis=1)
        taken[every[hit], free.argmax(axis=1)[hit]] = True
        found[:, i] = hit
    m = found.sum(axis=1)
    moved = np.bincount(np.repeat(every, m), a[found] != b[taken], n) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    plain = np.where((la == 0) & (lb == 0), 1.0, plain)
    width = min(4, a.shape[1], b.shape[1])
    start = np.cumprod(a[:, :width] == b[:, :width], axis=1).sum(axis=1)
    return plain, np.where(plain > 0.7, plain + 0.1 * start * (1 - plain), plain)


def damerau_many(first: list[str], second: list[str]) -> np.ndarray:
    """Edits and exchanges of neighbours of strings side by side: each cell of all tables is one step."""
    (a, la), (b, lb) = _codes(first, -1), _codes(second, -2)
    n, every = len(first), np.arange(len(first))
    d = np.zeros((a.shape[1] + 2, b.shape[1] + 2, n), np.int32)
    d[0] = d[:, 0] = la + lb
    d[1:, 1] = np.arange(a.shape[1] + 1)[:, None]
    d[1, 1:] = np.arange(b.shape[1] + 1)[:, None]
    last = np.zeros((b.shape[1], n), np.int64)
    for i in range(1, a.shape[1] + 1):
        here, same = np.zeros(n, np.int64), (b == a[:, i - 1 : i]).T
        for j in range(1, b.shape[1] + 1):
            k, equal = last[j - 1], same[j - 1]
            turned = d[k, here, every] + (i - k) + (j - here) - 1
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~equal, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), turned)
            here = np.where(equal, j, here)
        last[same] = i
    return d[la + 1, lb + 1, every]


_EDITS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("jaro", "jaro_winkler", "damerau", "subsequence")])


@F.pandas_udf(_EDITS)
def string_similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Jaro, Jaro-Winkler and Damerau similarity, and the common subsequence as a share of the longer string."""
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    longest = np.array([max(len(p), len(q)) for p, q in zip(x, y)], np.int64)
    out = np.zeros((len(x), 4))
    order = np.argsort(longest, kind="stable")  # strings of like length side by side, so that little is filled up
    order, long = order[longest[order] <= _TOGETHER], np.flatnonzero(longest > _TOGETHER)
    begin = 0
    while begin < len(order):
        # As many as keep the tables in a few megabytes, counted with the longest of them.
        end = begin + 1
        while end < len(order) and (end - begin + 1) * (longest[order[end]] + 2) ** 2 <= 4_000_000:
            end += 1
        some = order[begin:end]
        u, v = [x[i] for i in some], [y[i] for i in some]
        out[some, 0], out[some, 1] = jaro_many(u, v)
        out[some, 2] = damerau_many(u, v)
        begin = end
    for i in long:
        out[i, :3] = jaro(x[i], y[i]), jaro_winkler(x[i], y[i]), damerau(x[i], y[i])
    out[:, 3] = [common_subsequence(p, q) for p, q in zip(x, y)]
    empty = np.array([not p or not q for p, q in zip(x, y)], bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 2] = np.where(longest == 0, 1.0, np.where(empty, 0.0, 1 - out[:, 2] / longest))
        out[:, 3] = np.where(longest == 0, 0.0, out[:, 3] / longest)
    return pd.DataFrame(out, columns=["jaro", "jaro_winkler", "damerau", "subsequence"])


def best_assignment(matrix: np.ndarray) -> float:
    """The largest sum of one entry a row and column, by shortest augmenting paths over potentials."""
    cost = -np.asarray(matrix, float)
    if cost.size == 0:
        return 0.0
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            free = ~used[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = at
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[1:][free] -= step
            at = nxt
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return float(sum(-cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


@F.pandas_udf(T.DoubleType())
def alignment(rows: pd.Series, columns: pd.Series, cells: pd.Series) -> pd.Series:
    """Best assignment as a share of the smaller side; ``cells`` holds the matrix row by row."""
    out = []
    for r, c, x in zip(rows, columns, cells):
        out.append(0.0 if not r or not c else best_assignment(np.asarray(x, float).reshape(int(r), int(c))) / min(r, c))
    return pd.Series(out, dtype=float)


# Suffix rules of the public Portuguese stemmer, as (suffix, least stem, replacement), step by step.
PLURAL = [("ns", 1, "m"), ("ões", 3, "ão"), ("ães", 1, "ão"), ("ais", 1, "al"), ("éis", 2, "el"), ("eis", 2, "el"), ("óis", 2, "ol"), ("is", 2, "il"), ("les", 3, "l"), ("res", 3, "r"), ("s", 2, "")]
FEMININE = [("ona", 3, "ão"), ("ora", 3, "or"), ("na", 4, "no"), ("inha", 3, "inho"), ("esa", 3, "ês"), ("osa", 3, "oso"), ("íaca", 3, "íaco"), ("ica", 3, "ico"), ("ada", 2, "ado"), ("ida", 3, "ido"), ("ima", 3, "imo"), ("iva", 3, "ivo"), ("eira", 3, "eiro")]
DEGREE = [("díssimo", 5, ""), ("abilíssimo", 5, ""), ("íssimo", 3, ""), ("ésimo", 3, ""), ("érrimo", 4, ""), ("zinho", 2, ""), ("quinho", 4, "c"), ("uinho", 4, ""), ("adinho", 3, ""), ("inho", 3, ""), ("alhão", 4, ""), ("zão", 2, ""), ("ão", 3, "")]
NOUN = [("encialista", 4, ""), ("alista", 5, ""), ("agem", 3, ""), ("iamento", 4, ""), ("amento", 3, ""), ("imento", 3, ""), ("alizado", 4, ""), ("atizado", 4, ""), ("izado", 5, ""), ("ativo", 4, ""), ("tivo", 4, ""), ("ivo", 4, ""), ("ado", 2, ""), ("ido", 3, ""), ("ador", 3, ""), ("edor", 3, ""), ("idor", 4, ""), ("atória", 5, ""), ("or", 2, ""), ("abilidade", 5, ""), ("icionista", 4, ""), ("cionista", 5, ""), ("ional", 4, ""), ("ência", 3, ""), ("ância", 4, ""), ("edouro", 3, ""), ("queiro", 3, "c"), ("eiro", 3, ""), ("oso", 3, ""), ("alizaç", 5, ""), ("ismo", 3, ""), ("izaç", 5, ""), ("aç", 3, ""), ("iç", 3, ""), ("ário", 3, ""), ("ério", 6, ""), ("ês", 4, ""), ("eza", 3, ""), ("ez", 4, ""), ("esco", 4, ""), ("ante", 2, ""), ("ástico", 4, ""), ("ático", 3, ""), ("ico", 4, ""), ("ividade", 5, ""), ("idade", 5, ""), ("oria", 4, ""), ("encial", 5, ""), ("ista", 4, ""), ("quice", 4, "c"), ("ice", 4, ""), ("íaco", 3, ""), ("ente", 4, ""), ("inal", 3, ""), ("ano", 4, ""), ("ável", 2, ""), ("ível", 5, ""), ("ura", 4, ""), ("ual", 3, ""), ("ial", 3, ""), ("al", 4, "")]
VERB = [("aríamo", 2, ""), ("ássemo", 2, ""), ("eríamo", 2, ""), ("êssemo", 2, ""), ("aremo", 2, ""), ("eremo", 3, ""), ("iremo", 3, ""), ("ávamo", 2, ""), ("ando", 2, ""), ("endo", 3, ""), ("indo", 3, ""), ("aram", 2, ""), ("eram", 3, ""), ("iram", 3, ""), ("avam", 2, ""), ("arem", 2, ""), ("erem", 3, ""), ("irem", 3, ""), ("asse", 2, ""), ("esse", 3, ""), ("isse", 3, ""), ("aria", 2, ""), ("eria", 3, ""), ("iria", 3, ""), ("ava", 2, ""), ("amo", 2, ""), ("emo", 2, ""), ("imo", 3, ""), ("am", 2, ""), ("em", 2, ""), ("ou", 3, ""), ("ar", 2, ""), ("er", 2, ""), ("ir", 3, ""), ("ei", 3, ""), ("iu", 3, ""), ("ia", 3, "")]


def _reduced(word: str, rules: list[tuple[str, int, str]]) -> tuple[str, bool]:
    for suffix, least, other in rules:
        if word.endswith(suffix) and len(word) >= len(suffix) + least:
            return word[: -len(suffix)] + other, True
    return word, False


def stem(word: str) -> str:
    """Stem of a Portuguese word by suffix rules: plural, feminine, degree, then noun, verb or last vowel."""
    word = word.lower()
    if word.endswith("s"):
        word, _ = _reduced(word, PLURAL)
    if word.endswith("a"):
        word, _ = _reduced(word, FEMININE)
    word, _ = _reduced(word, DEGREE)
    word, done = _reduced(word, NOUN)
    if not done:
        word, done = _reduced(word, VERB)
    if not done and len(word) > 3 and word[-1] in "aeo":
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def gram_vector(text: str, dims: int, low: int = 3, high: int = 5) -> np.ndarray:
    """Signed counts of the hashed character grams of a text padded by a blank on either side; zeros for a blank text."""
    out = np.zeros(dims, np.float32)
    if not text.strip():
        return out
    codes = np.frombuffer(f" {text.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.zeros(len(codes), np.uint64)
    for n in range(1, high + 1):
        if n > len(codes):
            break
        code = code[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        if n >= low:
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            np.add.at(out, (mixed % np.uint64(dims)).astype(np.int64), np.where((mixed >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.float32))
    return out


#: Characters whose grams are hashed at once.
_CHARACTERS = 200_000


def gram_vectors(texts: list[str], dims: int, low: int = 3, high: int = 5) -> np.ndarray:
    """``gram_vector`` of each text, a row for each; 64-bit floats."""
    out = np.zeros((len(texts), dims))
    padded = [f" {t} " if (t := text.strip()) else "" for text in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    group = np.cumsum(sizes) // _CHARACTERS
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for begin, end in zip(borders, borders[1:]):
        own = sizes[begin:end]
        if not own.sum():
            continue
        codes = np.frombuffer("".join(padded[begin:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(own)), own)
        left = np.repeat(np.cumsum(own), own) - np.arange(len(codes))  # characters to the end of the text
        code = np.zeros(len(codes), np.uint64)
        for n in range(1, min(high, len(codes)) + 1):
            code = code[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            if n >= low:
                at = np.flatnonzero(left[: len(code)] >= n)
                mixed = (code[at] ^ (code[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
                out[begin:end] += np.bincount(row[at] * dims + (mixed % np.uint64(dims)).astype(np.int64), sign, len(own) * dims).reshape(len(own), dims)
    return out


def hashed_cosines(a: Column, b: Column, dims: int = 256, unit: bool = False) -> Column:
    """Cosine of the hashed vectors of two texts and the greater of their lengths; the vectors never leave the Arrow batch."""

    @F.pandas_udf("cosine double, length double")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        x, y = x.fillna("").tolist(), y.fillna("").tolist()
        out = np.zeros((len(x), 2))
        for begin in range(0, len(x), 2000):
            u, v = (gram_vectors(t[begin : begin + 2000], dims) for t in (x, y))
            m, n = (np.sqrt((w * w).sum(axis=1)) for w in (u, v))
            out[begin : begin + 2000, 0] = np.divide((u * v).sum(axis=1), m * n, out=np.zeros(len(m)), where=m * n > 0)
            out[begin : begin + 2000, 1] = np.maximum(m, n)
        if unit:
            out[:, 1] = out[:, 1] > 0
        return pd.DataFrame(out, columns=["cosine", "length"])

    return compare(a, b)


def hashed_vector(text: Column, dims: int = 256, unit: bool = False) -> Column:
    """The encoder that needs no model: a text's vector of hashed character grams, of length 1 if ``unit``; null is the empty text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        made = [gram_vector(t or "", dims) for t in texts]
        if unit:
            made = [v / n if (n := float(np.linalg.norm(v))) else v for v in made]
        return pd.Series(made, dtype=object)

    return encode(text)


#: An encoder may compare two texts itself; others give vectors, which are compared.
hashed_vector.cosines = hashed_cosines
