"""Several values packed in one field, one row each with its position.

Delimiters are inferred for each source by scoring candidates over all of its
rows; a field is then split at every delimiter of its source.  Fields without
brackets and quotes, the bulk, are split by built-in expressions; the others go
through one Arrow batch function that scans brackets and quotes of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Blanks that don't belong to a value; written out, as Java and Python disagree on what ``\\s`` is.
BLANKS = " \t\n\r\x0b\x0c\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Candidates by name, as patterns that Java and Python read alike; the sign comes first, so that few places are looked at twice.
CANDIDATES = {
    "semicolon": ";",
    "bar": "\\|",
    "tab": "\\t",
    "line break": "\\r\\n|[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]",
    "bullet": "[\\u2022\\u2023\\u2043\\u2219\\u25aa\\u25ab\\u25cf\\u25e6]",
    "spaced slash": f"/(?<=[{BLANKS}]/)(?=[{BLANKS}])",
    "spaced dash": f"[-\\u2013\\u2014](?<=[{BLANKS}][-\\u2013\\u2014])(?=[{BLANKS}])",
    "comma": ",",
}
#: Candidates that never part, whatever they score.
NEVER = ("comma",)
QUOTES = {'"': '"', "“": "”"}
BRACKETS = {"(": ")", "[": "]"}
#: A piece of a list isn't longer.
LONGEST = 200


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


_BRACKETED = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")
_QUOTED = re.compile('(^|[;|\\t\\n\u2022]) *("(?:[^"]|"")*"|\u201c[^\u201d]*\u201d)')


def _is_item(piece: str) -> bool:
    """Whether a piece opens as an item of a list does: with a letter, a quote, a bracket or a dash before one of these."""
    first = piece[2:3] if piece[:2] in ("- ", "– ", "— ") else piece[:1]
    return len(piece) <= LONGEST and (first.isalpha() or first in ('"', "“", "(", "[", "*"))


def _tallies(known: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the fields of a batch by source and candidate: fields with it, fields whose inner pieces are all there, pieces, pieces of the type of items."""
    names = list(known)
    any_of = re.compile("|".join(f"({p})" for p in known.values()) or "(?!)")
    single = [re.compile(p) for p in known.values()]
    # Patterns without groups of their own are looked for in one pass; of two that match, the first wins, as in a split.
    apart = all(p.groups == 0 for p in single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for source, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = v.strip(BLANKS)
                if "(" in v or "[" in v:
                    v = _BRACKETED.sub("", v)
                if '"' in v or "“" in v:
                    v = _QUOTED.sub(r"\1quoted", v)
                cuts: dict[int, list[tuple[int, int]]] = {}
                if apart:
                    for m in any_of.finditer(v):
                        cuts.setdefault(m.lastindex - 1, []).append(m.span())
                else:
                    for i, pattern in enumerate(single):
                        spans = [m.span() for m in pattern.finditer(v)]
                        if spans:
                            cuts[i] = spans
                for i, spans in cuts.items():
                    pieces, at = [], 0
                    for a, b in spans:
                        pieces.append(v[at:a].strip(BLANKS))
                        at = b
                    pieces.append(v[at:].strip(BLANKS))
                    kept = [p for p in pieces if p]
                    held = sums.setdefault((source, i), [0, 0, 0, 0])
                    held[0] += 1
                    held[1] += all(pieces[1:-1])
                    held[2] += len(kept)
                    held[3] += sum(map(_is_item, kept))
        yield pa.RecordBatch.from_pydict({
            "source": pa.array([s for s, _ in sums], pa.string()), "delimiter": pa.array([names[i] for _, i in sums], pa.string()),
            **{c: pa.array([x[j] for x in sums.values()], pa.int64()) for j, c in enumerate("nwpr")},
        })

    return run


def score_delimiters(df: DataFrame, source: str | None, fields: list[str], candidates: dict[str, str] | None = None, never: tuple[str, ...] = NEVER, least_score: float = 0.5, lean: float = 50.0) -> DataFrame:
    """``(source, delimiter, fields, consistency, regularity, score, active)`` of each candidate in each source.

    ``consistency`` is the share of a source's fields with the delimiter whose
    inner pieces are all there, so that the piece count is what the delimiters
    say; ``regularity`` the share of pieces of the type that pieces of a list
    have: an opening letter or quote, no more than 200 characters.  Both are
    drawn towards the candidate's share over all sources, as if the source had
    ``lean`` fields more, and that towards 1 in the same way, so a source with
    little evidence follows the others.  The score is their product; a
    candidate is active if it reaches ``least_score``, at any size of the data,
    unless listed in ``never``, whose candidates are scored but never active.
    A candidate that a source lacks has no fields there and the others' score.
    """
    known = CANDIDATES if candidates is None else candidates
    who = F.lit("") if source is None else F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    rows = df.select(who.alias("source"), F.explode(F.array(*[F.col(f"`{f}`").cast("string") for f in fields])).alias("v")).where("v is not null")
    parts = rows.mapInArrow(_tallies(known), "source string, delimiter string, n bigint, w bigint, p bigint, r bigint")
    sums = [F.sum(x).alias(x) for x in "nwpr"]
    each = cut_lineage(parts.groupBy("source", "delimiter").agg(*sums))  # a row a source and candidate
    sources = df.select(who.alias("source")).distinct()
    names = df.sparkSession.createDataFrame([(x,) for x in known], "delimiter string")
    grid = sources.crossJoin(F.broadcast(names)).join(each, ["source", "delimiter"], "left").fillna(0, [*"nwpr"])  # a source has as many rows as there are candidates
    pooled = each.groupBy("delimiter").agg(*[F.sum(x).alias(f"all_{x}") for x in "nwpr"])
    wide = grid.join(F.broadcast(pooled), "delimiter", "left").fillna(0, [f"all_{x}" for x in "nwpr"])

    def share(part: str, whole: str) -> Column:
        of_all = (F.col(f"all_{part}") + lean) / (F.col(f"all_{whole}") + lean)
        return (F.col(part) + lean * of_all) / (F.col(whole) + lean)

    scored = wide.select("source", "delimiter", F.col("n").alias("fields"), share("w", "n").alias("consistency"), share("r", "p").alias("regularity")).withColumn("score", F.col("consistency") * F.col("regularity"))
    return scored.withColumn("active", ~F.col("delimiter").isin(*never) & (F.col("score") >= least_score))


def split_packed(text: str, pattern: str) -> list[str]:
    """The values of one field: nothing parts inside brackets or inside a value that opens with a quote.

    A bracket or opening quote that is never closed is an ordinary character.
    """
    parting = re.compile(f"(?P<part>{pattern})|[(\\[]") if pattern else re.compile("[(\\[]")
    values, start, at, n = [], 0, 0, len(text)
    closed: dict[int, int] | None = None
    while True:
        first = start
        while first < n and text[first] in BLANKS and not re.match(pattern or "(?!)", text[first]):
            first += 1
        quote_end = -1
        if at <= first < n and text[first] in QUOTES:
            quote_end = _closing_quote(text, first)
            if quote_end >= 0:
                at = quote_end + 1
        while True:
            m = parting.search(text, at)
            if m is None or m.lastgroup == "part":
                break
            if closed is None:
                closed = _closings(text)
            at = closed.get(m.start(), m.start()) + 1
        end = m.start() if m else n
        values.append(_value(text[start:end], text[first], quote_end, first, text) if quote_end >= 0 and quote_end < end else text[start:end].strip(BLANKS))
        if m is None:
            return [v for v in values if v]
        start = at = max(m.end(), m.start() + 1)


def _closing_quote(text: str, at: int) -> int:
    close = QUOTES[text[at]]
    if text[at] != close:
        return text.find(close, at + 1)
    i = text.find(close, at + 1)
    while i >= 0 and text[i + 1 : i + 2] == close:
        i = text.find(close, i + 2)
    return i


def _value(piece: str, quote: str, quote_end: int, first: int, text: str) -> str:
    whole = piece.strip(BLANKS)
    inner = text[first + 1 : quote_end]
    if len(whole) != quote_end - first + 1:
        return whole  # text goes on behind the quoted part
    return (inner.replace('""', '"') if quote == '"' else inner).strip(BLANKS)


def _closings(text: str) -> dict[int, int]:
    """Opening brackets that are closed, with the place of their closing one."""
    stack, found = [], {}
    for m in re.finditer(r"[()\[\]]", text):
        ch = m.group()
        if ch in BRACKETS:
            stack.append((ch, m.start()))
        else:
            # A bracket of the other kind left open in between is an ordinary character.
            for i in range(len(stack) - 1, -1, -1):
                if BRACKETS[stack[i][0]] == ch:
                    found[stack[i][1]] = m.start()
                    del stack[i:]
                    break
    return found


def _scanner(patterns: list[str]) -> Callable[[Column, Column], Column]:
    """``split_packed`` of a column by the pattern whose number another column gives; -1 is none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scanned(values: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else split_packed(v, patterns[n] if n >= 0 else "") for v, n in zip(values, numbers)], dtype=object)

    return scanned


#: Stands for a delimiter between two steps; a field that holds it is scanned instead.
_PARTED = "\x01"


def explode_packed(df: DataFrame, key: str, fields: list[str], source: str | None = None, candidates: dict[str, str] | None = None, never: tuple[str, ...] = NEVER) -> DataFrame:
    """``(key, field, position, value, count)``: each value of each field, positions from 1; ``count`` is the field's number of values.

    Values are trimmed, without their outer quotes, doubled straight quotes in
    quoted values single.  Null, empty and blank fields give no row, empty
    values neither; equal values, rows and keys stay repeated.  Texts may be of
    any length.  Columns of ``df`` that aren't named play no part.
    """
    known = CANDIDATES if candidates is None else candidates
    active = score_delimiters(df, source, fields, known, never).where("active")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    patterns = active.groupBy("source").agg(F.array_sort(F.collect_set("delimiter")).alias("d")).select(F.col("source").alias("who"), F.array_join(F.transform("d", lambda d: table[d]), "|").alias("pattern"))
    who = F.lit("") if source is None else F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), who.alias("who"), *[F.col(f"`{f}`").cast("string").alias(f"v{i}") for i, f in enumerate(fields)])
    # One row a source, written, so that the optimizer knows its size and broadcasts it while that is small.
    patterns = cut_lineage(patterns)
    distinct = sorted(r.pattern for r in patterns.select("pattern").distinct().collect())  # one for a set of candidates
    number = F.create_map(*[F.lit(x) for i, p in enumerate(distinct) for x in (p, i)])[F.col("pattern")] if distinct else F.lit(None)
    rows = rows.join(patterns, "who", "left").select("*", F.coalesce(number.cast("int"), F.lit(-1)).alias("number")).withColumn("pattern", F.coalesce("pattern", F.lit("(?!)")))
    long = rows.select("key", "pattern", "number", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("v")) for i, f in enumerate(fields)])).alias("x")).select("key", "pattern", "number", "x.*").where("v is not null")
    nested = F.col("v").rlike('[(\\[\\u201c"\\x01]')
    scanned = _scanner(distinct)(F.when(nested, F.col("v")), F.col("number"))
    # A split by a pattern compiles it for every row; a replacement keeps the compiled one.
    plain = F.filter(F.transform(F.split(F.regexp_replace("v", F.col("pattern"), F.lit(_PARTED)), _PARTED), _trimmed), lambda p: p != "")
    values = long.withColumn("scanned", scanned).select("key", "field", F.when(nested, F.col("scanned")).otherwise(plain).alias("values"))
    return values.select("key", "field", F.size("values").alias("count"), F.posexplode("values").alias("position", "value")).select("key", "field", (F.col("position") + 1).alias("position"), "value", "count")

