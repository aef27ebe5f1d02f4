"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of vocabulary files; the environment may name another.
TOKENIZERS = os.environ.get("PARONYM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern of byte-level vocabularies of 50k ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_tokens(text: str, path: str, block: int = 100_000) -> int:
    """Tokens of a text.  A text longer than ``block`` is encoded in pieces that end before a blank, where tokens end anyway."""
    encoding, total, at = _encoding(path), 0, 0
    while len(text) - at > block:
        cut = text.rfind(" ", at + 1, at + block)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        cut = cut if cut > at else at + block
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(encoding.encode_ordinary(text[at:]))


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text column; null for null, 0 for an empty text.  ``path`` is that of a tiktoken vocabulary file."""
    file = path or f"{TOKENIZERS}/{VOCABULARY}"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else text_tokens(t, file) for t in texts], dtype="Int64")

    return count(text)
