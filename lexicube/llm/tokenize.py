"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import builtins
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Place of the vocabulary, a parameter everywhere. The pattern is the one that
#: belongs to this public vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, loaded once a Python worker."""
    cache = builtins.__dict__.setdefault("_lexicube_encoders", {})
    if path not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text (Arrow batches); null and empty texts have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return count(text)
