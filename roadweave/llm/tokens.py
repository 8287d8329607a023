"""Token counts with a public tokenizer, in Arrow batches on the executors."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file in tiktoken's rank format; must exist on every executor.
DEFAULT_TOKENIZER = os.environ.get("ROADWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text before the merges of the public rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("roadweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str = DEFAULT_TOKENIZER):
    """A vectorised function text -> number of tokens; null and empty text have none."""

    @F.pandas_udf("int")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return tokens


def token_count(text: str, path: str = DEFAULT_TOKENIZER) -> Column:
    """The token count of a text column."""
    return count_tokens(path)(F.col(text))
