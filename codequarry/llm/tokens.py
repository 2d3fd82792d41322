"""Sizes and ids of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import spread

#: Where the ranks of the byte-level BPE vocabulary lie on every machine; a parameter of all that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this vocabulary's merges.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The token ids of a whole text, none for NULL or ''."""
    if not text:
        return np.zeros(0, np.uint16)
    return np.asarray(encoding(vocabulary).encode_ordinary(text), np.uint16)


def with_tokens(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, tokens: bool = True) -> DataFrame:
    """The columns `keep` of `documents` with n_tokens and, if asked for, the ids of `text` as 16-bit numbers."""
    rows = spread(documents.select(*keep, F.col("text").alias("_text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ids(t, vocabulary) for t in b["_text"]]
            b = b.drop(columns="_text")
            b["n_tokens"] = [len(x) for x in found]
            if tokens:
                b["tokens"] = [x.tobytes() for x in found]
            yield b

    return rows.mapInPandas(count, f"{kept}, n_tokens bigint" + (", tokens binary" if tokens else ""))
