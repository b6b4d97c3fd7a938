"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a vocabulary file of ranks; a parameter, never part of this repository
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the published split pattern of that byte-level vocabulary (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", *, ranks: str = RANKS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row with a non-empty text.

    Rows whose text is NULL or empty are left out; repeated rows stay repeated.
    Texts are encoded whole, however long. Only ``keep`` and ``text`` are read,
    and a column of ``docs`` that is called ``n_tokens`` is not. The vocabulary at
    ``ranks`` needs to be on the driver only: it is shipped to the executors.
    """
    docs.sparkSession.sparkContext.addFile(ranks)
    name = os.path.basename(ranks)
    cols = [F.col(c) for c in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.pop("__text")]
            b["n_tokens"] = n
            yield b

    have = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*cols, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return have.mapInPandas(count, f"{schema}, n_tokens long")
