"""Token counts of whole texts by a public byte-level BPE vocabulary, read from a path."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns of df and the number of tokens of `text`; a null text has none.  A column
    that bears the name of the number gives way."""
    others = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int64())], names=[*others, name])

    return df.select(*others, F.col(text)).mapInArrow(count, schema)
