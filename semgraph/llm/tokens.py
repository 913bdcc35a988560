"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.session import materialize, new_folder

#: a rank file of byte-level BPE; every executor must have it at this path
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the pre-tokenizing pattern that belongs to the public byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """``keep``, ``item`` (a number unique to the row), ``digest`` (of ``keep`` and the text) and ``n_tokens`` of the whole text, written once.

    A null text has no tokens, as an empty one. Special tokens in a text are ordinary text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    rows = df.select(F.col(text).alias("_text"), *keep, F.monotonically_increasing_id().alias("item"), F.xxhash64(text, *keep).alias("digest"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_text").dtypes)
    return materialize(rows.mapInArrow(count, f"{kept}, n_tokens bigint"), new_folder(df.sparkSession, "tokens"))
