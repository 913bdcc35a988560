"""Scans over rows in key order, cut into chunks of equal size instead of by key.

Rows are range-partitioned by the key and a tie-breaking order and sorted, so
a key of very many rows spreads over as many partitions as it needs.  One pass
numbers the rows of each partition, works on chunks of exactly ``CHUNK_ROWS``
rows and leaves a boundary state where a key crosses a chunk; boundary states
are merged in order afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


def in_key_order(df: DataFrame, key: str, then: list, tie: str, ranges: int) -> DataFrame:
    """``df`` in so many ranges of (hash of key, key, then, tie), sorted in each but for the tie.

    The hash comes first as a fixed-width sort prefix; any order that keeps
    the rows of a key together serves.  ``tie`` makes rows distinct, so that
    equal rows can be divided between ranges.
    """
    lead = [F.xxhash64(key), F.col(key), *then]
    ranged = df.repartitionByRange(ranges, *lead, F.col(tie))
    return ranged.sortWithinPartitions(*lead)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """The batches of a partition as tables of exactly ``rows`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def starts(column: pa.ChunkedArray) -> np.ndarray:
    """True where a value differs from the one before it; nulls are equal to each other. The first row is True."""
    a = column.combine_chunks()
    n = len(a)
    out = np.ones(n, dtype=bool)
    if n > 1:
        x, y = a.slice(1), a.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(x, y), True)
        both = pc.and_(pc.is_null(x), pc.is_null(y))
        out[1:] = pc.and_not(differ, both).to_numpy(zero_copy_only=False)
    return out
