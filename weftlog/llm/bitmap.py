"""A bitmap of 64-bit hashes, small enough to broadcast whatever the input's size.

It has 64 bits for each hash, but 2**16 at least and 2**26 (8 MB) at most.  A fuller bitmap lets more through and never holds
back what was put in, so it may only be used to spare work that a join decides anyway.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 26


def bitmap_of(df: DataFrame, column: str, rows: int | None = None) -> np.ndarray:
    """The bitmap of a long column; at most 2**20 rows of 64 bits reach the driver. ``rows`` is their number where it is known."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * (df.count() if rows is None else rows)).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = df.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("value")).collect():
        table[r["word"]] = np.uint64(r["value"] & 0xFFFFFFFFFFFFFFFF)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (len(table) << 6).bit_length() - 1
    place = hashes >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
