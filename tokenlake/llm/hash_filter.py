"""A set of hashes as a bitmap of bounded size, to broadcast in place of a table that grows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import U64


class Filter:
    """A bitmap of hashes: lets all that were put in through, and few others."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, keys: DataFrame, most: int) -> Filter:
        """Of keys(key), with about 32 bits for each and at most 2**most; its size is that of the bitmap whatever the keys' number."""
        bits = min(most, max(15, (32 * keys.count()).bit_length()))
        place = F.shiftrightunsigned("key", 64 - bits) + 1
        made = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("x"))
        bitmap = np.zeros((1 << bits) >> 3, np.uint8)
        for row in made.toLocalIterator():
            bitmap[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["x"], np.uint8)
        return cls(bits, bitmap)
