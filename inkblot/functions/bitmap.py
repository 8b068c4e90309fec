"""A bit map of hashed values that travels in the plan: most values that are not in a list are told apart by it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# About sixteen bits for a value; a list too long for the largest map sets more bits and prunes less.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 13, 1 << 23, 16


class BitMap:
    """Which hashes the values of a list have. Its size is bounded, and nothing that is in the list is told apart."""

    def __init__(self, values: DataFrame, column: str):
        n = values.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH).bit_length()))
        place = F.pmod(F.xxhash64(column), F.lit(self.bits))
        words = values.groupBy(F.shiftright(place, 5).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({column}), {self.bits}) & 31 as int)))").alias("set"))
        rows = words.toPandas()  # as many rows as the map has words, at most
        held = np.zeros(self.bits // 32, np.uint32)
        held[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).astype(np.uint32)
        self.data = held.astype("<u4").tobytes()

    def may_have(self, value: Column) -> Column:
        place = F.pmod(F.xxhash64(value), F.lit(self.bits))
        octet = F.conv(F.hex(F.substring(F.lit(bytearray(self.data)), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        # shifts take their distance as a column only in this form
        return F.call_function("shiftright", octet, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
