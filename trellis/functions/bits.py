"""64-bit perceptual hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

HEX16 = "^[0-9a-f]{16}$"
SIDE, LOW = 32, 8


def hash_bits(c: Column) -> Column:
    """16 hexadecimal digits, any case and white space around, as a 64-bit integer; else null."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(x.rlike(HEX16), F.conv(x, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def is_similar(a: Column, b: Column, distance: int) -> Column:
    """True if both hex hashes are well formed and at most ``distance`` bits apart."""
    return F.coalesce(hamming(hash_bits(a), hash_bits(b)) <= distance, F.lit(False))


def threshold_bits(block: Column) -> Column:
    """The hash of an 8 x 8 block of coefficients in rows: a bit for each above the median of all but the first."""
    # the median is bound by a lambda, so that it isn't worked out again for each bit
    quad = lambda d, m: F.aggregate(F.slice(block, d * 4 + 1, F.lit(4)), F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > m, 1).otherwise(0))
    digits = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: F.lower(F.hex(quad(d, m)))), "")
    median = F.element_at(F.array_sort(F.slice(block, 2, 63)), 32)
    return F.when(F.size(block) >= 64, F.element_at(F.transform(F.array(median), digits), 1))


def dct_matrix(n: int) -> np.ndarray:
    """Rows of the unnormalised type-II cosine transform."""
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


@F.pandas_udf(ArrayType(DoubleType()))
def dct_low(pixels: pd.Series) -> pd.Series:
    """The 8 x 8 lowest coefficients of a 32 x 32 grey image given row by row; null for another size."""
    c = dct_matrix(SIDE)

    def one(p):
        if p is None or len(p) != SIDE * SIDE:
            return None
        x = np.asarray(p, dtype="f8").reshape(SIDE, SIDE)
        return (c @ x @ c.T)[:LOW, :LOW].ravel()

    return pixels.map(one)
