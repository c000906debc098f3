"""Readings of identifiers and fingerprints that problems share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, line breaks and no-break spaces included.
ENDS = r"(?U)^\s+|\s+$"


def bare(c: Column) -> Column:
    """Lower case, without surrounding white space; null for null."""
    return F.lower(F.regexp_replace(c, ENDS, ""))


def dashed_id(c: Column) -> Column:
    """An id in lower case with dashes 8-4-4-4-12; blank gives null.

    An id that isn't 32 hexadecimal digits keeps its own spelling, without dashes added.
    """
    raw = bare(c)
    plain = F.regexp_replace(raw, "-", "")
    cut = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), cut).when(raw != "", raw)


def sha256_hex(c: Column) -> Column:
    """64 hexadecimal digits in lower case, else null."""
    x = bare(c)
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def phash_bits(c: Column) -> Column:
    """16 hexadecimal digits as a 64-bit integer, else null."""
    x = bare(c)
    return F.when(x.rlike("^[0-9a-f]{16}$"), F.conv(x, 16, -10).cast("bigint"))
