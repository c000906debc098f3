"""Pairs of 64-bit fingerprints within a radius, by equi-joins on blocks of bits.

A fingerprint is cut into ``blocks`` blocks, and every choice of ``kept`` of them gives one
table, keyed by the bits of the chosen blocks.  Two fingerprints that differ in at most
``blocks - kept`` bits leave at least ``kept`` blocks untouched, so they share the key of at
least one table; the distance is verified on the pairs met.  No pair within the radius is missed.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def choose_blocks(stored: int, asked: int, radius: int) -> tuple[int, int]:
    """(blocks, kept) with the least rows to store, ask and verify; it sets costs, not results."""

    def cost(kept: int) -> float:
        blocks = radius + kept
        strangers = stored * asked / 2 ** (BITS * kept / blocks)
        return comb(blocks, kept) * (stored + asked + 0.05 * strangers)

    kept = min(range(1, 6), key=cost)
    return radius + kept, kept


def block_keys(fp: Column, blocks: int, kept: int) -> Column:
    """Array of each table's key: the table's number, then the chosen blocks' bits.

    Where these don't fit into 62 bits the key is their hash; what then meets by chance is
    ruled out when the distance is verified.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    if BITS * kept / blocks + comb(blocks, kept).bit_length() > 62:
        masks = [sum((1 << BITS - edges[b]) - (1 << BITS - edges[b + 1]) for b in chosen) for chosen in combinations(range(blocks), kept)]
        return F.array(*(F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m - (1 << BITS) if m >> 63 else m))) for t, m in enumerate(masks)))
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), kept)):
        key = F.lit(t).cast("bigint")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(fp, BITS - edges[b + 1]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def rotated(df: DataFrame, fp: str, blocks: int, kept: int, tables: range | None = None) -> DataFrame:
    """``df`` once for each table, or each of ``tables``, with ``block``, its key there, and ``rotated``, its bits moved so that the chosen blocks lead.

    All fingerprints of a table are moved alike, so their distances stay.  The key is the table's
    number and the leading bits, of which there must be less than 56.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), kept))
    orders = [b for chosen in choices for b in [*chosen, *(b for b in range(blocks) if b not in chosen)]]
    array = lambda values: F.lit([int(v) for v in values])
    shifts, widths = array(BITS - edges[b + 1] for b in orders), array(edges[b + 1] - edges[b] for b in orders)
    lead = array(BITS - sum(edges[b + 1] - edges[b] for b in chosen) for chosen in choices)
    rows = df.withColumn("_t", F.explode(F.lit([*(tables or range(len(choices)))]))).withColumn("rotated", F.lit(0).cast("bigint"))
    for j in range(blocks):
        at = F.col("_t") * blocks + j
        width = F.get(widths, at)
        part = F.call_function("shiftrightunsigned", F.col(fp), F.get(shifts, at)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1)
        rows = rows.withColumn("rotated", F.call_function("shiftleft", F.col("rotated"), width).bitwiseOR(part))
    leading = F.call_function("shiftrightunsigned", F.col("rotated"), F.get(lead, F.col("_t")))
    return rows.withColumn("block", F.shiftleft(F.col("_t").cast("bigint"), 56).bitwiseOR(leading)).drop("_t")


def block_tables(fps: DataFrame, blocks: int, kept: int) -> DataFrame:
    """``fps`` (fp, ...) once for each table, with its key there as ``block``."""
    return fps.withColumn("block", F.explode(block_keys(F.col("fp"), blocks, kept)))


def near_pairs(asked: DataFrame, tables: DataFrame, radius: int, blocks: int, kept: int) -> DataFrame:
    """Pairs of an asked ``fp`` and a stored ``other`` at most ``radius`` bits apart, equal ones left out.

    ``asked`` has each ``fp`` once; ``tables`` is ``block_tables`` of the stored ones, whose
    other columns come along.  A pair comes once for each table that it shares.  The join may spill
    and adaptive execution splits the partitions of hot blocks.  It's never a broadcast: the planner
    takes an exploded side to be as large as before, though it has a row for each table.
    """
    left = block_tables(asked.select("fp"), blocks, kept).hint("merge")
    met = tables.withColumnRenamed("fp", "other").join(left, "block")
    return met.filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).drop("block")
