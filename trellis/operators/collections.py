"""Named collections of entries, as rows (collection_id, pos, entry)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import bare, filled, text

# Fixed value: members that a summary counts.
COUNTED = 25


def named(names: DataFrame, column: str) -> DataFrame:
    """A blank name becomes "Untitled collection"."""
    return names.withColumn(column, F.coalesce(filled(bare(text(F.col(column)))), F.lit("Untitled collection")))


def summaries(members: DataFrame, key: str) -> DataFrame:
    """(key, items, partial): members counted up to COUNTED; counted before the shuffle, never gathered."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(key, F.least("n", F.lit(COUNTED)).alias("items"), (F.col("n") > COUNTED).alias("partial"))


def items(members: DataFrame, entries: DataFrame, entry: str) -> DataFrame:
    """Members with their entries; those whose entry is gone are left out, positions stay."""
    return members.join(entries, entry)


def search(summaries_: DataFrame, name: str, wanted: str) -> DataFrame:
    """Collections whose name holds the wanted text, whatever its case; all for a blank one."""
    q = wanted.strip().lower()
    return summaries_.filter(F.contains(F.lower(F.col(name)), F.lit(q))) if q else summaries_
