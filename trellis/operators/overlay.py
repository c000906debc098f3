"""A base table under upserts and deletes that came since it was built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(updates: DataFrame, key: str, seq: str, last: list[str], keep: list[str], first: list[str]) -> DataFrame:
    """One row a key of ordered updates.

    ``last`` columns have the last value, blanks included; ``keep`` the last that isn't null or
    empty; ``first`` the first.  Aggregates are combined before the shuffle, so a key with very
    many updates is one row a task by then.
    """
    present = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return updates.groupBy(key).agg(
        *(F.max_by(F.struct(c), seq)[c].alias(c) for c in last),
        *(F.max_by(F.when(present(c), F.col(c)), F.when(present(c), F.col(seq))).alias(c) for c in keep),
        *(F.min_by(F.struct(c), seq)[c].alias(c) for c in first),
    )


def merge(base: DataFrame, overlay: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """The base rows neither updated nor deleted, then the overlay's, as ``is_overlay`` says.

    Deletes don't touch the overlay: a row written after its delete is there again.
    """
    gone = overlay.select(key).unionByName(tombstones.select(key)).distinct()
    left = base.join(gone, key, "left_anti").withColumn("is_overlay", F.lit(False))
    return left.unionByName(overlay.withColumn("is_overlay", F.lit(True)), allowMissingColumns=True)


def state(ids: DataFrame, base: DataFrame, overlay: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """``ids`` with ``searchable``: in the overlay, or in the base and not deleted."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = ids.join(mark(overlay, "o"), key, "left").join(mark(base, "b"), key, "left").join(mark(tombstones, "t"), key, "left")
    return out.withColumn("searchable", F.coalesce(F.col("o") | (F.col("b") & F.col("t").isNull()), F.col("o"), F.lit(False))).drop("o", "b", "t")
