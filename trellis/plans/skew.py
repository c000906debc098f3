"""Equi-joins against a unique side when a few keys of the other side are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task takes well; up to so many a key isn't split.
TASK_ROWS = 250_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, salts): the keys of more rows than a task takes, and over how many tasks each goes.

    There are at most rows / TASK_ROWS of them.  The count is combined before its shuffle.
    Null keys never match and aren't listed.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > TASK_ROWS).select(key, F.ceil(F.col("_n") / TASK_ROWS).cast("int").alias("_salts"))


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` on ``key``; ``right`` has each key once.

    Rows of a hot key are spread over as many tasks as they fill, and only that key's one row of
    ``right`` is repeated for them, so a key with a third of all rows doesn't make one long task.
    Nulls of a left join are spread as well.  ``rows`` is about the number of left rows.
    """
    if rows <= TASK_ROWS:
        return left.join(right, key, how)
    hot = hot_keys(left, key)
    # of 16 bytes and a key each, one for TASK_ROWS rows at most
    salts = F.coalesce("_salts", F.lit(1))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    spread = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    if how != "left":
        return salted.join(spread, [key, "_salt"], how).drop("_salt")
    known = salted.filter(F.col(key).isNotNull()).join(spread, [key, "_salt"], "left").drop("_salt")
    return known.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
