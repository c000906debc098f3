"""Splitting a table by ranges of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 12


def months(df: DataFrame, at: str) -> DataFrame:
    """(since, until) of each UTC month from the first to the last value; none for an empty table."""
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo is not null")
    month = F.explode(F.sequence(F.date_trunc("month", F.col("lo")), F.date_trunc("month", F.col("hi")), F.expr("interval 1 month"))).alias("since")
    return ends.select(month).withColumn("until", F.col("since") + F.expr("interval 1 month"))


def bisected(df: DataFrame, at: str, cap: int, depth: int = DEPTH) -> DataFrame:
    """(level, cell, n): the range halved until each part holds at most ``cap`` rows, or ``depth`` times.

    All levels are counted in one pass, a row of counts for each cell; no recursion and no
    repeated scan.  ``at`` is a whole number.
    """
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    share = (F.col(at) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(1))
    finest = df.join(F.broadcast(ends)).select(F.floor(share * (1 << depth)).cast("bigint").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    levels = finest.select("n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "f")
    cells = levels.groupBy("level", F.call_function("shiftright", F.col("f"), F.lit(depth) - F.col("level")).alias("cell")).agg(F.sum("n").alias("n"))
    above = cells.select((F.col("level") + 1).alias("level"), F.col("cell").alias("up"), F.col("n").alias("up_n"))
    joined = cells.withColumn("up", F.call_function("shiftright", F.col("cell"), F.lit(1))).join(above, ["level", "up"], "left")
    whole = (F.col("n") <= cap) | (F.col("level") == depth)
    return joined.filter(whole & (F.col("up_n").isNull() | (F.col("up_n") > cap))).select("level", "cell", "n")
