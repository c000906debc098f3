"""One row of each group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_of(rows: DataFrame, key: str, score: Column, seq: str) -> DataFrame:
    """The row of the highest score of each key, the lower ``seq`` on a tie; rows without a key all stay.

    An argument-maximum aggregate, combined before the shuffle: a key that a third of all rows
    share is one row a task by then.  ``seq`` is a unique number.
    """
    keyed = rows.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    best = keyed.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(score, -F.col(seq))).alias("_row")).select("_row.*")
    return best.unionByName(rows.filter(F.col(key).isNull() | (F.col(key) == "")))


def record_score(url: Column, link: Column, description: Column, edited: Column) -> Column:
    """Hundred for a URL, ten for a link, five for a description, and a little for a late edit."""
    has = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    return F.lit(100.0) * has(url) + F.lit(10.0) * has(link) + F.lit(5.0) * has(description) + F.coalesce(F.unix_millis(edited), F.lit(0)) / F.lit(1e13)


def split_known(incoming: DataFrame, history: DataFrame, key: str, seq: str) -> DataFrame:
    """``incoming`` with ``fate``: "known" if the history has its key, "first" or "repeat" within the batch.

    Rows with a null key are "first".  Keys are pre-aggregated on both sides.  No side is
    broadcast: the planner takes a column of long keys for as small as it is in its file.
    """
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("_first"))
    known = first.join(history.select(key).distinct().hint("merge"), key, "left_semi").select(key, F.lit(True).alias("_known"))
    marked = first.join(known.hint("merge"), key, "left")
    # rows without a key need no match, and together they would be one task
    out = incoming.filter(F.col(key).isNotNull()).join(marked.hint("merge"), key, "left").unionByName(incoming.filter(F.col(key).isNull()), allowMissingColumns=True)
    fate = F.when(F.col("_known"), "known").when(F.col("_first") < F.col(seq), "repeat").otherwise("first")
    return out.withColumn("fate", fate).drop("_first", "_known")
