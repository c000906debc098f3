"""A queue of jobs kept as a log of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# After how many milliseconds a claim is stale and an ended job is dropped.
STALE_MS, KEPT_MS, STALL_MS = 30 * 60_000, 2 * 3_600_000, 4 * 60_000


def latest(updates: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The last update of each job and when it was created; combined before the shuffle."""
    row = F.struct(*(F.col(c) for c in updates.columns if c != key))
    return updates.groupBy(key).agg(F.max_by(row, F.struct(at, seq)).alias("_row"), F.min(at).alias("created_at")).select(key, "_row.*", "created_at")


def merged(updates: DataFrame, key: str, at: str, seq: str, fields: list[str]) -> DataFrame:
    """Each job as its patches leave it: of each field the last value that a patch has, null where none has one.

    One aggregate over the log, combined before its shuffle; a job's patches are never gathered.
    """
    order = F.struct(at, seq)
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return updates.groupBy(key).agg(*last, F.min(at).alias("created_at"), F.max(at).alias("updated_at"))


def claimable(jobs: DataFrame, now: int) -> DataFrame:
    """Queued jobs, and those in work whose claim is stale, the oldest first by ``rank``."""
    open_ = (F.col("status") == "queued") | ((F.col("status") == "processing") & (F.lit(now) - F.col("updated_at") > STALE_MS))
    return jobs.filter(open_)


def expired(jobs: DataFrame, now: int) -> DataFrame:
    """Ended jobs past their time."""
    return jobs.filter(F.col("status").isin("done", "error") & (F.lit(now) - F.col("updated_at") > KEPT_MS))


def stalls(updates: DataFrame, key: str, at: str, seq: str, signature: list[str], limit: int = STALL_MS) -> DataFrame:
    """(key, since, until): spells in which the signature of a job stayed the same for longer than ``limit``."""
    order = Window.partitionBy(key).orderBy(at, seq)
    sign = F.struct(*signature)
    changed = F.when(F.lag(sign).over(order).isNull() | (F.lag(sign).over(order) != sign), 1).otherwise(0)
    spells = updates.withColumn("_new", changed).withColumn("_spell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spells.groupBy(key, "_spell").agg(F.min(at).alias("since"), F.max(at).alias("until"))
    return out.filter(F.col("until") - F.col("since") > limit).drop("_spell")
