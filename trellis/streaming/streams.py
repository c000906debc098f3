"""Incremental forms on Structured Streaming: suppression of copies, the overlay, the job log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.runtime import Workspace


def suppress_copies(stream: DataFrame, history: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Rows of a stream whose key is new: neither in the history nor earlier in the stream within ``delay``.

    The stream's own copies are held in state until the watermark passes; the history is a
    static side, joined again for each batch.
    """
    fresh = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return fresh.join(history.select(key).distinct(), key, "left_anti")


def partial_fold(updates: DataFrame, key: str, seq: str, last: list[str], keep: list[str], first: list[str]) -> DataFrame:
    """One row a key: each column's value with the number of the update it came from.

    Partial folds of any split of the updates, in any order, fold to the same result.
    """
    present = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(seq))
    aggs = []
    for c in last:
        aggs += [F.max_by(F.struct(c), seq)[c].alias(c), F.max(seq).alias(f"{c}__seq")]
    for c in keep:
        aggs += [F.max_by(c, present(c)).alias(c), F.max(present(c)).alias(f"{c}__seq")]
    for c in first:
        aggs += [F.min_by(F.struct(c), seq)[c].alias(c), F.min(seq).alias(f"{c}__seq")]
    return updates.groupBy(key).agg(*aggs)


def fold_into(store: str, key: str, seq: str, last: list[str], keep: list[str], first: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds each micro-batch's partial fold to the overlay's log.

    Each batch is one partition of the log, overwritten if it is run again, so a batch that is
    retried after a lost executor counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial_fold(batch, key, seq, last, keep, first).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return write


def read_overlay(log: DataFrame, key: str, last: list[str], keep: list[str], first: list[str]) -> DataFrame:
    """The overlay from its log of partial folds."""
    latest = [F.max_by(F.struct(c), f"{c}__seq")[c].alias(c) for c in [*last, *keep]]
    return log.groupBy(key).agg(*latest, *(F.min_by(F.struct(c), f"{c}__seq")[c].alias(c) for c in first))


def job_counts(updates: DataFrame, at: str, status: str, width: str, delay: str) -> DataFrame:
    """Updates by status in windows of event time; late ones are counted until the watermark passes."""
    return updates.withWatermark(at, delay).groupBy(F.window(at, width), status).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, as a table."""
    ws = Workspace(stream.sparkSession, label)
    out = f"{ws.root}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{ws.root}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
