"""Queries that run a stream over the whole table and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.fixtures import CAT
from trellis.functions.text import bare
from trellis.queries.registry import query
from trellis.runtime import load
from trellis.streaming.streams import drain, job_counts, suppress_copies


def _sha(c):
    x = F.lower(bare(c))
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def _read(spark, d, name):
    """The table as a stream, of files in a folder or of the one file."""
    table = load(spark, d, name)
    path, glob = (d, f"{name}.parquet") if not any("/part-" in f for f in table.inputFiles()[:1]) else (f"{d}/{name}.parquet", "*")
    return spark.readStream.schema(table.schema).option("pathGlobFilter", glob).parquet(path)


@query(f"""WITH {CAT}, h AS (SELECT lower(regexp_replace(sha256, '^\\s+|\\s+$', '', 'g')) sha FROM cat), u AS (SELECT DISTINCT lower(regexp_replace(sha256, '^\\s+|\\s+$', '', 'g')) sha FROM upload_queue)
SELECT sha FROM u WHERE regexp_full_match(sha, '[0-9a-f]{{64}}') AND sha NOT IN (SELECT sha FROM h WHERE sha IS NOT NULL)""")
def stream_dedup(spark, d):
    """Content hashes that are new on arrival."""
    history = load(spark, d, "manifest_entries").select(_sha(F.col("sha256")).alias("sha")).filter("sha is not null")
    stream = _read(spark, d, "upload_queue").select(_sha(F.col("sha256")).alias("sha"), F.col("received_at").cast("timestamp").alias("at")).filter("sha is not null")
    return drain(suppress_copies(stream, history, "sha", "at", "3650 days"), "dedup").select("sha")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS since, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_job_counts(spark, d):
    """Updates by day and kind, counted as a stream."""
    stream = _read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    out = drain(job_counts(stream, "at", "event_type", "1 day", "3650 days"), "counts", "complete")
    return out.select(F.unix_micros("window.start").alias("since"), "event_type", "n")
