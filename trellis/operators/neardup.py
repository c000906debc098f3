"""Near duplicates by perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.plans.blocks import block_tables, choose_blocks, near_pairs
from trellis.plans.skew import lookup
from trellis.runtime import Workspace


def near_hashes(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(fp, other, distance): hashes of ``left`` and ``right`` at most ``radius`` bits apart, equal ones too.

    Both sides have ``fp`` (64-bit); null ones match nothing, repeated ones count once, so a
    hash that a third of all rows share is one row here.  They are written once, as they are
    counted and then read for each side; where both sides are one table it's written once as well.
    """
    ws = Workspace(left.sparkSession, "hashes")
    hashes = lambda df: ws.save(df.select("fp").filter("fp is not null").distinct())
    a = hashes(left)
    b = a if right is left else hashes(right)
    blocks, kept = choose_blocks(b.count(), a.count(), radius)
    apart = near_pairs(a, block_tables(b, blocks, kept), radius, blocks, kept).select("fp", "other").distinct()
    same = (a if b is a else a.join(b.hint("merge"), "fp", "left_semi")).select("fp", F.col("fp").alias("other"))
    return apart.unionByName(same).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))))


def since_near(stored: DataFrame, listed: DataFrame, radius: int) -> DataFrame:
    """(fp, since): for each hash of ``stored`` (fp, since) the least ``since`` of one at most ``radius`` bits apart, itself too.

    A hash of ``listed`` was there before all, at -1.  Both are asked in one join, of which only
    the least is kept, so no list of pairs is gathered.
    """
    ws = Workspace(stored.sparkSession, "since")
    rows = stored.select("fp", "since", F.lit(True).alias("asked"))
    rows = rows.unionByName(listed.select("fp", F.lit(-1).cast("bigint").alias("since"), F.lit(False).alias("asked")))
    hashes = ws.save(rows.filter("fp is not null").groupBy("fp").agg(F.min("since").alias("since"), F.max("asked").alias("asked")))
    asked = hashes.filter("asked")
    blocks, kept = choose_blocks(hashes.count(), asked.count(), radius)
    met = near_pairs(asked, block_tables(hashes.select("fp", "since"), blocks, kept), radius, blocks, kept).select("fp", "since")
    return met.unionByName(asked.select("fp", "since")).groupBy("fp").agg(F.min("since").alias("since"))


def top_near(left: DataFrame, right: DataFrame, key: str, other_key: str, radius: int, k: int) -> DataFrame:
    """(key, other_key, distance, rank): the ``k`` nearest rows of ``right`` for each row of ``left``.

    Ties go to the lower ``other_key``.  Of rows with one hash only the ``k`` lowest keys can be
    among the ``k`` nearest, so each hash brings at most ``k`` rows; that drops no result.
    """
    pairs = near_hashes(left, right, radius)
    lowest = Window.partitionBy("fp").orderBy(other_key)
    few = right.filter("fp is not null").select("fp", other_key).distinct().withColumn("n", F.row_number().over(lowest)).filter(F.col("n") <= k)
    near = pairs.join(few.select(F.col("fp").alias("other"), other_key), "other")
    # the answer is the hash's, so it is worked out once for each and a row of at most k hits is looked up
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("distance", other_key))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("fp").agg(F.collect_list(F.struct(other_key, "distance", "rank")).alias("hits"))
    rows = left.select(key, "fp").filter("fp is not null").distinct()
    return lookup(rows, best, "fp", rows.count()).select(key, F.explode("hits").alias("h")).select(key, "h.*")
