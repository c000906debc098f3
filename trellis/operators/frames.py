"""Selecting frames: when to look, which belong to one scene, which are best."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

# Fixed values of the selection.
END_MARGIN, FIRST_LOOK, LEAST_GAP = 0.3, 0.2, 0.4
SCENE_BITS, SCENE_CANDIDATES, LEAST_OVERALL, SCENES, FRAMES = 10, 3, 3.0, 12, 24


def plan(duration: Column, scenes: Column, most: int = FRAMES) -> Column:
    """Times to look at: just after the start, at each scene, and evenly; at most ``most``.

    A time is kept, rounded, if it is more than a gap past the rounded one kept before it.
    """
    end = F.greatest(F.lit(0.0), duration - END_MARGIN)
    n = F.least(F.lit(8), F.greatest(F.lit(3), F.floor(duration / 3).cast("int") + 1))
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + F.lit(0.5)) * end / n)
    every = F.array_sort(F.filter(F.concat(F.array(F.lit(FIRST_LOOK)), F.coalesce(scenes, F.array().cast("array<double>")), even), lambda t: t.between(0, end)))
    none = F.array().cast("array<double>")
    spaced = F.aggregate(every, none, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > LEAST_GAP), F.array_append(kept, F.floor(t * 100 + 0.5) / 100)).otherwise(kept))
    step = F.size(spaced) / F.lit(float(most))
    thin = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(spaced, F.floor(i * step).cast("int")))
    return F.when(F.size(spaced) > most, thin).otherwise(spaced)


def scenes(frames: DataFrame, video: str, at: str, bits: str, distance: int = SCENE_BITS) -> DataFrame:
    """``frames`` with ``scene`` (from 0): each joins the first scene whose first frame is near, else opens one.

    The fold depends on the order within a video; a video has at most a few dozen frames by
    ``plan``, so it is one group, and videos are independent.
    """
    schema = StructType([*frames.schema.fields, StructField("scene", IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at], kind="stable")
        anchors: list[int] = []
        found = []
        for x in (int(b) for b in pdf[bits]):
            scene = next((k for k, a in enumerate(anchors) if ((a ^ x) & (1 << 64) - 1).bit_count() <= distance), len(anchors))
            if scene == len(anchors):
                anchors.append(x)
            found.append(scene)
        return pdf.assign(scene=pd.array(found, "int32"))

    return frames.groupBy(video).applyInPandas(run, schema)


def best_frames(frames: DataFrame, group: list[str], sharpness: str, overall: str, at: str, least: float = LEAST_OVERALL) -> DataFrame:
    """The best frame of each group: of its sharpest few, the one of the highest overall score.

    If none of them has a score, the sharpest; a group whose best score is below ``least`` is
    left out.
    """
    sharp = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(sharpness), at))
    few = frames.withColumn("_rank", sharp).filter(F.col("_rank") <= SCENE_CANDIDATES)
    row = F.struct(*(F.col(c) for c in frames.columns if c not in group))
    best = few.groupBy(*group).agg(F.max_by(row, F.struct(F.coalesce(overall, F.lit(float("-inf"))), -F.col("_rank"))).alias("_row"))
    return best.select(*group, "_row.*").filter(F.col(overall).isNull() | (F.col(overall) >= least))


def top_scenes(best: DataFrame, video: str, overall: str, sharpness: str, at: str, most: int = SCENES) -> DataFrame:
    """The ``most`` best scenes of each video with ``place`` in order of time."""
    value = F.coalesce(overall, sharpness)
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.desc(value), at))
    kept = best.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(video).orderBy(at)))
