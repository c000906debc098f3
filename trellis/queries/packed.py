"""Queries on fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.packed import BROKEN_ARRAY
from trellis.operators.packed import packed_values
from trellis.runtime import load


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each people and tags text that holds at least two."""
    rows = packed_values(load(spark, sf_dir, "manifest_entries"), "entry_no", ["people", "tags"])
    rows = rows.filter((F.col("values") >= 2) & ~F.array_contains("errors", BROKEN_ARRAY))
    return rows.select(F.col("key").alias("entry_no"), "field", "pos", "item")


def p7_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each field carry each error flag."""
    rows = packed_values(load(spark, sf_dir, "manifest_entries"), "entry_no", ["people", "tags"]).filter("pos = 1")
    flag = F.explode(F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.lit("none")))).alias("flag")
    return rows.select("field", flag).groupBy("field", "flag").agg(F.count("*").alias("texts"))


QUERIES = {"p7_found": p7_found, "p7_errors": p7_errors}
ORACLES: dict[str, str] = {}
