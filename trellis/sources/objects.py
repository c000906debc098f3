"""Objects of a store as rows: job records, vector blobs, listings; and the index as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import filled

JOB = """id string, status string, filename string, ext string, remove_chrome boolean, on_similar string, step string, total_scenes int, processed int,
frames array<struct<asset_id:string,url:string,title:string,t:double,deduped:boolean,score:double>>, error string, created_at bigint, updated_at bigint, claimed_at bigint"""


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job records under a prefix, one JSON document a file; unreadable ones are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="job.json")
    return raw.select(F.from_json("value", JOB).alias("j")).filter("j.id is not null").select("j.*")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(key, size, modified) of the objects under a prefix, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def blobs(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """(key, blob) of binary objects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("key"), F.col("content").alias("blob"))


def write_index(index: DataFrame, path: str) -> None:
    """The index as one Parquet table, vectors beside their rows; replaces what is there."""
    index.write.mode("overwrite").parquet(path)


def export_json(index: DataFrame, path: str) -> None:
    """The index's metadata as JSON lines; empty texts are left out."""
    fields = [filled(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in index.dtypes if not t.startswith("array<float")]
    index.select(*fields).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index table, or None if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(path)


def missing_columns(df: DataFrame, wanted: dict[str, str]) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """(columns to add with their types, columns of another type: (is, wanted))."""
    have = dict(df.dtypes)
    return {c: t for c, t in wanted.items() if c not in have}, {c: (have[c], t) for c, t in wanted.items() if c in have and have[c] != t}


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The table with the wanted columns it lacks, all null."""
    add, _ = missing_columns(df, wanted)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in add.items()}) if add else df
