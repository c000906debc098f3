"""The supplied tables as the engine's own: catalogue, vectors, people, job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.parse import people_names, split_list
from trellis.functions.text import haystack, text
from trellis.functions.vectors import usable
from trellis.operators.overlay import merge
from trellis.runtime import Workspace, load

#: The query of the search examples.
QUERY = "Soft garden with Kenneth Gidovalu lumen wreath"
#: Vectors of this index belong to the catalogue.
INDEX = 1


_CURATED: dict[tuple, DataFrame] = {}


def curated(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """The table with each key once, written once for a session; what reads it shuffles nothing for that.

    Filters and projections of the readers reach its scan.  A table that has changed since is
    written anew.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()
    name = (spark.sparkContext.applicationId, d, table, *state)
    if name not in _CURATED:
        rows = load(spark, d, table).dropDuplicates([key])
        if table == "manifest_entries":
            rows = rows.withColumn("plain_id", plain_id(F.col("id")))
        _CURATED[name] = Workspace(spark, table).save(rows)
    return _CURATED[name]


def plain_id(c: Column) -> Column:
    """An id in the form it is looked up by: lower case, without white space around and dashes."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "-", "")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """The accepted entries, each once."""
    return curated(spark, d, "manifest_entries", "entry_no").drop("plain_id")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def vectors(spark: SparkSession, d: str, index: int | None = INDEX) -> DataFrame:
    """(id, entry_no, v): the usable vectors of an index, or of all, each once."""
    meta = load(spark, d, "index_meta").select("index_no", "dimensions").dropDuplicates(["index_no"])
    if index is not None:
        meta = meta.filter(F.col("index_no") == index)
    rows = load(spark, d, "index_vectors").join(meta, "index_no").filter(usable(F.col("vectors"), F.col("dimensions")))
    return rows.select(F.col("vec_id").alias("id"), "entry_no", F.col("vectors").alias("v")).dropDuplicates(["id"])


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector asked for in the search examples: that of the lowest id. One row comes to the driver."""
    row = vectors(spark, d).orderBy("id").select("v").first()
    return [float(x) for x in row["v"]] if row else []


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as search sees it: (entry_no, title, created, people, product, hay, v)."""
    lowest = vectors(spark, d).groupBy("entry_no").agg(F.min_by("v", "id").alias("v"))
    rows = catalog(spark, d).filter("not archived").select(
        "entry_no", "title", micros(F.col("created_time")).alias("created"), people_names(F.col("people")).alias("people"), text(F.col("product")).alias("product"),
        haystack(*(text(F.col(c)) for c in ("title", "description", "context")), F.array_join(people_names(F.col("people")), " "), *(text(F.col(c)) for c in ("product", "location", "source")), F.array_join(split_list(F.col("tags")), " ")).alias("hay"),
    )
    return rows.join(lowest, "entry_no", "left")


def composed(spark: SparkSession, d: str) -> DataFrame:
    """What a search sees: the catalogue under the edits and deletes that came since its index was built.

    Every tenth entry was edited since, half of these without a vector yet; every seventeenth was deleted.
    """
    base = searchable(spark, d)
    edited = base.filter("entry_no % 10 = 0").withColumns({
        "title": F.concat(F.lit("edited "), text(F.col("title"))), "hay": F.concat(F.lit("edited "), F.col("hay")), "v": F.when(F.col("entry_no") % 20 == 0, F.col("v")),
    })
    return merge(base, edited, base.filter("entry_no % 17 = 0").select("entry_no"), "entry_no")


def job_updates(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, seq, at, status, progress): events read as updates of one job a user; ``at`` in milliseconds."""
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    e = load(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.try_element_at(status, F.col("event_type")).alias("status"), F.floor("value").cast("bigint").alias("progress"))


STATUS = {"view": "queued", "click": "processing", "purchase": "done", "signup": "done", "error": "error"}

# ------------------------------------------------ the same in SQL

_ENDS = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CAT = "cat AS (SELECT DISTINCT * FROM manifest_entries)"
SPLIT = r"list_filter(list_transform(string_split_regex(coalesce({0}, ''), '[,;]+'), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '')"
NAMES = (
    r"(CASE WHEN regexp_replace({0}, '^\s+|\s+$', '', 'g') LIKE '[%' AND json_valid({0}) THEN list_filter(list_transform(json_extract({0}, '$[*]'), "
    r"lambda m: CASE WHEN json_type(m) = 'OBJECT' THEN m->>'$.name' ELSE m->>'$' END), lambda n: n IS NOT NULL AND n <> '') ELSE " + SPLIT + " END)"
)
HAY = (
    "lower(concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(context, ''), nullif(array_to_string(" + NAMES.format("people") + ", ' '), ''), nullif(product, ''), nullif(location, ''), nullif(source, ''), "
    "nullif(array_to_string(" + SPLIT.format("tags") + ", ' '), '')))"
)
VEC = """vec AS (SELECT DISTINCT vec_id id, entry_no, list_transform(vectors, lambda x: x::DOUBLE) v FROM index_vectors JOIN index_meta USING (index_no)
  WHERE index_no = 1 AND len(vectors) = dimensions AND len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0)"""
VEC_ALL = VEC.replace("index_no = 1 AND ", "")
UNIT = "list_transform({0}, lambda x: (x / sqrt(list_dot_product({0}, {0})))::FLOAT::DOUBLE)"
SEARCH = f"""{CAT}, {VEC}, low AS (SELECT entry_no, arg_min(v, id) v FROM vec GROUP BY entry_no),
rows_ AS (SELECT cat.entry_no, title, epoch_us(created_time) created, {NAMES.format('people')} people, coalesce(product, '') product, {HAY} hay, low.v
  FROM cat LEFT JOIN low USING (entry_no) WHERE NOT archived)"""
COMPOSED = f"""{SEARCH}, seen AS (SELECT entry_no, title, created, people, product, hay, v, false is_overlay FROM rows_ WHERE entry_no % 10 <> 0 AND entry_no % 17 <> 0
UNION ALL SELECT entry_no, 'edited ' || coalesce(title, ''), created, people, product, 'edited ' || hay, CASE WHEN entry_no % 20 = 0 THEN v END, true FROM rows_ WHERE entry_no % 10 = 0)"""
JOBS = "u AS (SELECT user_id job_id, event_id seq, epoch_us(ts) // 1000 at_, map {'view': 'queued', 'click': 'processing', 'purchase': 'done', 'signup': 'done', 'error': 'error'}[event_type] status, floor(value)::BIGINT progress FROM events)"
