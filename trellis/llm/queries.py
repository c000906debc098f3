"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.bpe import encode
from trellis.llm.canonical import map_to_reference
from trellis.llm.components import connected_components
from trellis.llm.history import mark_duplicates
from trellis.llm.ids import dashed_id, phash_bits, sha256_hex
from trellis.llm.names import linked_spellings
from trellis.llm.nearest import similar_vectors, usable
from trellis.llm.packing import pack
from trellis.llm.sentences import split_sentences
from trellis.llm.similar_sets import similar_records
from trellis.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked asset with the smallest id of its group."""
    hits = load(spark, sf_dir, "similar_hits").filter("distance between 0 and 6")
    return connected_components(hits.select(dashed_id(F.col("asset_id")).alias("src"), dashed_id(F.col("id")).alias("dst")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of the same person or organisation."""
    tags = load(spark, sf_dir, "person_tags").select("name")
    credits = load(spark, sf_dir, "manifest_entries").select(F.col("credit").alias("name"))
    groups = linked_spellings(tags.unionByName(credits), "name")
    a = groups.select("group_id", F.col("spelling").alias("name_a"))
    b = groups.select("group_id", F.col("spelling").alias("name_b"))
    return a.join(b, "group_id").filter("name_a < name_b").select("name_a", "name_b")


def _usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, v) of the usable vectors; index_meta has one row an index and is left to the planner to broadcast."""
    meta = load(spark, sf_dir, "index_meta").select("index_no", "dimensions").dropDuplicates(["index_no"])
    rows = load(spark, sf_dir, "index_vectors").join(meta, "index_no").filter(usable(F.col("vectors"), F.col("dimensions")))
    return rows.select(F.col("vec_id").alias("id"), F.col("index_no").alias("grp"), F.col("vectors").alias("v"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one index with a cosine of at least 0.8, one among the 5 most similar of the other."""
    return similar_vectors(_usable_vectors(spark, sf_dir)).select("vec_a", "vec_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that show an image of the catalogue or of an earlier upload."""
    keys = lambda df, batch, seq: df.select(batch.alias("batch"), seq.alias("seq"), F.unhex(sha256_hex(F.col("sha256"))).alias("sha"), phash_bits(F.col("phash")).alias("fp"))
    # batch numbers begin with 1; the catalogue is what was accepted before
    history = keys(load(spark, sf_dir, "manifest_entries"), F.lit(0), F.col("entry_no"))
    uploads = keys(load(spark, sf_dir, "upload_queue"), F.col("batch_no"), F.col("upload_id"))
    # the anchor keeps the first batch from passing as history where the catalogue is empty
    anchor = spark.sql("select 0 batch, -1L seq, cast(null as binary) sha, cast(null as bigint) fp")
    return mark_duplicates(history.unionByName(uploads).unionByName(anchor)).select(F.col("seq").alias("upload_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue entry that each typed or guessed product means, 0 if there is none."""
    catalog = load(spark, sf_dir, "product_catalog").dropDuplicates(["product_id"])
    one = load(spark, sf_dir, "manifest_entries").select(F.lit("product").alias("field"), F.col("entry_no").alias("record_no"), F.lit(1).alias("pos"), F.col("product").alias("value"))
    many = load(spark, sf_dir, "asset_manifests").select(F.lit("products_or_flowers").alias("field"), F.col("manifest_id").alias("record_no"), F.posexplode("products_or_flowers").alias("at", "value"))
    many = many.select("field", "record_no", (F.col("at") + 1).alias("pos"), "value")
    rows = one.unionByName(many).filter(F.regexp_replace("value", r"(?U)\s+", "") != "")
    names = catalog.select(F.col("product_name").alias("value")).distinct()
    rows = rows.join(names, "value", "left_anti").distinct()
    found = map_to_reference(rows, "value", catalog, "product_id", "product_name", "sku")
    return found.select("field", "record_no", "pos", F.coalesce("entry", F.lit(0)).cast("bigint").alias("product_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of manifests of at least 5 terms whose sets share at least 0.8 of all terms."""
    table = load(spark, sf_dir, "asset_manifests")
    members, pairs = similar_records(table, "manifest_id", ["visual_tags", "mood_tone"])
    a = members.select(F.col("set_id").alias("set_a"), F.col("manifest_id").alias("manifest_a"))
    b = members.select(F.col("set_id").alias("set_b"), F.col("manifest_id").alias("manifest_b"))
    across = pairs.join(a, "set_a").join(b, "set_b")
    within = a.join(b, F.col("set_a") == F.col("set_b")).filter("manifest_a < manifest_b")
    ends = [F.least("manifest_a", "manifest_b").alias("manifest_a"), F.greatest("manifest_a", "manifest_b").alias("manifest_b")]
    return across.select(*ends).unionByName(within.select("manifest_a", "manifest_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every manifest of at least 5 terms with its set's id and the number of other sets similar to it."""
    members, pairs = similar_records(load(spark, sf_dir, "asset_manifests"), "manifest_id", ["visual_tags", "mood_tone"])
    links = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    return members.join(links, "set_id", "left").select("manifest_id", F.col("set_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every text; none for a null or empty one."""
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or part of a text of more than 2 048 tokens, with its container."""
    sizes = encode(load(spark, sf_dir, "documents"), "doc_id", "text", only_sizes=True)
    return pack(sizes, "doc_id", "tokens", 2048)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every text, in order."""
    return split_sentences(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_classes": p6_classes, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}

_HEX = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_ID = "regexp_replace(replace(" + _HEX + ", '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"

_SETS = """
s AS (
  SELECT DISTINCT manifest_id, list_sort(list_distinct(list_filter(list_transform(
    list_concat(coalesce(visual_tags, []), coalesce(mood_tone, [])), lambda t: lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))),
    lambda t: t IS NOT NULL AND t <> ''))) terms
  FROM asset_manifests
), big AS (SELECT manifest_id, terms FROM s WHERE len(terms) >= 5)
"""

ORACLES = {
    "p6_found": f"""
WITH {_SETS}
SELECT a.manifest_id AS manifest_a, b.manifest_id AS manifest_b
FROM big a JOIN big b ON a.manifest_id < b.manifest_id
 AND 10 * len(list_intersect(a.terms, b.terms)) >= 8 * (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms)))
""",
    "p6_classes": f"""
WITH {_SETS}, c AS (SELECT terms, min(manifest_id) AS set_id FROM big GROUP BY terms),
l AS (
  SELECT a.set_id, count(*) AS n FROM c a JOIN c b ON a.set_id <> b.set_id
   AND 10 * len(list_intersect(a.terms, b.terms)) >= 8 * (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms)))
  GROUP BY a.set_id
)
SELECT big.manifest_id, c.set_id AS class_id, coalesce(l.n, 0) AS links
FROM big JOIN c USING (terms) LEFT JOIN l ON l.set_id = c.set_id
""",
    "p1_found": f"""
WITH RECURSIVE hits AS (
  SELECT {_ID.format(c='asset_id')} a, {_ID.format(c='id')} b FROM similar_hits WHERE distance BETWEEN 0 AND 6
), e AS (
  SELECT a, b FROM hits WHERE a <> '' AND b <> '' AND a <> b
  UNION SELECT b, a FROM hits WHERE a <> '' AND b <> '' AND a <> b
), reach(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
)
SELECT a AS id, least(a, min(b)) AS group_id FROM reach GROUP BY a
""",
    "p3_found": """
WITH v AS (
  SELECT DISTINCT vec_id, index_no, list_transform(vectors, lambda x: x::DOUBLE) v FROM index_vectors JOIN index_meta USING (index_no)
  WHERE len(vectors) = dimensions AND len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vectors, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id me, b.vec_id it, list_cosine_similarity(a.v, b.v) c
  FROM v a JOIN v b ON a.index_no = b.index_no AND a.vec_id <> b.vec_id
), r AS (SELECT me, it, c, row_number() OVER (PARTITION BY me ORDER BY c DESC, it) k FROM p WHERE c >= 0.8)
SELECT DISTINCT least(me, it) AS vec_a, greatest(me, it) AS vec_b FROM r WHERE k <= 5
""",
    "p4_found": f"""
WITH h AS (
  SELECT 0 AS batch_no, 0 AS upload_id, {_HEX.format(c='sha256')} sha, {_HEX.format(c='phash')} ph FROM manifest_entries
), u AS (
  SELECT DISTINCT batch_no, upload_id, {_HEX.format(c='sha256')} sha, {_HEX.format(c='phash')} ph FROM upload_queue
), k AS (
  SELECT batch_no, upload_id, CASE WHEN regexp_full_match(sha, '[0-9a-f]{{64}}') THEN sha END sha,
         CASE WHEN regexp_full_match(ph, '[0-9a-f]{{16}}') THEN ('0x' || ph)::UBIGINT END fp
  FROM (SELECT * FROM h UNION ALL SELECT * FROM u)
)
SELECT DISTINCT n.upload_id FROM k n JOIN k o
  ON (o.batch_no < n.batch_no OR (o.batch_no = n.batch_no AND o.upload_id < n.upload_id))
 AND (n.sha = o.sha OR bit_count(xor(n.fp, o.fp)) <= 6)
WHERE n.batch_no > 0
""",
}
