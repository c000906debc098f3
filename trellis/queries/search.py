"""Search: vectors, lexical boosts, keywords, overlay and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.fixtures import CAT, COMPOSED, HAY, NAMES, QUERY, SEARCH, UNIT, VEC, VEC_ALL, catalog, composed, micros, query_vector, searchable, vectors
from trellis.functions.parse import people_names
from trellis.functions.text import direct_hit, filled, keyword_boost, text, tokens
from trellis.functions.vectors import norm, unit
from trellis.operators import overlay, search
from trellis.queries.registry import query
from trellis.runtime import load

_Q = QUERY.lower()
_TERMS = "[" + ", ".join(f"'{t}'" for t in _Q.split()) + "]"
_BOOST = f"""(CASE WHEN len(list_filter(people, lambda n: n <> '' AND contains('{_Q}', lower(n)))) > 0 THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN product <> '' AND contains('{_Q}', lower(product)) THEN 0.15::DOUBLE ELSE 0 END)"""
_HIT = f"""(CASE WHEN hay = '' THEN 0::DOUBLE WHEN contains(hay, '{_Q}') THEN 0.5::DOUBLE ELSE 0.45::DOUBLE * len(list_filter({_TERMS}, lambda t: length(t) >= 2 AND contains(hay, t))) / {len(_Q.split())} END)"""
_SCORED = f"""{COMPOSED}, q AS (SELECT {UNIT.format('v')} qv FROM vec ORDER BY id LIMIT 1),
nears AS (SELECT entry_no, list_dot_product({UNIT.format('low.v')}, qv) near FROM low CROSS JOIN q),
boosted AS (SELECT *, {_BOOST} + {_HIT} boost FROM seen),
scored AS (SELECT entry_no, CASE WHEN v IS NOT NULL THEN near ELSE 0 END + boost AS full_score, round(full_score, 6) score
  FROM boosted LEFT JOIN nears USING (entry_no) WHERE v IS NOT NULL OR boost > 0)"""


@query(f"WITH {VEC_ALL} SELECT id, round(sqrt(list_dot_product(v, v)), 4) AS length, round(list_sum({UNIT.format('v')}), 4) AS total FROM vec")
def unit_normalize(spark, d):
    u = unit(F.col("v"))
    return vectors(spark, d, None).select("id", F.round(norm(F.col("v")), 4).alias("length"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"""WITH {VEC}, q AS (SELECT {UNIT.format('v')} qv FROM vec ORDER BY id LIMIT 1), s AS (SELECT id, list_dot_product({UNIT.format('v')}, qv) score FROM vec, q)
SELECT row_number() OVER (ORDER BY score DESC, id)::BIGINT AS rank, id, round(score, 6) AS score FROM s ORDER BY rank LIMIT 10""")
def cosine_topk(spark, d):
    return search.cosine_top(vectors(spark, d), query_vector(spark, d), 10).select("rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT row_number() OVER (ORDER BY full_score DESC, entry_no)::BIGINT AS rank, entry_no, score FROM scored ORDER BY full_score DESC, entry_no LIMIT 300")
def hybrid_search(spark, d):
    """Ranked over the catalogue, its edits and its deletes together."""
    rows = search.hybrid(composed(spark, d), QUERY, query_vector(spark, d)).select("entry_no", "score")
    return search.page(rows, [F.desc("score"), "entry_no"], 0, search.RANKED).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SCORED}, r AS (SELECT row_number() OVER (ORDER BY full_score DESC, entry_no)::BIGINT AS rank, entry_no, score FROM scored)
SELECT rank, entry_no, score, CASE WHEN 48 < least(300, (SELECT count(*) FROM scored)) THEN 48::BIGINT END AS next_cursor FROM r WHERE rank > 24 AND rank <= 48""")
def search_page(spark, d):
    rows = search.hybrid(composed(spark, d), QUERY, query_vector(spark, d)).select("entry_no", "score")
    order = [F.desc("score"), "entry_no"]
    more = search.page(rows, order, search.offset_of("24"), search.PAGE + 1)  # one row more tells whether a page follows
    more = more.withColumn("last", F.max("rank").over(search.Window.partitionBy()))
    return more.filter("rank <= 48").select("rank", "entry_no", F.round("score", 6).alias("score"), F.when(F.col("last") > 48, F.lit(48).cast("bigint")).alias("next_cursor"))


@query(f"WITH {SEARCH} SELECT entry_no, round({_BOOST}, 2) AS boost FROM rows_")
def keyword_boost_of_rows(spark, d):
    return searchable(spark, d).select("entry_no", F.round(keyword_boost(F.lit(_Q), F.col("people"), F.col("product")), 2).alias("boost"))


@query(f"WITH {SEARCH} SELECT entry_no, round({_HIT}, 4) AS boost FROM rows_")
def direct_hit_of_rows(spark, d):
    terms = F.array(*(F.lit(t) for t in _Q.split()))
    return searchable(spark, d).select("entry_no", F.round(direct_hit(F.lit(_Q), terms, F.col("hay")), 4).alias("boost"))


@query(rf"WITH {CAT} SELECT entry_no, array_to_string(list_filter(string_split_regex(lower(coalesce(description, '')), '\s+'), lambda t: t <> ''), '|') AS tokens FROM cat")
def tokenize(spark, d):
    return catalog(spark, d).select("entry_no", F.array_join(tokens(F.col("description")), "|").alias("tokens"))


@query(f"WITH {CAT} SELECT entry_no, {HAY} AS hay FROM cat WHERE NOT archived")
def haystack(spark, d):
    return searchable(spark, d).select("entry_no", "hay")


@query(f"""WITH {CAT}, b AS (SELECT entry_no, created_time, entry_no % 10 = 0 is_overlay FROM cat WHERE NOT archived AND (entry_no % 10 = 0 OR entry_no % 17 <> 0))
SELECT row_number() OVER (ORDER BY is_overlay DESC, created_time DESC, entry_no)::BIGINT AS rank, entry_no, is_overlay FROM b ORDER BY rank LIMIT 24""")
def recent_browse(spark, d):
    """The newest first: what came since the index was built before the rest of it."""
    base = catalog(spark, d).filter("not archived").select("entry_no", "created_time")
    rows = overlay.merge(base, base.filter("entry_no % 10 = 0"), base.filter("entry_no % 17 = 0").select("entry_no"), "entry_no")
    return search.page(rows, [F.desc("is_overlay"), F.desc("created_time"), "entry_no"], 0, cap=None).select("rank", "entry_no", "is_overlay")


_FIELDS = ["title", "description", "context", "product", "location", "tags", "no_such_field", "archived"]
_LIKE = " AND ".join("(" + " OR ".join(f"contains(lower(coalesce({f}, '')), '{t}')" for f in _FIELDS[:6]) + ")" for t in ("soft", "garden"))


@query(f"WITH {CAT} SELECT entry_no, title FROM cat WHERE NOT archived AND {_LIKE}")
def keyword_search(spark, d):
    rows = catalog(spark, d).filter("not archived")
    return rows.filter(search.keyword_filter("Soft  garden", search.text_fields(rows, _FIELDS))).select("entry_no", "title")


@query(f"""WITH {CAT}, k AS (SELECT entry_no, epoch_us(created_time) created FROM cat WHERE NOT archived AND {_LIKE}), c AS (SELECT created, entry_no FROM k ORDER BY created DESC, entry_no DESC LIMIT 1 OFFSET 23)
SELECT row_number() OVER (ORDER BY k.created DESC, k.entry_no DESC)::BIGINT AS rank, k.entry_no FROM k, c WHERE k.created < c.created OR (k.created = c.created AND k.entry_no < c.entry_no) ORDER BY k.created DESC, k.entry_no DESC LIMIT 24""")
def keyword_page(spark, d):
    """The second page of the keyword search, from where the first ended."""
    rows = catalog(spark, d).filter("not archived")
    rows = rows.filter(search.keyword_filter("soft garden", search.text_fields(rows, _FIELDS))).select("entry_no", micros(F.col("created_time")).alias("created"))
    order = [F.desc("created"), F.desc("entry_no")]
    last = search.page(rows, order, 23, 1, None).first()
    rows = rows.filter(search.after("created", "entry_no", (last["created"], last["entry_no"]))) if last else rows.limit(0)
    return search.page(rows, order, 0, cap=None).select("rank", "entry_no")


# ------------------------------------------------ overlay

_OVER = f"{CAT}, over AS (SELECT entry_no, 'edited ' || coalesce(title, '') title FROM cat WHERE entry_no % 10 = 0), gone AS (SELECT entry_no FROM cat WHERE entry_no % 17 = 0)"


def _parts(spark, d):
    base = catalog(spark, d).select("entry_no", "title")
    edited = base.filter("entry_no % 10 = 0").withColumn("title", F.concat(F.lit("edited "), text(F.col("title"))))
    return base, edited, base.filter("entry_no % 17 = 0").select("entry_no")


_MERGED = f"""WITH {_OVER} SELECT entry_no, title, false AS is_overlay FROM cat WHERE entry_no NOT IN (SELECT entry_no FROM over) AND entry_no NOT IN (SELECT entry_no FROM gone)
UNION ALL SELECT entry_no, title, true FROM over"""


@query(_MERGED)
def overlay_merge(spark, d):
    return overlay.merge(*_parts(spark, d), "entry_no").select("entry_no", "title", "is_overlay")


@query(f"SELECT entry_no, title FROM ({_MERGED})")
def compact(spark, d):
    """What the periodic rebuild writes: base, overlay and deletes as one table."""
    return overlay.merge(*_parts(spark, d), "entry_no").select("entry_no", "title")


@query(f"WITH {_OVER} SELECT entry_no, entry_no % 10 = 0 OR entry_no % 17 <> 0 AS searchable FROM cat")
def is_searchable(spark, d):
    base, edited, gone = _parts(spark, d)
    return overlay.state(base.select("entry_no"), base, edited, gone, "entry_no")


@query(f"WITH {_OVER} SELECT entry_no, CASE WHEN entry_no % 10 = 0 OR entry_no % 17 <> 0 THEN 'ready' ELSE 'processing' END AS status FROM cat")
def status_flag(spark, d):
    base, edited, gone = _parts(spark, d)
    return overlay.state(base.select("entry_no"), base, edited, gone, "entry_no").select("entry_no", F.when(F.col("searchable"), "ready").otherwise("processing").alias("status"))


@query(f"WITH {CAT}, {VEC} SELECT cat.entry_no, CASE WHEN v.entry_no IS NULL THEN 'processing' ELSE 'ready' END AS status FROM cat LEFT JOIN (SELECT DISTINCT entry_no FROM vec) v USING (entry_no)")
def ingest_status(spark, d):
    have = vectors(spark, d).select("entry_no").distinct().withColumn("has", F.lit(True))
    return catalog(spark, d).select("entry_no").join(have, "entry_no", "left").select("entry_no", F.when(F.col("has"), "ready").otherwise("processing").alias("status"))


@query("""WITH h AS (SELECT DISTINCT * FROM similar_hits WHERE asset_id IS NOT NULL)
SELECT asset_id, arg_max(coalesce(id, '-'), hit_id) AS last_id, coalesce(arg_max(distance, hit_id) FILTER (WHERE distance IS NOT NULL), -9) AS kept_distance, arg_min(coalesce(id, '-'), hit_id) AS first_id FROM h GROUP BY asset_id""")
def overlay_fold(spark, d):
    """Updates folded by key: last value, last present value, first value."""
    h = load(spark, d, "similar_hits").filter("asset_id is not null").dropDuplicates(["hit_id"])
    h = h.select("asset_id", "hit_id", F.coalesce("id", F.lit("-")).alias("last_id"), F.col("distance").alias("kept_distance"), F.coalesce("id", F.lit("-")).alias("first_id"))
    return overlay.fold(h, "asset_id", "hit_id", ["last_id"], ["kept_distance"], ["first_id"]).fillna(-9, ["kept_distance"])


@query(f"WITH {CAT} SELECT entry_no, title FROM cat WHERE NOT archived")
def active_rows(spark, d):
    return catalog(spark, d).filter("not archived").select("entry_no", "title")


@query(f"WITH {CAT} SELECT entry_no, archived OR entry_no % 17 = 0 AS archived FROM cat")
def soft_delete(spark, d):
    """Deleted rows are marked, not removed."""
    return catalog(spark, d).select("entry_no", (F.col("archived") | (F.col("entry_no") % 17 == 0)).alias("archived"))


@query(f"WITH {CAT} SELECT id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(description, '') AS description, media_type, coalesce(drive_link, '') AS drive_link FROM cat")
def asset_projection(spark, d):
    return catalog(spark, d).select("id", *(text(F.col(c)).alias(c) for c in ("title", "url", "description")), "media_type", text(F.col("drive_link")).alias("drive_link"))


@query(f"WITH {CAT} SELECT entry_no, coalesce(nullif(url, ''), nullif(drive_link, ''), '') AS href FROM cat")
def open_href(spark, d):
    return catalog(spark, d).select("entry_no", F.coalesce(filled(F.col("url")), filled(F.col("drive_link")), F.lit("")).alias("href"))


@query("""WITH r AS (SELECT DISTINCT vec_id, index_no, vectors FROM index_vectors)
SELECT m.index_no, count(r.vec_id) FILTER (WHERE ok) AS usable, count(r.vec_id) FILTER (WHERE NOT ok) AS rejected FROM index_meta m LEFT JOIN
 (SELECT r.*, coalesce(len(vectors) = dimensions AND len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0, false) ok FROM r JOIN index_meta USING (index_no)) r
 USING (index_no) GROUP BY m.index_no""")
def load_index(spark, d):
    """Usable and rejected vectors of each index by its dimensions."""
    from trellis.functions.vectors import usable

    meta = load(spark, d, "index_meta").select("index_no", "dimensions").dropDuplicates(["index_no"])
    rows = load(spark, d, "index_vectors").select("vec_id", "index_no", "vectors").dropDuplicates(["vec_id"])
    ok = usable(F.col("vectors"), F.col("dimensions"))
    return meta.join(rows, "index_no", "left").groupBy("index_no").agg(F.count(F.when(ok, F.col("vec_id"))).alias("usable"), F.count(F.when(~ok, F.col("vec_id"))).alias("rejected"))


@query(f"WITH {CAT} SELECT entry_no, array_to_string({NAMES.format('people')}, '|') AS names FROM cat")
def parse_people_names(spark, d):
    return catalog(spark, d).select("entry_no", F.array_join(people_names(F.col("people")), "|").alias("names"))
