"""Scans, index build, collections, jobs and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.fixtures import CAT, JOBS, NAMES, SPLIT, VEC, catalog, curated, job_updates, micros, vectors
from trellis.functions.parse import people_names, split_list
from trellis.functions.text import bare, filled, text
from trellis.functions.vectors import from_blob, to_blob
from trellis.operators import collections, dedup, frames, queue
from trellis.plans import ranges
from trellis.queries.registry import query
from trellis.runtime import load

# ------------------------------------------------ scans


@query(f"WITH {CAT} SELECT entry_no, id, coalesce(title, '') AS title, epoch_us(created_time) AS created FROM cat")
def scan_catalog(spark, d):
    return catalog(spark, d).select("entry_no", "id", text(F.col("title")).alias("title"), micros(F.col("created_time")).alias("created"))


@query("SELECT epoch_us(min(created_time)) AS oldest, epoch_us(max(created_time)) AS newest FROM manifest_entries")
def created_bounds(spark, d):
    t = load(spark, d, "manifest_entries").agg(F.min("created_time").alias("lo"), F.max("created_time").alias("hi"))
    return t.select(micros(F.col("lo")).alias("oldest"), micros(F.col("hi")).alias("newest"))


@query(f"WITH {CAT} SELECT entry_no FROM cat WHERE created_time >= TIMESTAMP '2024-03-01' AND created_time < TIMESTAMP '2024-04-01'")
def range_scan(spark, d):
    """A half-open range of time; the filter reaches the Parquet scan."""
    t = load(spark, d, "manifest_entries").filter("created_time >= timestamp_ntz '2024-03-01' and created_time < timestamp_ntz '2024-04-01'")
    return t.select("entry_no").distinct()


@query(f"WITH {CAT} SELECT epoch_us(date_trunc('month', created_time)::TIMESTAMP) AS since, epoch_us(date_trunc('month', created_time)::TIMESTAMP + INTERVAL 1 MONTH) AS until, count(*) AS n FROM cat WHERE created_time IS NOT NULL GROUP BY ALL")
def month_shards(spark, d):
    """Rows of each month between the first and the last; months without a row don't show."""
    c = catalog(spark, d).select("created_time")
    month = F.date_trunc("month", "created_time").alias("since")
    n = c.groupBy(month).agg(F.count("*").alias("n"))
    return ranges.months(c, "created_time").join(n, "since").select(micros(F.col("since")).alias("since"), micros(F.col("until")).alias("until"), "n")


@query(f"""WITH {CAT}, b AS (SELECT min(epoch_us(created_time)) lo, max(epoch_us(created_time)) hi FROM cat),
f AS (SELECT floor((epoch_us(created_time) - lo)::DOUBLE / greatest(hi - lo + 1, 1) * 4096)::BIGINT f FROM cat, b),
cells AS (SELECT level, (f >> (12 - level)::INT) AS cell, count(*) n FROM f, range(0, 13) r(level) GROUP BY ALL)
SELECT c.level, c.cell, c.n FROM cells c LEFT JOIN cells u ON u.level = c.level - 1 AND u.cell = (c.cell >> 1) WHERE (c.n <= 500 OR c.level = 12) AND (u.n IS NULL OR u.n > 500)""")
def adaptive_shards(spark, d):
    rows = catalog(spark, d).select(micros(F.col("created_time")).alias("at"))
    return ranges.bisected(rows, "at", 500).select(F.col("level").cast("bigint").alias("level"), "cell", "n")


@query(f"WITH {CAT} SELECT entry_no, title FROM cat WHERE replace(id, '-', '') = (SELECT replace(min(id), '-', '') FROM cat WHERE NOT archived) AND NOT archived")
def point_lookup(spark, d):
    """An entry by its id, dashes or not, unless it is archived."""
    c = curated(spark, d, "manifest_entries", "entry_no").filter("not archived")
    wanted = c.agg(F.min("id")).first()[0]
    plain = (wanted or "").strip().lower().replace("-", "")
    return c.filter(F.col("plain_id") == plain).select("entry_no", "title")


@query(f"WITH {CAT}, r AS (SELECT entry_no, archived FROM cat ORDER BY created_time DESC, entry_no LIMIT 100) SELECT entry_no FROM r WHERE NOT archived")
def recent_entries(spark, d):
    """The latest hundred, then without the archived ones of them."""
    return catalog(spark, d).select("entry_no", "archived", "created_time").orderBy(F.desc("created_time"), "entry_no").limit(100).filter("not archived").select("entry_no")


@query(f"WITH {VEC} SELECT id, len(v)::BIGINT AS dims, round(list_sum(v), 3) AS total FROM vec")
def decode_vectors(spark, d):
    """Vectors written as raw float32 and read back."""
    back = from_blob(to_blob(vectors(spark, d), "id", "v"), 96)
    return back.select(F.col("key").alias("id"), F.size("vector").cast("bigint").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


# ------------------------------------------------ index build

_LINES = [("Context", "context"), ("People", None), ("Product", "product"), ("Location", "location"), ("Shoot", "shoot"), ("Source", "source"), ("Tags", None), ("Description", "description")]
_DOC = "concat_ws(chr(10), coalesce(nullif(title, ''), 'Untitled'), " + ", ".join(
    f"'{k}: ' || nullif({c}, '')" if c else f"'{k}: ' || nullif(array_to_string({(NAMES if k == 'People' else SPLIT).format(k.lower())}, ', '), '')" for k, c in _LINES) + ")"


def document(with_analysis: bool = False):
    """The text that is embedded: labelled lines, empty ones left out."""
    lists = {"People": people_names(F.col("people")), "Tags": split_list(F.col("tags"))}
    line = lambda k, c: F.concat(F.lit(k + ": "), filled(F.array_join(lists[k], ", ") if c is None else text(F.col(c))))
    lines = [line(k, c) for k, c in (_LINES[:-1] if with_analysis else _LINES)]
    if with_analysis:
        lines += [F.concat(F.lit(k + ": "), filled(text(F.col(c)))) for k, c in (("Description", "description"), ("Tags", "a_tags"), ("Products", "a_products"), ("Content type", "content_type"), ("Mood", "a_mood"), ("Setting", "setting_location"), ("People", "people_present"), ("Usable for", "a_usable"))]
    return F.concat_ws("\n", F.coalesce(filled(F.col("title")), F.lit("Untitled")), *lines)


@query(f"WITH {CAT} SELECT entry_no, {_DOC} AS text FROM cat")
def embedding_text(spark, d):
    return catalog(spark, d).select("entry_no", document().alias("text"))


_FULL = "concat_ws(chr(10), coalesce(nullif(title, ''), 'Untitled'), " + ", ".join(
    f"'{k}: ' || nullif({c}, '')" if c else f"'{k}: ' || nullif(array_to_string({(NAMES if k == 'People' else SPLIT).format(k.lower())}, ', '), '')" for k, c in _LINES[:-1]) + (
    ", 'Description: ' || nullif(description, ''), 'Tags: ' || nullif(a_tags, ''), 'Products: ' || nullif(a_products, ''), 'Content type: ' || nullif(content_type, ''), 'Mood: ' || nullif(a_mood, ''), "
    "'Setting: ' || nullif(setting_location, ''), 'People: ' || nullif(people_present, ''), 'Usable for: ' || nullif(a_usable, ''))")  # fmt: skip


@query(f"""WITH {CAT}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_no ORDER BY manifest_id DESC) rn FROM (SELECT DISTINCT * FROM asset_manifests)) WHERE rn = 1),
j AS (SELECT cat.*, content_type, setting_location, people_present, array_to_string(visual_tags, ', ') a_tags, array_to_string(products_or_flowers, ', ') a_products, array_to_string(mood_tone, ', ') a_mood, array_to_string(usable_for, ', ') a_usable FROM cat LEFT JOIN m USING (entry_no))
SELECT entry_no, {_FULL} AS text FROM j""")
def embedding_text_full(spark, d):
    """With the latest analysis of each entry."""
    m = load(spark, d, "asset_manifests").dropDuplicates(["manifest_id"])
    joined = [F.array_join(c, ", ").alias(a) for c, a in (("visual_tags", "a_tags"), ("products_or_flowers", "a_products"), ("mood_tone", "a_mood"), ("usable_for", "a_usable"))]
    m = m.select("entry_no", "manifest_id", "content_type", "setting_location", "people_present", *joined)
    last = m.groupBy("entry_no").agg(F.max_by(F.struct(*m.columns[2:]), "manifest_id").alias("m")).select("entry_no", "m.*")
    return catalog(spark, d).join(last, "entry_no", "left").select("entry_no", document(True).alias("text"))


@query(f"WITH {CAT} SELECT entry_no, id, coalesce(nullif(title, ''), 'Untitled') AS title, array_to_string({NAMES.format('people')}, ', ') AS people, array_to_string({SPLIT.format('tags')}, ', ') AS tags, length({_DOC})::BIGINT AS text_length FROM cat WHERE NOT archived")
def index_record(spark, d):
    c = catalog(spark, d).filter("not archived")
    return c.select("entry_no", "id", F.coalesce(filled(F.col("title")), F.lit("Untitled")).alias("title"), F.array_join(people_names(F.col("people")), ", ").alias("people"), F.array_join(split_list(F.col("tags")), ", ").alias("tags"), F.length(document()).cast("bigint").alias("text_length"))


_BEST = f"""{CAT}, act AS (SELECT * FROM cat WHERE NOT archived), s AS (SELECT *, 100 * (coalesce(url, '') <> '')::INT + 10 * (coalesce(drive_link, '') <> '')::INT + 5 * (coalesce(description, '') <> '')::INT + coalesce(epoch_ms(coalesce(last_edited_time, created_time)), 0) / 1e13 score FROM act),
best AS (SELECT * EXCLUDE (rn, score) FROM (SELECT *, row_number() OVER (PARTITION BY drive_link ORDER BY score DESC, entry_no) rn FROM s) WHERE rn = 1 OR coalesce(drive_link, '') = '')"""


def _built(spark, d):
    edited = F.coalesce("last_edited_time", "created_time").cast("timestamp")
    c = catalog(spark, d).filter("not archived")
    c = c.withColumn("score", dedup.record_score(F.col("url"), F.col("drive_link"), F.col("description"), edited))
    c = c.select("entry_no", "id", "title", "drive_link", "product", "location", "score")
    return dedup.best_of(c, "drive_link", F.col("score"), "entry_no")


@query(f"WITH {_BEST} SELECT entry_no, id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(product, ''), '-') AS product, coalesce(nullif(location, ''), '-') AS location FROM best")
def build_index(spark, d):
    """The index table's metadata: active rows, the best of each file."""
    b = _built(spark, d)
    return b.select("entry_no", "id", F.coalesce(filled(F.col("title")), F.lit("Untitled")).alias("title"), *(F.coalesce(filled(F.col(c)), F.lit("-")).alias(c) for c in ("product", "location")))


@query(f"WITH {_BEST} SELECT (SELECT count(*) FROM cat) AS fetched, (SELECT count(*) FROM act) AS active, (SELECT count(*) FROM best) AS kept")
def build_stats(spark, d):
    c = catalog(spark, d).agg(F.count("*").alias("fetched"), F.count_if(~F.col("archived")).alias("active"))
    return c.join(_built(spark, d).agg(F.count("*").alias("kept")))


@query(f"WITH {CAT}, n AS (SELECT entry_no, ((entry_no - 1) // 64)::BIGINT batch FROM cat WHERE NOT archived) SELECT batch, count(*) AS texts, min(entry_no) AS first FROM n GROUP BY batch")
def embed_batches(spark, d):
    """Texts in batches of 64 by number; a batch is a key, so no row has to be counted before another."""
    c = catalog(spark, d).filter("not archived").select("entry_no", F.floor((F.col("entry_no") - 1) / 64).cast("bigint").alias("batch"))
    return c.groupBy("batch").agg(F.count("*").alias("texts"), F.min("entry_no").alias("first"))


@query(f"WITH {CAT} SELECT entry_no, coalesce(length(nullif(title, '')), -1)::BIGINT AS letters, CASE WHEN coalesce(title, '') = '' THEN -1 ELSE length(title) - length(replace(title, ' ', '')) + 1 END::BIGINT AS words FROM cat WHERE NOT archived")
def embed_titles(spark, d):
    """Vectors from a provider that answers each batch out of order, put back to their texts."""
    from trellis.providers.base import embed
    from trellis.providers.stub import LengthEmbedder

    v = embed(catalog(spark, d).filter("not archived"), "entry_no", "title", LengthEmbedder())
    part = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(-1)).cast("bigint")
    return v.select("entry_no", part(0).alias("letters"), part(1).alias("words"))


# ------------------------------------------------ collections: a shoot is one


def _members(spark, d):
    return catalog(spark, d).filter("shoot is not null and shoot <> ''").select("shoot", "entry_no")


@query(f"WITH {CAT} SELECT shoot, least(count(*), 25) AS items, count(*) > 25 AS partial FROM cat WHERE shoot <> '' GROUP BY shoot")
def collection_summary(spark, d):
    """A tenth of all rows are one collection; it is counted, not gathered."""
    return collections.summaries(_members(spark, d), "shoot")


@query(f"WITH {CAT} SELECT shoot, entry_no, title FROM cat WHERE shoot <> '' AND NOT archived")
def collection_items(spark, d):
    e = catalog(spark, d).filter("not archived").select("entry_no", "title")
    return collections.items(_members(spark, d), e, "entry_no").select("shoot", "entry_no", "title")


@query(f"WITH {CAT} SELECT shoot, least(count(*), 25) AS items FROM cat WHERE shoot <> '' AND contains(lower(shoot), 'sh00-0001') GROUP BY shoot")
def collection_filter(spark, d):
    return collections.search(collections.summaries(_members(spark, d), "shoot"), "shoot", "  SH00-0001 ").select("shoot", "items")


@query(f"WITH {CAT} SELECT entry_no, coalesce(nullif(trim(coalesce(location, '')), ''), 'Untitled collection') AS name FROM cat")
def collection_create(spark, d):
    c = catalog(spark, d).select("entry_no", F.col("location").alias("name"))
    return collections.named(c, "name")


# ------------------------------------------------ jobs

_LATEST = f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_ DESC, seq DESC) rn, min(at_) OVER (PARTITION BY job_id) created_at FROM u), l AS (SELECT job_id, status, progress, at_ AS updated_at, created_at FROM r WHERE rn = 1), now_ AS (SELECT max(at_) n FROM u)"


def _jobs(spark, d):
    u = job_updates(spark, d)
    return u, queue.latest(u, "job_id", "at", "seq").withColumnRenamed("at", "updated_at")


@query(f"{_LATEST} SELECT job_id, status, progress, updated_at, created_at FROM l")
def job_latest(spark, d):
    return _jobs(spark, d)[1].select("job_id", "status", "progress", "updated_at", "created_at")


@query(f"""WITH {JOBS}, p AS (SELECT job_id, at_, seq, CASE WHEN seq % 3 <> 0 THEN status END status, CASE WHEN seq % 2 = 0 THEN progress END progress FROM u)
SELECT job_id, arg_max(status, (at_, seq)) FILTER (WHERE status IS NOT NULL) AS status, arg_max(progress, (at_, seq)) FILTER (WHERE progress IS NOT NULL) AS progress, min(at_) AS created_at, max(at_) AS updated_at FROM p GROUP BY job_id""")
def job_merged(spark, d):
    """Updates that give some fields only, merged into each job's record."""
    u = job_updates(spark, d)
    patches = u.select("job_id", "at", "seq", F.when(F.col("seq") % 3 != 0, F.col("status")).alias("status"), F.when(F.col("seq") % 2 == 0, F.col("progress")).alias("progress"))
    return queue.merged(patches, "job_id", "at", "seq", ["status", "progress"])


@query(f"{_LATEST} SELECT row_number() OVER (ORDER BY created_at, job_id)::BIGINT AS rank, job_id FROM l, now_ WHERE status = 'queued' OR (status = 'processing' AND n - updated_at > 1800000) ORDER BY created_at, job_id LIMIT 20")
def claim_next(spark, d):
    """The oldest jobs that may be taken up; the clock is the log's last time."""
    u, jobs = _jobs(spark, d)
    now = u.agg(F.max("at")).first()[0] or 0
    from trellis.operators.search import page

    return page(queue.claimable(jobs, now).select("job_id", "created_at"), ["created_at", "job_id"], 0, 20, None).select("rank", "job_id")


@query(f"{_LATEST} SELECT job_id FROM l, now_ WHERE status IN ('done', 'error') AND n - updated_at > 7200000")
def ttl_sweep(spark, d):
    u, jobs = _jobs(spark, d)
    return queue.expired(jobs, u.agg(F.max("at")).first()[0] or 0).select("job_id")


@query(f"""WITH {JOBS}, c AS (SELECT *, CASE WHEN lag(status) OVER w IS DISTINCT FROM status OR lag(job_id) OVER w IS NULL THEN 1 ELSE 0 END ch FROM u WINDOW w AS (PARTITION BY job_id ORDER BY at_, seq)),
s AS (SELECT *, sum(ch) OVER (PARTITION BY job_id ORDER BY at_, seq ROWS UNBOUNDED PRECEDING) sp FROM c)
SELECT job_id, min(at_) AS since, max(at_) AS until FROM s GROUP BY job_id, sp HAVING max(at_) - min(at_) > 240000""")
def stalled_jobs(spark, d):
    return queue.stalls(job_updates(spark, d), "job_id", "at", "seq", ["status"]).select("job_id", "since", "until")


@query("SELECT event_id, user_id AS job_id, floor(value)::BIGINT AS processed FROM events WHERE event_id % 50 <> 0")
def job_scan(spark, d):
    """Job records as JSON, malformed ones dropped."""
    e = load(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id"), F.col("user_id").alias("job_id"), F.floor("value").alias("processed")))
    record = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), F.substring(body, 3, 9))).otherwise(body)
    got = F.from_json(record, "event_id bigint, job_id bigint, processed bigint", {"mode": "PERMISSIVE"})
    return e.select(got.alias("r")).filter("r.job_id is not null").select("r.*")


# ------------------------------------------------ frames: embeddings of a label are a video's frames


def _frames(spark, d):
    from trellis.functions.bits import hash_bits, threshold_bits

    e = load(spark, d, "embeddings")
    score = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") * 37 % 101) / 10.0)
    fp = hash_bits(threshold_bits(F.col("embedding").cast("array<double>")))
    # a video is a few dozen frames of a label
    return e.select((F.floor(F.col("vec_id") / 50) * 10 + F.col("label")).cast("bigint").alias("video"), "vec_id", fp.alias("fp"), F.abs(F.col("embedding")[0]).cast("double").alias("sharpness"), score.alias("overall"))


@query()
def frame_stats(spark, d):
    """Sharpness and entropy of grey 8 x 8 images made from embeddings."""
    from trellis.functions.image import entropy, sharpness

    pixels = F.transform("embedding", lambda x: x.cast("double") * 128 + 128)
    e = load(spark, d, "embeddings").select("vec_id", pixels.alias("p"))
    return e.select("vec_id", F.round(sharpness("p"), 3).alias("sharpness"), F.round(entropy("p"), 3).alias("entropy"))


@query()
def scene_cluster(spark, d):
    return frames.scenes(_frames(spark, d), "video", "vec_id", "fp", 24).select("video", "vec_id", "scene")


@query("""WITH f AS (SELECT (vec_id // 50) * 10 + label video, vec_id, abs(embedding[1])::DOUBLE sharpness, CASE WHEN vec_id % 7 <> 0 THEN (vec_id * 37 % 101) / 10.0 END overall FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY sharpness DESC, vec_id) k FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY coalesce(overall, -1) DESC, k) b FROM r WHERE k <= 3)
SELECT video, vec_id FROM b WHERE b = 1 AND (overall IS NULL OR overall >= 3)""")
def best_frame(spark, d):
    return frames.best_frames(_frames(spark, d), ["video"], "sharpness", "overall", "vec_id").select("video", "vec_id")


@query("""WITH f AS (SELECT vec_id // 100 video, vec_id, abs(embedding[1])::DOUBLE sharpness, CASE WHEN vec_id % 7 <> 0 THEN (vec_id * 37 % 101) / 10.0 END overall FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY coalesce(overall, sharpness) DESC, vec_id) k FROM f)
SELECT video, vec_id, row_number() OVER (PARTITION BY video ORDER BY vec_id)::BIGINT AS place FROM r WHERE k <= 12""")
def top_scenes(spark, d):
    f = _frames(spark, d).withColumn("video", F.floor(F.col("vec_id") / 100).cast("bigint"))
    return frames.top_scenes(f, "video", "overall", "sharpness", "vec_id").select("video", "vec_id", F.col("place").cast("bigint").alias("place"))


@query()
def select_frames(spark, d):
    """Scenes, the best frame of each, the best scenes of each video."""
    f = frames.scenes(_frames(spark, d), "video", "vec_id", "fp", 24)
    best = frames.best_frames(f, ["video", "scene"], "sharpness", "overall", "vec_id")
    return frames.top_scenes(best, "video", "overall", "sharpness", "vec_id").select("video", "scene", "vec_id", "place")


@query("""WITH e AS (SELECT event_id, greatest(0, value - 0.3) safe, least(8, greatest(3, floor(value / 3)::INT + 1)) n, value v FROM events),
a AS (SELECT event_id, list_sort(list_filter(list_concat([0.2::DOUBLE, v / 3, v / 2, v / 2 + 0.1], list_transform(range(n), lambda i: (i + 0.5::DOUBLE) * safe / n)), lambda t: t >= 0 AND t <= safe)) ts FROM e),
k AS (SELECT event_id, CASE WHEN len(ts) = 0 THEN []::DOUBLE[] ELSE list_reduce(list_transform(ts, lambda t: [t]), lambda acc, x: CASE WHEN x[1] - acc[-1] > 0.4::DOUBLE THEN list_append(acc, round(x[1], 2)) ELSE acc END, [round(ts[1], 2)]) END kept FROM a)
SELECT event_id, len(kept)::INT AS frames, array_to_string(list_transform(kept, lambda t: t::VARCHAR), ' ') AS times FROM k""")
def frame_plan(spark, d):
    e = load(spark, d, "events")
    cuts = F.array(F.col("value") / 3, F.col("value") / 2, F.col("value") / 2 + 0.1)
    times = frames.plan(F.col("value"), cuts)
    return e.select("event_id", F.size(times).alias("frames"), F.array_join(F.transform(times, lambda t: t.cast("string")), " ").alias("times"))
