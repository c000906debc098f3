"""Ingest: content keys, exact and near duplicates, parsing, coercion and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.fixtures import CAT, NAMES, SPLIT, catalog, curated, micros
from trellis.functions import bits, media, merge, parse
from trellis.functions import text as tx
from trellis.functions.text import bare, filled, text
from trellis.operators import dedup, neardup
from trellis.queries.registry import query
from trellis.runtime import Workspace, load

_HEX = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
UP = "up AS (SELECT DISTINCT * FROM upload_queue)"
SHA = "CASE WHEN regexp_full_match(" + _HEX.format("sha256") + ", '[0-9a-f]{64}') THEN " + _HEX.format("sha256") + " END"
FP = "CASE WHEN regexp_full_match(" + _HEX.format("phash") + ", '[0-9a-f]{16}') THEN ('0x' || " + _HEX.format("phash") + ")::UBIGINT END"


def _sha(c):
    x = F.lower(bare(c))
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def uploads(spark, d):
    """(upload_id, seq, filename, source, uploaded_by, sha, fp): each upload once, in order of arrival."""
    u = curated(spark, d, "upload_queue", "upload_id")
    seq = F.shiftleft(F.col("batch_no").cast("bigint"), 44) + F.col("upload_id")
    return u.select("upload_id", seq.alias("seq"), "filename", "source", "uploaded_by", _sha(F.col("sha256")).alias("sha"), bits.hash_bits(F.col("phash")).alias("fp"))


def entries(spark, d):
    return catalog(spark, d).select("entry_no", _sha(F.col("sha256")).alias("sha"), bits.hash_bits(F.col("phash")).alias("fp"))


@query(f"WITH {CAT} SELECT entry_no, sha256(coalesce(title, '')) AS sha FROM cat")
def sha256_key(spark, d):
    return catalog(spark, d).select("entry_no", F.sha2(text(F.col("title")), 256).alias("sha"))


@query(f"WITH {CAT}, {UP}, c AS (SELECT {SHA} sha, min(entry_no) entry_no FROM cat GROUP BY 1) SELECT upload_id, c.entry_no FROM (SELECT upload_id, {SHA} sha FROM up) u JOIN c USING (sha)")
def exact_dup_lookup(spark, d):
    """The first entry with each upload's content hash."""
    first = entries(spark, d).filter("sha is not null").groupBy("sha").agg(F.min("entry_no").alias("entry_no"))
    return uploads(spark, d).select("upload_id", "sha").join(first, "sha").select("upload_id", "entry_no")


@query(f"""WITH {CAT}, {UP}, u AS (SELECT upload_id, batch_no, {SHA} sha FROM up), h AS (SELECT DISTINCT {SHA} sha FROM cat)
SELECT upload_id, CASE WHEN sha IN (SELECT sha FROM h WHERE sha IS NOT NULL) THEN 'known' WHEN sha IS NOT NULL AND row_number() OVER (PARTITION BY sha ORDER BY batch_no, upload_id) > 1 THEN 'repeat' ELSE 'first' END AS fate FROM u""")
def exact_dup_split(spark, d):
    return dedup.split_known(uploads(spark, d), entries(spark, d).filter("sha is not null"), "sha", "seq").select("upload_id", "fate")


@query(f"WITH h AS (SELECT DISTINCT {FP} fp FROM manifest_entries) SELECT hex(a.fp) AS a, hex(b.fp) AS b, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM h a JOIN h b ON hex(a.fp) < hex(b.fp) AND bit_count(xor(a.fp, b.fp)) <= 6")
def near_dup_pairs(spark, d):
    """Pairs of different hashes of the catalogue at most 6 bits apart."""
    h = entries(spark, d).select("fp")
    hexed = lambda c: F.regexp_replace(F.hex(c), "^0+(?=.)", "")
    pairs = neardup.near_hashes(h, h, 6).select(hexed(F.col("fp")).alias("a"), hexed(F.col("other")).alias("b"), F.col("distance").cast("bigint").alias("distance"))
    return pairs.filter("a < b")


@query(f"""WITH {CAT}, {UP}, c AS (SELECT entry_no, {FP} fp FROM cat), u AS (SELECT upload_id, {FP} fp FROM up),
p AS (SELECT upload_id, entry_no, bit_count(xor(u.fp, c.fp))::BIGINT AS distance FROM u JOIN c ON bit_count(xor(u.fp, c.fp)) <= 6)
SELECT upload_id, entry_no, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY distance, entry_no)::BIGINT AS rank FROM p) WHERE rank <= 5""")
def near_dup_topk(spark, d):
    near = neardup.top_near(uploads(spark, d), entries(spark, d), "upload_id", "entry_no", 6, 5)
    return near.select("upload_id", "entry_no", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


_HITS = "h AS (SELECT DISTINCT * FROM similar_hits)"
_PAIRS = f"WITH {_HITS}, {CAT}, c AS (SELECT id, max(phash) phash FROM cat GROUP BY id) SELECT hit_id, a.phash pa, b.phash pb FROM h JOIN c a ON a.id = h.asset_id JOIN c b ON b.id = h.id"


def _hit_hashes(spark, d):
    c = catalog(spark, d).select("id", "phash")
    h = load(spark, d, "similar_hits").dropDuplicates(["hit_id"]).select("hit_id", "asset_id", F.col("id").alias("other"))
    one, two = (c.select(F.col("id").alias(k), F.col("phash").alias(p)) for k, p in (("asset_id", "pa"), ("other", "pb")))
    return h.join(one, "asset_id").join(two, "other")


def _fp(c):
    return FP.replace("phash", c)


@query(f"SELECT hit_id, bit_count(xor({_fp('pa')}, {_fp('pb')}))::BIGINT AS distance FROM ({_PAIRS}) WHERE {_fp('pa')} IS NOT NULL AND {_fp('pb')} IS NOT NULL")
def hamming(spark, d):
    """The distance of each reported hit as the hashes are now."""
    rows = _hit_hashes(spark, d).select("hit_id", bits.hamming(bits.hash_bits(F.col("pa")), bits.hash_bits(F.col("pb"))).cast("bigint").alias("distance"))
    return rows.filter("distance is not null")


@query(f"SELECT hit_id, coalesce(bit_count(xor({_fp('pa')}, {_fp('pb')})) <= 6, false) AS similar FROM ({_PAIRS})")
def is_similar(spark, d):
    return _hit_hashes(spark, d).select("hit_id", bits.is_similar(F.col("pa"), F.col("pb"), 6).alias("similar"))


_BITS = "list_transform(range(1, 65), lambda i: CASE WHEN v[i] > list_sort(v[2:64])[32] THEN 1 ELSE 0 END)"


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings) SELECT vec_id, lower(array_to_string(list_transform(range(0, 16), lambda k: format('{:x}', 8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4])), '')) AS phash FROM (SELECT vec_id, " + _BITS + " b FROM e)")
def phash_threshold(spark, d):
    """64-dimensional embeddings taken as blocks of coefficients."""
    return load(spark, d, "embeddings").select("vec_id", bits.threshold_bits(F.col("embedding").cast("array<double>")).alias("phash"))


@query()
def phash_dct(spark, d):
    """The hash of grey images made from embeddings, through the cosine transform."""
    image = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.get(F.col("embedding"), ((i * 37) % 64).cast("int")).cast("double") * 128 + 128)
    low = load(spark, d, "embeddings").select("vec_id", bits.dct_low(image).alias("low"))
    return low.select("vec_id", bits.threshold_bits(F.col("low")).alias("phash"))


@query(f"""WITH {CAT}, s AS (SELECT *, 100 * (coalesce(url, '') <> '')::INT + 10 * (coalesce(drive_link, '') <> '')::INT + 5 * (coalesce(description, '') <> '')::INT + coalesce(epoch_ms(coalesce(last_edited_time, created_time)), 0) / 1e13 score FROM cat)
SELECT entry_no, round(score, 6) AS score FROM s""")
def record_score(spark, d):
    c = catalog(spark, d)
    edited = F.coalesce("last_edited_time", "created_time").cast("timestamp")
    return c.select("entry_no", F.round(dedup.record_score(F.col("url"), F.col("drive_link"), F.col("description"), edited), 6).alias("score"))


@query(f"""WITH {CAT}, s AS (SELECT entry_no, shoot, 100 * (coalesce(url, '') <> '')::INT + 10 * (coalesce(drive_link, '') <> '')::INT + 5 * (coalesce(description, '') <> '')::INT + coalesce(epoch_ms(coalesce(last_edited_time, created_time)), 0) / 1e13 score FROM cat)
SELECT entry_no, shoot FROM (SELECT *, row_number() OVER (PARTITION BY shoot ORDER BY score DESC, entry_no) rn FROM s) WHERE rn = 1 OR coalesce(shoot, '') = ''""")
def dedupe_argmax(spark, d):
    """The best row of each shoot; a tenth of all rows are one shoot."""
    edited = F.coalesce("last_edited_time", "created_time").cast("timestamp")
    rows = catalog(spark, d).select("entry_no", "shoot", dedup.record_score(F.col("url"), F.col("drive_link"), F.col("description"), edited).alias("score"))
    return dedup.best_of(rows, "shoot", F.col("score"), "entry_no").select("entry_no", "shoot")


# ------------------------------------------------ files and slugs


@query(f"WITH {UP} SELECT upload_id, CASE WHEN x IN ('jpg','jpeg','png','webp','gif','avif','heic','tiff','bmp') THEN 'image' WHEN x IN ('mp4','mov','webm','m4v','avi','mkv','gifv') THEN 'video' ELSE 'other' END AS kind FROM (SELECT upload_id, regexp_extract(lower(filename), '\\.([a-z0-9]+)\\s*$', 1) x FROM up)")
def media_type(spark, d):
    u = uploads(spark, d)
    return u.select("upload_id", media.media_type(F.col("filename"), F.lit(""), F.lit("")).alias("kind"))


_X = r"regexp_extract(lower(filename), '\.([a-z0-9]+)\s*$', 1)"


@query(f"""WITH {UP} SELECT upload_id,
 coalesce(CASE WHEN upload_id % 3 = 0 THEN 'image/webp' END, CASE {_X} WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'heic' THEN 'image/heic' WHEN 'heif' THEN 'image/heif' END, '') AS image,
 coalesce(CASE {_X} WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' WHEN 'm4v' THEN 'video/x-m4v' WHEN 'webm' THEN 'video/webm' WHEN 'mkv' THEN 'video/x-matroska' END, '') AS video FROM up""")
def resolve_mime(spark, d):
    said = F.when(F.col("upload_id") % 3 == 0, "Image/WebP; q=1").otherwise("application/octet-stream")
    return uploads(spark, d).select("upload_id", text(media.resolve_mime(said, F.col("filename"), media.IMAGE_TYPES)).alias("image"), text(media.resolve_mime(said, F.col("filename"), media.VIDEO_TYPES)).alias("video"))


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"WITH {CAT} SELECT entry_no, {_SLUG.format("strip_accents(coalesce(title, ''))")} AS slug FROM cat")
def slugify(spark, d):
    return catalog(spark, d).select("entry_no", tx.slugify(text(F.col("title"))).alias("slug"))


_POWERS = "[" + ", ".join(str(36**i) for i in range(12, -1, -1)) + "]"
_STEM = "regexp_replace(coalesce(title, ''), '\\.[^.]*$', '')"
_LONG = "CASE WHEN length(b) > 60 THEN regexp_replace(left(b, 60), '-[^-]*$', '') ELSE b END"


@query(f"""WITH {CAT}, k AS (SELECT entry_no, {SHA} sha, {_X.replace('filename', 'title')} ext, coalesce(nullif({_SLUG.format("strip_accents(coalesce(context, ''))")}, ''), nullif({_SLUG.format("strip_accents(" + _STEM + ")")}, ''), 'asset') b FROM cat)
SELECT entry_no, {_LONG} || '-' || left(ltrim(array_to_string(list_transform({_POWERS}, lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', (('0x' || left(sha, 16))::UBIGINT::HUGEINT // p::HUGEINT % 36)::INT + 1, 1)), ''), '0'), 6) || '.' || ext AS slug FROM k WHERE sha IS NOT NULL""")
def asset_slug(spark, d):
    """context or name, six base-36 digits of the hash, extension."""
    c = catalog(spark, d).select("entry_no", "context", "title", _sha(F.col("sha256")).alias("sha")).filter("sha is not null")
    return c.select("entry_no", tx.asset_slug(F.col("context"), F.col("title"), media.extension(F.col("title")), F.col("sha")).alias("slug"))


@query(f"WITH {UP} SELECT upload_id, coalesce(nullif(regexp_replace(filename, '\\.[^.]+$', ''), ''), 'frame') || '-scene-' || lpad((upload_id % 12 + 1)::VARCHAR, 2, '0') AS name FROM up")
def scene_name(spark, d):
    return uploads(spark, d).select("upload_id", tx.scene_name(F.col("filename"), F.col("upload_id") % 12 + 1).alias("name"))


_KEY = "CASE WHEN starts_with(url, 'https://cdn.florafold.invalid/') THEN substr(url, length('https://cdn.florafold.invalid/') + 1) END"
CDN = "https://cdn.florafold.invalid/"


@query(f"WITH {CAT} SELECT entry_no, coalesce({_KEY}, '-') AS key, 'https://media.invalid/' || coalesce({_KEY}, '') AS url FROM cat")
def url_key(spark, d):
    """The object key of a managed URL, and the URL of that key elsewhere."""
    key = F.when(F.col("url").startswith(CDN), F.substring(F.col("url"), len(CDN) + 1, 1 << 20))
    return catalog(spark, d).select("entry_no", F.coalesce(key, F.lit("-")).alias("key"), F.concat(F.lit("https://media.invalid/"), text(key)).alias("url"))


@query(f"""WITH {CAT}, k AS (SELECT entry_no, coalesce({_KEY}, '') AS key FROM cat), e AS (SELECT DISTINCT key FROM k WHERE entry_no % 2 = 0)
SELECT k.entry_no, k.key, CASE WHEN NOT regexp_full_match(k.key, '([a-z0-9][a-z0-9_-]*/)+[a-z0-9][a-z0-9_-]*\\.[a-z0-9]{{2,5}}') OR length(k.key) > 512 THEN 'invalid' WHEN e.key IS NULL THEN 'put' ELSE 'existed' END AS outcome FROM k LEFT JOIN e USING (key)""")
def derived_put(spark, d):
    """Objects put only if their key is well formed and not there yet."""
    key = F.when(F.col("url").startswith(CDN), F.substring(F.col("url"), len(CDN) + 1, 1 << 20))
    rows = catalog(spark, d).select("entry_no", text(key).alias("key"))
    have = rows.filter("entry_no % 2 = 0").select("key").distinct().withColumn("have", F.lit(True))
    sound = F.col("key").rlike(r"^([a-z0-9][a-z0-9_-]*/)+[a-z0-9][a-z0-9_-]*\.[a-z0-9]{2,5}$") & (F.length("key") <= 512)
    return rows.join(have, "key", "left").select("entry_no", "key", F.when(~sound, "invalid").when(F.col("have"), "existed").otherwise("put").alias("outcome"))


# ------------------------------------------------ parsing


@query(f"WITH {CAT} SELECT entry_no, array_to_string({SPLIT.format('tags')}, '|') AS tags FROM cat")
def parse_tags(spark, d):
    return catalog(spark, d).select("entry_no", F.array_join(parse.split_list(F.col("tags")), "|").alias("tags"))


_NAMED = r"(regexp_matches(people, '^\s*\[\s*\{') AND json_valid(people))"


@query(f"""WITH {CAT} SELECT entry_no, array_to_string(CASE WHEN {_NAMED} THEN list_transform(json_extract(people, '$[*]'),
 lambda m: regexp_replace(m->>'$.name', '^\\s+|\\s+$', '', 'g') || ':' || coalesce(m->>'$.consent', '?')) ELSE list_transform({SPLIT.format('people')}, lambda n: n || ':?') END, '|') AS people FROM cat WHERE NOT regexp_matches(people, '^\\s*\\[\\s*"')""")
def parse_people(spark, d):
    """Names with their consent."""
    rows = catalog(spark, d).filter(~F.col("people").rlike(r'^\s*\[\s*"'))
    one = lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["consent"].cast("string"), F.lit("?")))
    return rows.select("entry_no", F.array_join(F.transform(parse.people(F.col("people")), one), "|").alias("people"))


@query(f"""WITH {CAT} SELECT entry_no, len(p) > 0 AND len(list_filter(p, lambda m: m->>'$.consent' IS DISTINCT FROM 'true')) = 0 AS consented FROM (SELECT entry_no, json_extract(people, '$[*]') p FROM cat WHERE {_NAMED})""")
def all_consented(spark, d):
    rows = catalog(spark, d).filter(F.col("people").rlike(r"^\s*\[\s*\{") & F.from_json("people", parse.PEOPLE).isNotNull())
    p = parse.people(F.col("people"))
    return rows.select("entry_no", ((F.size(p) > 0) & F.forall(p, lambda x: F.coalesce(x["consent"], F.lit(False)))).alias("consented"))


@query(f"WITH {CAT} SELECT entry_no, CASE WHEN k IN ('internal', 'licensed', 'restricted') THEN k ELSE 'internal' END AS kind FROM (SELECT entry_no, lower(regexp_replace(coalesce(rights_kind, ''), '^\\s+|\\s+$', '', 'g')) k FROM cat)")
def rights_kind(spark, d):
    return catalog(spark, d).select("entry_no", parse.rights_kind(F.col("rights_kind")).alias("kind"))


@query(f"""WITH {CAT} SELECT entry_no, NOT ({NAMES.format('people')} = [] AND coalesce(people, '') <> '') AND NOT (coalesce(people, '') LIKE '[%' AND NOT coalesce(json_valid(people), false)) AS people_ok,
 NOT (coalesce(tags, '') LIKE '[%' AND NOT coalesce(json_valid(tags), false)) AS tags_ok, lower(regexp_replace(coalesce(rights_kind, ''), '^\\s+|\\s+$', '', 'g')) IN ('internal', 'licensed', 'restricted') AS rights_ok FROM cat""")
def validate_meta(spark, d):
    """Which of an entry's texts are sound; the others go to quarantine."""
    array = lambda c: ~F.coalesce(F.col(c).startswith("[") & F.from_json(c, "array<string>").isNull(), F.lit(False))
    empty = (F.size(parse.people_names(F.col("people"))) == 0) & (text(F.col("people")) != "")
    rights = F.lower(bare(text(F.col("rights_kind")))).isin(*parse.RIGHTS)
    return catalog(spark, d).select("entry_no", (~empty & array("people")).alias("people_ok"), array("tags").alias("tags_ok"), rights.alias("rights_ok"))


@query("WITH m AS (SELECT DISTINCT * FROM asset_manifests) SELECT manifest_id, trim(coalesce(setting_location, '')) AS description, len(list_filter(coalesce(visual_tags, []), lambda t: t IS NOT NULL))::BIGINT AS tags FROM m")
def parse_manifest(spark, d):
    """A model's fenced JSON answer read back."""
    m = curated(spark, d, "asset_manifests", "manifest_id")
    body = F.to_json(F.struct(text(F.col("setting_location")).alias("overall_description"), F.coalesce("visual_tags", F.array().cast("array<string>")).alias("visual_tags")))
    answer = F.concat(F.lit("Here you are: ```json\n"), body, F.lit("\n``` done"))
    got = F.from_json(parse.embedded_json(answer), "overall_description string, visual_tags array<string>")
    rows = m.select("manifest_id", got.alias("g"))
    return rows.select("manifest_id", F.trim(text(F.col("g.overall_description"))).alias("description"), F.size(F.filter("g.visual_tags", lambda t: t.isNotNull())).cast("bigint").alias("tags"))


@query("SELECT event_id, round(0.4 * least(10, greatest(0, value / 20)) + 0.4 * (CASE WHEN event_id % 5 = 0 THEN 0 ELSE least(10, user_id % 13) END) + 0.2 * least(10, greatest(0, event_id % 15 - 2)), 4) AS overall FROM events")
def frame_overall(spark, d):
    """Scores as texts, some no numbers, weighted into one."""
    e = load(spark, d, "events")
    odd = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("user_id") % 13).cast("string"))
    return e.select("event_id", F.round(parse.overall((F.col("value") / 20).cast("string"), odd, (F.col("event_id") % 15 - 2).cast("string")), 4).alias("overall"))


@query("SELECT event_id, 3::BIGINT AS scenes, round(value + event_id % 7 + event_id % 9, 3) AS total FROM events")
def scene_times_parse(spark, d):
    e = load(spark, d, "events")
    log = F.concat_ws("\n", *(F.concat(F.lit("[info] n:1 pts_time:"), v.cast("string"), F.lit(" x")) for v in (F.round(F.col("value"), 3), F.col("event_id") % 7, F.col("event_id") % 9)))
    times = parse.scene_times(log)
    return e.select("event_id", F.size(times).cast("bigint").alias("scenes"), F.round(F.aggregate(times, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("SELECT event_id, round(value, 3) AS duration, 640 + event_id % 3 AS width, CASE WHEN event_id % 4 = 0 THEN 0 ELSE round(30000 / (event_id % 4 * 1001.0), 4) END::DOUBLE AS fps FROM events")
def probe_parse(spark, d):
    """Duration, size and rate from a probe's JSON; a rate over zero is 0."""
    e = load(spark, d, "events")
    stream = F.struct(F.lit("video").alias("codec_type"), (F.lit(640) + F.col("event_id") % 3).alias("width"), F.concat(F.lit("30000/"), (F.col("event_id") % 4 * 1001).cast("string")).alias("r_frame_rate"))
    probe = F.concat(F.lit('{"format":{"duration":"'), F.round("value", 3).cast("string"), F.lit('"},"streams":[{"codec_type":"audio"},'), F.to_json(stream), F.lit("]}"))
    got = F.from_json(probe, "format struct<duration:string>, streams array<struct<codec_type:string,width:bigint,r_frame_rate:string>>")
    video = F.try_element_at(F.filter(got["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    return e.select("event_id", parse.number(got["format"]["duration"]).alias("duration"), video["width"].alias("width"), F.round(parse.frame_rate(video["r_frame_rate"]), 4).alias("fps"))


@query(f"WITH {CAT} SELECT entry_no, CASE WHEN entry_no % 4 = 0 THEN coalesce(title, '') WHEN entry_no % 4 = 1 THEN coalesce(title, '') || coalesce(shoot, '') WHEN entry_no % 4 = 2 THEN coalesce(media_type, '') ELSE '' END AS plain FROM cat")
def plain_text(spark, d):
    """A tagged property as text: runs joined without a separator, one choice, or nothing for an unknown kind."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("title", "rich_text", "select", "formula"))), (F.col("entry_no") % 4 + 1).cast("int"))
    prop = F.struct(kind.alias("type"), F.array(text(F.col("title"))).alias("title"), F.array(text(F.col("title")), text(F.col("shoot"))).alias("rich_text"), text(F.col("media_type")).alias("select"))
    rows = catalog(spark, d).select("entry_no", prop.alias("p"))
    runs = F.when(F.col("p.type") == "title", F.col("p.title")).when(F.col("p.type") == "rich_text", F.col("p.rich_text"))
    return rows.select("entry_no", F.coalesce(F.array_join(runs, ""), F.when(F.col("p.type") == "select", F.col("p.select")), F.lit("")).alias("plain"))


@query("SELECT doc_id, greatest(1, ceil(length(coalesce(text, '')) / 2000.0))::BIGINT AS chunks, length(substr(coalesce(text, ''), greatest(0, ceil(length(coalesce(text, '')) / 2000.0) - 1)::BIGINT * 2000 + 1, 2000))::BIGINT AS last FROM documents")
def text_chunks(spark, d):
    c = tx.chunks(text(F.col("text")))
    return load(spark, d, "documents").select("doc_id", F.size(c).cast("bigint").alias("chunks"), F.length(F.element_at(c, -1)).cast("bigint").alias("last"))


# ------------------------------------------------ writing and merging


@query(f"""WITH {UP} SELECT upload_id, nullif(trim(filename), '') AS title, nullif(trim(source), '') AS source, 'internal' AS rights, 1700000000::BIGINT AS uploaded_at FROM up""")
def create_entry(spark, d):
    """New rows with their defaults; the clock is a parameter."""
    u = uploads(spark, d)
    return u.select("upload_id", filled(F.trim("filename")).alias("title"), filled(F.trim("source")).alias("source"), F.lit(parse.RIGHTS[0]).alias("rights"), F.lit(1_700_000_000).cast("bigint").alias("uploaded_at"))


@query(f"WITH {CAT} SELECT entry_no, coalesce(nullif(trim(coalesce(location, '')), ''), '-') AS location, coalesce(nullif(trim(coalesce(context, '')), ''), '-') AS context FROM cat")
def form_parse(spark, d):
    """Form fields, trimmed, blank ones missing."""
    field = lambda c: F.coalesce(filled(F.trim(text(F.col(c)))), F.lit("-")).alias(c)
    return catalog(spark, d).select("entry_no", field("location"), field("context"))


@query(f"""WITH {CAT} SELECT entry_no, coalesce(try_cast(shoot AS DOUBLE), -1) AS number, coalesce(nullif(url, ''), '-') AS url, left(coalesce(description, ''), 100) AS choice, array_to_string(list_transform({SPLIT.format('tags')}, lambda t: left(t, 100)), '|') AS choices FROM cat""")
def coerce_property(spark, d):
    """Texts as a number, a URL, one choice and several choices."""
    tags = F.transform(parse.split_list(F.col("tags")), lambda t: F.left(t, F.lit(100)))
    return catalog(spark, d).select("entry_no", F.coalesce(F.col("shoot").try_cast("double"), F.lit(-1.0)).alias("number"), F.coalesce(filled(F.col("url")), F.lit("-")).alias("url"), F.left(text(F.col("description")), F.lit(100)).alias("choice"), F.array_join(tags, "|").alias("choices"))


@query(f"""WITH {CAT} SELECT entry_no, CASE WHEN entry_no % 5 = 0 THEN CASE WHEN entry_no % 2 = 0 THEN '' ELSE 'new place' END ELSE coalesce(location, '') END AS location, CASE WHEN entry_no % 5 = 0 AND entry_no % 3 = 0 THEN 'note' ELSE coalesce(context, '') END AS context FROM cat""")
def patch_update(spark, d):
    """A given field replaces, an empty one clears, one not given leaves what is there."""
    base = catalog(spark, d).select("entry_no", text(F.col("location")).alias("location"), text(F.col("context")).alias("context"))
    patch = base.filter("entry_no % 5 = 0").select("entry_no", F.when(F.col("entry_no") % 2 == 0, "").otherwise("new place").alias("p_location"), F.lit(True).alias("has_location"), F.lit("note").alias("p_context"), (F.col("entry_no") % 3 == 0).alias("has_context"))
    rows = base.join(patch, "entry_no", "left")
    put = lambda c: F.when(F.col(f"has_{c}"), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("entry_no", put("location"), put("context"))


@query(f"""WITH {CAT}, m AS (SELECT entry_no, arg_max(coalesce(setting_location, ''), manifest_id) setting, arg_max(round(product_confidence * 100)::BIGINT, manifest_id) FILTER (WHERE product_confidence IS NOT NULL) conf FROM (SELECT DISTINCT * FROM asset_manifests) GROUP BY entry_no)
SELECT entry_no, coalesce(nullif(m.setting, ''), location, '') AS setting, coalesce(m.conf, -1) AS confidence FROM cat LEFT JOIN m USING (entry_no)""")
def enrich_write(spark, d):
    """The latest analysis written over what was there, empty fields untouched."""
    m = curated(spark, d, "asset_manifests", "manifest_id")
    conf = F.round(F.col("product_confidence") * 100).cast("bigint")
    m = m.groupBy("entry_no").agg(F.max_by(text(F.col("setting_location")), "manifest_id").alias("setting"), F.max_by(conf, F.when(conf.isNotNull(), F.col("manifest_id"))).alias("conf"))
    rows = catalog(spark, d).select("entry_no", "location").join(m, "entry_no", "left")
    return rows.select("entry_no", F.coalesce(filled(F.col("setting")), F.col("location"), F.lit("")).alias("setting"), F.coalesce("conf", F.lit(-1)).cast("bigint").alias("confidence"))


_ADD = "CASE entry_no % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' extra note ' ELSE coalesce(shoot, '') END"


@query(f"""WITH {CAT}, a AS (SELECT entry_no, coalesce(context, '') old, trim({_ADD}) new FROM cat)
SELECT entry_no, CASE WHEN new = '' OR contains(old, new) THEN old WHEN old = '' THEN new ELSE old || chr(10) || new END AS context FROM a""")
def merge_context(spark, d):
    new = F.when(F.col("entry_no") % 3 == 0, "  ").when(F.col("entry_no") % 3 == 1, " extra note ").otherwise(text(F.col("shoot")))
    return catalog(spark, d).select("entry_no", merge.append_text(F.col("context"), new).alias("context"))


@query(f"WITH {CAT} SELECT entry_no, coalesce(nullif(location, ''), 'studio') AS location, coalesce(nullif(credit, ''), trim(coalesce(source, ''))) AS credit FROM cat")
def merge_scalars(spark, d):
    return catalog(spark, d).select("entry_no", merge.fill(F.col("location"), F.lit(" studio ")).alias("location"), merge.fill(F.col("credit"), F.col("source")).alias("credit"))


_NEWTAGS = "['Studio', 'new tag', 'new tag']"


@query(f"WITH {CAT}, t AS (SELECT entry_no, {SPLIT.format('tags')} old FROM cat) SELECT entry_no, array_to_string(list_concat(old, list_filter({_NEWTAGS}, lambda t: NOT list_contains(list_transform(old, lambda o: lower(o)), lower(t)))), '|') AS tags FROM t")
def merge_tags(spark, d):
    new = F.array(F.lit("Studio"), F.lit("new tag"), F.lit("new tag"))
    return catalog(spark, d).select("entry_no", F.array_join(merge.merge_tags(parse.split_list(F.col("tags")), new), "|").alias("tags"))


@query()
def merge_people(spark, d):
    """People of an entry with those of its tags: consents filled, new names added."""
    t = curated(spark, d, "person_tags", "tag_id").filter("name is not null")
    lowest = t.groupBy("entry_no", F.lower("name").alias("k")).agg(F.min(F.struct("tag_id", "name", "consent")).alias("p"))
    tags = lowest.groupBy("entry_no").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["name"].alias("name"), p["consent"].alias("consent"))).alias("new"))
    rows = catalog(spark, d).select("entry_no", parse.people(F.col("people")).alias("old")).join(tags, "entry_no")
    one = lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["consent"].cast("string"), F.lit("?")))
    return rows.select("entry_no", F.array_join(F.transform(merge.merge_people(F.col("old"), F.col("new")), one), "|").alias("people"))


@query(f"""WITH {CAT}, {UP}, f AS (SELECT {SHA} sha, min(entry_no) entry_no FROM cat GROUP BY 1),
u AS (SELECT arg_min(filename, batch_no * 1000000 + upload_id) filename, arg_min(source, batch_no * 1000000 + upload_id) source, f.entry_no FROM (SELECT *, {SHA} sha FROM up) u JOIN f ON f.sha = u.sha GROUP BY f.entry_no)
SELECT u.entry_no, CASE WHEN contains(coalesce(cat.context, ''), trim(u.filename)) THEN coalesce(cat.context, '') WHEN coalesce(cat.context, '') = '' THEN trim(u.filename) ELSE cat.context || chr(10) || trim(u.filename) END AS context,
 coalesce(nullif(cat.location, ''), trim(coalesce(u.source, ''))) AS location FROM u JOIN cat USING (entry_no)""")
def merge_contribution(spark, d):
    """What the first exact duplicate of each entry adds to it."""
    first = entries(spark, d).filter("sha is not null").groupBy("sha").agg(F.min("entry_no").alias("entry_no"))
    u = uploads(spark, d).join(first, "sha").groupBy("entry_no").agg(F.min_by("filename", "seq").alias("filename"), F.min_by("source", "seq").alias("source"))
    rows = catalog(spark, d).select("entry_no", "context", "location").join(u, "entry_no")
    return rows.select("entry_no", merge.append_text(F.col("context"), F.col("filename")).alias("context"), merge.fill(F.col("location"), F.col("source")).alias("location"))


_FATE = f"""c AS (SELECT DISTINCT {SHA} sha FROM cat), f AS (SELECT DISTINCT {FP} fp FROM cat),
u AS (SELECT upload_id, batch_no, {SHA} sha, {FP} fp, row_number() OVER (PARTITION BY {SHA} ORDER BY batch_no, upload_id) rn FROM up),
s AS (SELECT upload_id, batch_no, fp FROM u WHERE fp IS NOT NULL AND NOT coalesce(sha IS NOT NULL AND (sha IN (SELECT sha FROM c WHERE sha IS NOT NULL) OR rn > 1), false)),
n AS (SELECT DISTINCT upload_id FROM u JOIN f ON bit_count(xor(u.fp, f.fp)) <= 6
 UNION SELECT a.upload_id FROM s a JOIN s b ON (b.batch_no, b.upload_id) < (a.batch_no, a.upload_id) AND bit_count(xor(a.fp, b.fp)) <= 6)"""


@query(f"""WITH {CAT}, {UP}, {_FATE} SELECT upload_id, CASE WHEN sha IS NOT NULL AND (sha IN (SELECT sha FROM c WHERE sha IS NOT NULL) OR rn > 1) THEN 'deduped' WHEN upload_id IN (SELECT upload_id FROM n) THEN 'similar' ELSE 'created' END AS outcome FROM u""")
def ingest_batch(spark, d):
    """Each upload's outcome: exact duplicate first, then near duplicate of the catalogue or of an upload stored before it, else created."""
    known = dedup.split_known(uploads(spark, d), entries(spark, d).filter("sha is not null"), "sha", "seq")
    # read three times below
    known = Workspace(spark, "ingest").save(known.select("upload_id", "seq", "fp", "fate"))
    stored = known.filter("fate = 'first'").select("fp", F.col("seq").alias("since"))
    near = neardup.since_near(stored, entries(spark, d).select("fp"), 6)
    rows = known.filter("fp is not null").join(near.hint("merge"), "fp", "left").unionByName(known.filter("fp is null"), allowMissingColumns=True)
    return rows.select("upload_id", F.when(F.col("fate") != "first", "deduped").when(F.col("since") < F.col("seq"), "similar").otherwise("created").alias("outcome"))


@query(f"""WITH {CAT}, {UP}, {_FATE} SELECT u.upload_id, CASE WHEN sha IS NOT NULL AND (sha IN (SELECT sha FROM c WHERE sha IS NOT NULL) OR rn > 1) THEN 'deduped' ELSE 'created' END AS outcome
FROM u JOIN up USING (upload_id) WHERE regexp_extract(lower(filename), '\\.([a-z0-9]+)\\s*$', 1) IN ('mp4','mov','webm','m4v','avi','mkv','gifv')""")
def ingest_video(spark, d):
    """Video files: exact duplicates only, no hash of their look."""
    known = dedup.split_known(uploads(spark, d), entries(spark, d).filter("sha is not null"), "sha", "seq")
    video = media.extension(F.col("filename")).isin(*media.VIDEOS)
    return known.filter(video).select("upload_id", F.when(F.col("fate") != "first", "deduped").otherwise("created").alias("outcome"))


@query("""WITH m AS (SELECT DISTINCT * FROM asset_manifests), s AS (SELECT manifest_id, array_to_string(coalesce(visual_tags, []), ', ') t, len(coalesce(visual_tags, [])) n FROM m)
SELECT manifest_id, CASE WHEN length(t) > 140 THEN left(t, 140) || '…' ELSE t END || ' · ' || n || ' tags' AS summary FROM s""")
def upload_summary(spark, d):
    m = curated(spark, d, "asset_manifests", "manifest_id")
    tags = F.coalesce("visual_tags", F.array().cast("array<string>"))
    return m.select("manifest_id", F.concat(tx.summary(F.array_join(tags, ", ")), F.lit(" · "), F.size(tags).cast("string"), F.lit(" tags")).alias("summary"))


@query("WITH m AS (SELECT DISTINCT * FROM asset_manifests) SELECT manifest_id, coalesce(array_to_string(usable_for, ', '), '') AS usable_for, coalesce(array_to_string(mood_tone, ', '), '') AS mood_tone FROM m")
def list_to_text(spark, d):
    """Lists as texts, the change of type of those columns."""
    m = curated(spark, d, "asset_manifests", "manifest_id")
    return m.select("manifest_id", *(text(F.array_join(c, ", ")).alias(c) for c in ("usable_for", "mood_tone")))


@query("""WITH m AS (SELECT DISTINCT * FROM asset_manifests) SELECT manifest_id, coalesce(array_to_string(list_transform(visual_tags[1:3], lambda t: '0–4s: ' || coalesce(t, '') || ' [pan; use: hero]'), chr(10)), '') AS beats FROM m""")
def format_beats(spark, d):
    m = curated(spark, d, "asset_manifests", "manifest_id")
    rows = F.transform(F.slice("visual_tags", 1, 3), lambda t: F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), text(t).alias("text"), F.lit("pan").alias("kind"), F.lit("hero").alias("use")))
    return m.select("manifest_id", text(parse.beats(rows)).alias("beats"))


_TEXTS = ["url", "description", "media_type", "drive_link", "context", "people", "product", "location", "shoot", "credit", "rights_notes", "tags", "source", "uploaded_by", "phash"]


@query(f"""WITH {CAT} SELECT entry_no, id, coalesce(nullif(title, ''), 'Untitled') AS title, {', '.join(f"coalesce({c}, '') AS {c}" for c in _TEXTS)},
 CASE WHEN lower(regexp_replace(coalesce(rights_kind, ''), '^\\s+|\\s+$', '', 'g')) IN ('internal', 'licensed', 'restricted') THEN lower(regexp_replace(rights_kind, '^\\s+|\\s+$', '', 'g')) ELSE 'internal' END AS rights_kind,
 epoch_us(coalesce(uploaded_at, created_time)) AS uploaded, epoch_us(created_time) AS created, epoch_us(last_edited_time) AS edited, coalesce(lower(sha256), '') AS sha256, archived FROM cat""")
def entry_projection(spark, d):
    """A stored row as the entry that callers see, every field of it."""
    texts = [text(F.col(c)).alias(c) for c in _TEXTS]
    times = [micros(F.coalesce("uploaded_at", "created_time")).alias("uploaded"), micros(F.col("created_time")).alias("created"), micros(F.col("last_edited_time")).alias("edited")]
    return catalog(spark, d).select("entry_no", "id", F.coalesce(filled(F.col("title")), F.lit("Untitled")).alias("title"), *texts, parse.rights_kind(F.col("rights_kind")).alias("rights_kind"), *times, text(F.lower("sha256")).alias("sha256"), "archived")
