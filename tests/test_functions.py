"""Expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from trellis.functions import bits, media, merge, parse
from trellis.functions import text as tx
from trellis.functions.vectors import dot, from_blob, to_blob, unit, usable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*w):
    return F.array(*(F.lit(x) for x in w))


@pytest.mark.parametrize("query, terms, hay, score", [
    ("red rose pot", ["red", "rose", "pot"], "a red pot", 0.30), ("a rose", ["a", "rose"], "x rose y", 0.225), ("a rose", ["a", "rose"], "x a rose y", 0.5),
    (" rose ", ["rose"], "rose", 0.45), ("", [], "rose", 0.0), ("rose", ["rose"], "", 0.0), ("  ", [], "x", 0.0),
])
def test_direct_hit(spark, query, terms, hay, score):
    t = words(*terms) if terms else F.array().cast("array<string>")
    assert one(spark, tx.direct_hit(F.lit(query), t, F.lit(hay))) == pytest.approx(score)


def test_keyword_boost(spark):
    q = F.lit("kellie with osaka")
    assert one(spark, tx.keyword_boost(q, words("Kellie", "Tom"), F.lit("Osaka"))) == pytest.approx(0.35)
    assert one(spark, tx.keyword_boost(q, words(""), F.lit(None).cast("string"))) == 0.0


def test_tokens_and_haystack(spark):
    assert one(spark, tx.tokens(F.lit(" A b\tC "))) == ["a", "b", "c"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, tx.haystack(F.lit("A"), F.lit(""), F.lit("B"))) == "a\nb"


def test_slugs(spark):
    assert one(spark, tx.slugify(F.lit(" Ünter—den Linden! "))) == "unter-den-linden"
    sha = F.sha2(F.lit("abc"), 256)
    assert one(spark, tx.asset_slug(F.lit(""), F.lit(""), F.lit("jpg"), sha)) == "asset-2u31av.jpg"
    long = one(spark, tx.short_slug(F.lit("-".join(["word"] * 30))))
    assert len(long) <= 60 and long.endswith("word")


def test_chunks_and_names(spark):
    assert one(spark, tx.chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"]
    assert one(spark, tx.chunks(F.lit(""), 2)) == [""]
    assert one(spark, tx.scene_name(F.lit("a.b.mp4"), F.lit(3))) == "a.b-scene-03"
    assert one(spark, tx.base_name(F.lit(".mp4"))) == "frame"


@pytest.mark.parametrize("name, mime, said, kind", [("a.JPG ", "", "", "image"), ("x", "video/mp4", "", "video"), ("x.txt", "", "Image", "image"), ("x", "", "", "other"), (None, None, None, "other")])
def test_media_type(spark, name, mime, said, kind):
    assert one(spark, media.media_type(*(F.lit(v).cast("string") for v in (name, mime, said)))) == kind


def test_resolve_mime(spark):
    assert one(spark, media.resolve_mime(F.lit("Image/PNG; x=1"), F.lit("a.gif"), media.IMAGE_TYPES)) == "image/png"
    assert one(spark, media.resolve_mime(F.lit("text/plain"), F.lit("a.HEIF"), media.IMAGE_TYPES)) == "image/heif"
    assert one(spark, media.resolve_mime(F.lit(""), F.lit("a.gif"), media.IMAGE_TYPES)) is None


@pytest.mark.parametrize("raw, strict, names", [
    ('[{"x":1}]', ['[{"x":1}]'], []), ('[{"x":1},{"name":"K"}]', ['[{"x":1}', '{"name":"K"}]'], ["K"]), ('[{"name":" K ","consent":true}]', ["K"], [" K "]),
    ("Kellie, Tom;;", ["Kellie", "Tom"], ["Kellie", "Tom"]), ("", [], []), (None, [], []), ('["A","B"]', None, ["A", "B"]),
])
def test_people(spark, raw, strict, names):
    c = F.lit(raw).cast("string")
    if strict is not None:
        assert [p["name"] for p in one(spark, parse.people(c))] == strict
    assert one(spark, parse.people_names(c)) == names


def test_scores_and_answers(spark):
    score = lambda *v: one(spark, parse.overall(*(F.lit(x) for x in v)))
    assert score("8", "6", "5") == pytest.approx(6.6)
    assert score("12", "x", "-1") == pytest.approx(4.0)
    for text in ('```json\n{"a": 1}\n```', 'so: {"a": 1} done', '{"a": 1}'):
        assert one(spark, parse.embedded_json(F.lit(text))) == '{"a": 1}'
    assert one(spark, parse.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert one(spark, parse.frame_rate(F.lit("1/0"))) == one(spark, parse.frame_rate(F.lit("n/a"))) == 0.0
    assert one(spark, parse.scene_times(F.lit("pts_time:1.5 x\npts_time:2 "))) == [1.5, 2.0]


def test_merging(spark):
    assert one(spark, merge.append_text(F.lit("a b"), F.lit(" b "))) == "a b"
    assert one(spark, merge.append_text(F.lit("a"), F.lit("c"))) == "a\nc"
    assert one(spark, merge.fill(F.lit(None).cast("string"), F.lit(" x "))) == "x"
    assert one(spark, merge.merge_tags(words("A"), words("a", "b", "b"))) == ["A", "b", "b"]
    people = lambda *p: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).cast("boolean").alias("consent")) for n, c in p))
    merged = one(spark, merge.merge_people(people(("Kay", None), ("Tom", False)), people(("KAY", True), ("tom", True), ("New", None), ("new", True))))
    assert [(p["name"], p["consent"]) for p in merged] == [("Kay", True), ("Tom", False), ("New", None)]


def test_hashes(spark):
    assert one(spark, bits.hamming(bits.hash_bits(F.lit("ffffffffffffffff")), bits.hash_bits(F.lit(" 00000000000000FF\n")))) == 56
    assert one(spark, bits.is_similar(F.lit("zz"), F.lit("00000000000000ff"), 64)) is False
    block = F.array(*(F.lit(float(i)) for i in range(64)))
    h = one(spark, bits.threshold_bits(block))
    assert len(h) == 16 and bin(int(h, 16)).count("1") == 31


def test_cosine_transform(spark):
    import math

    px = [float((x * 7 + y * 3) % 17) for y in range(32) for x in range(32)]
    got = spark.createDataFrame([(px,), ([1.0],), (None,)], "p array<double>").select(bits.dct_low(F.col("p")).alias("c")).collect()
    c = lambda k, n: math.cos(math.pi * (2 * n + 1) * k / 64)
    want = sum(px[y * 32 + x] * c(2, y) * c(5, x) for y in range(32) for x in range(32))
    assert got[0]["c"][2 * 8 + 5] == pytest.approx(want)
    assert got[1]["c"] is None and got[2]["c"] is None


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>")
    assert one(spark, unit(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, unit(F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"))) == [0.0, 0.0]
    assert one(spark, dot(v, v)) == 25.0
    assert one(spark, usable(F.lit(None).cast("array<float>"), F.lit(2))) is False
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k long, v array<float>")
    back = from_blob(to_blob(df, "k", "v"), 2).collect()
    assert [(r["key"], r["pos"], r["vector"]) for r in back] == [(1, 0, [1.0, 2.0])]


def test_images(spark):
    from trellis.functions.image import entropy, sharpness, tidy

    flat, board = [128.0] * 64, [255.0 * ((i // 8 + i) % 2) for i in range(64)]
    df = spark.createDataFrame([(1, flat), (2, board), (3, None), (4, [1.0])], "id long, p array<double>")
    got = {r["id"]: (r["s"], r["e"]) for r in df.select("id", sharpness("p").alias("s"), entropy("p").alias("e")).collect()}
    assert got[1] == (0.0, 0.0) and got[2][0] > 1e5 and got[2][1] == pytest.approx(1.0)
    assert got[3] == (None, None) and got[4] == (None, 0.0)
    rgb = spark.createDataFrame([([100.0, 100.0, 100.0] * 16,), (None,), ([1.0],)], "p array<double>").select(tidy("p").alias("t")).collect()
    assert rgb[0]["t"] == pytest.approx([100 * 1.02 * 1.03 - 3] * 48) and rgb[1]["t"] is None and rgb[2]["t"] is None
