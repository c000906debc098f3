import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import collections, dedup, frames, neardup, overlay, queue, search
from trellis.plans import ranges, skew
from trellis.plans.blocks import block_tables, choose_blocks, near_pairs
from trellis.providers.base import embed
from trellis.providers.stub import HashEmbedder
from trellis.sources import objects
from trellis.streaming.streams import drain, fold_into, read_overlay, suppress_copies


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("radius, blocks, kept", [(6, 8, 2), (6, 7, 1), (3, 6, 3), (0, 1, 1)])
def test_block_pairs_against_brute_force(spark, radius, blocks, kept):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r["fp"], r["other"]) for r in near_pairs(df, block_tables(df, blocks, kept), radius, blocks, kept).collect()}
    assert got == {(signed(a), signed(b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= radius}


def test_blocks_follow_size():
    assert choose_blocks(100, 100, 6)[1] <= choose_blocks(10**9, 10**8, 6)[1]


def test_top_near(spark):
    left = spark.createDataFrame([(1, 0), (2, None), (3, 255)], "k long, fp long")
    right = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None), (14, 0), (10, 1)], "o long, fp long")
    got = sorted((r["k"], r["o"], r["distance"], r["rank"]) for r in neardup.top_near(left, right, "k", "o", 6, 3).collect())
    assert got == [(1, 10, 1, 2), (1, 11, 1, 3), (1, 14, 0, 1), (3, 12, 6, 1)]


def test_lookup_with_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    left = spark.range(900).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k")).withColumn("k", F.when(F.col("id") % 50 != 1, F.col("k")))
    right = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [tuple(r) for r in skew.hot_keys(left, "k").collect()] == [(0, 7)]
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.lookup(left, right, "k", 900, how).select("id", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=str)


def test_best_of(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 2.0), (4, None, 0.0), (5, "", 0.0)], "seq long, k string, s double")
    assert sorted(r["seq"] for r in dedup.best_of(rows, "k", F.col("s"), "seq").collect()) == [2, 4, 5]


def test_split_known(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "seq long, k string")
    old = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted((r["seq"], r["fate"]) for r in dedup.split_known(new, old, "k", "seq").collect()) == [(1, "known"), (2, "first"), (3, "repeat"), (4, "first"), (5, "first")]


def test_record_score(spark):
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    c = dedup.record_score(F.lit("u"), F.lit("l"), F.lit("d"), at)
    assert spark.range(1).select(c).first()[0] == pytest.approx(115.17040672)


def test_overlay(spark):
    ups = spark.createDataFrame([(1, 1, "a", "h", 5), (1, 2, "", "", 6), (1, 3, None, None, 7), (2, 1, "b", None, 8)], "k int, seq int, title string, hash string, born int")
    got = {r["k"]: (r["title"], r["hash"], r["born"]) for r in overlay.fold(ups, "k", "seq", ["title"], ["hash"], ["born"]).collect()}
    assert got == {1: (None, "h", 5), 2: ("b", None, 8)}
    base = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, title string")
    over, gone = base.filter("k = 1").withColumn("title", F.lit("new")), base.filter("k in (1, 2)").select("k")
    assert sorted((r["k"], r["title"], r["is_overlay"]) for r in overlay.merge(base, over, gone, "k").collect()) == [(1, "new", True), (3, "x", False)]
    state = overlay.state(base.select("k"), base, over, gone, "k")
    assert {r["k"]: r["searchable"] for r in state.collect()} == {1: True, 2: False, 3: True}


def test_pages_join_to_the_whole(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("score"))
    order = [F.desc("score"), "id"]
    pages = [search.page(rows, order, o, 24, 80).select("id").collect() for o in (0, 24, 48, 72, 96)]
    assert [r["id"] for p in pages for r in p] == [r["id"] for r in rows.orderBy(*order).limit(80).collect()]


def test_keyword_filter(spark):
    df = spark.createDataFrame([("Red rose", None), ("red", "ROSE"), ("rose", "")], "a string, b string")
    assert search.text_fields(df, ["a", "b", "c"]) == ["a", "b"]
    assert df.filter(search.keyword_filter(" Rose  red", ["a", "b"])).count() == 2
    assert df.filter(search.keyword_filter(" ", ["a", "b"])).count() == 3


@pytest.mark.parametrize("duration, times", [(10.0, [0.2, 1.21, 3.64, 6.06, 8.49]), (0.2, [0.0])])
def test_frame_plan(spark, duration, times):
    plan = frames.plan(F.lit(duration), F.array().cast("array<double>"))
    assert spark.range(1).select(plan).first()[0] == pytest.approx(times)


def test_frame_plan_is_spaced_and_bounded(spark):
    cuts = F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: i / 4.0)
    times = spark.range(1).select(frames.plan(F.lit(100.0), cuts)).first()[0]
    assert len(times) == 24 and all(b - a > 0.39 for a, b in zip(times, times[1:]))


def test_scenes_and_best(spark):
    rows = [(1, 0, 0, 5.0, 2.0), (1, 1, 1, 9.0, 8.0), (1, 2, -1, 1.0, None), (1, 3, 3, 7.0, 8.0), (2, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "video long, t long, fp long, sharp double, overall double")
    s = frames.scenes(df, "video", "t", "fp", 10)
    assert sorted((r["video"], r["t"], r["scene"]) for r in s.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 0, 0)]
    best = frames.best_frames(s, ["video", "scene"], "sharp", "overall", "t")
    assert sorted((r["video"], r["scene"], r["t"]) for r in best.collect()) == [(1, 0, 1), (1, 1, 2)]
    top = frames.top_scenes(best, "video", "overall", "sharp", "t", 1)
    assert [(r["t"], r["place"]) for r in top.collect()] == [(1, 1)]


def test_queue(spark):
    log = spark.createDataFrame([(1, 0, 0, "queued"), (1, 10, 1, "processing"), (2, 5, 2, "done"), (3, 5, 3, "queued")], "k long, at long, seq long, status string")
    jobs = queue.latest(log, "k", "at", "seq").withColumnRenamed("at", "updated_at")
    assert sorted(r["k"] for r in queue.claimable(jobs, 20).collect()) == [3]
    assert sorted(r["k"] for r in queue.claimable(jobs, 20 + queue.STALE_MS).collect()) == [1, 3]
    assert [r["k"] for r in queue.expired(jobs, 6 + queue.KEPT_MS).collect()] == [2]
    still = spark.createDataFrame([(1, 0, 0, "a"), (1, 300_000, 1, "a"), (1, 300_001, 2, "b")], "k long, at long, seq long, status string")
    assert [(r["since"], r["until"]) for r in queue.stalls(still, "k", "at", "seq", ["status"]).collect()] == [(0, 300_000)]


def test_ranges(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31),), (dt.datetime(2024, 2, 1),)], "at timestamp")
    assert [(r["since"].month, r["until"].month) for r in ranges.months(df, "at").collect()] == [(1, 2), (2, 3)]
    assert ranges.months(df.limit(0), "at").count() == 0
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("at"))
    cells = ranges.bisected(rows, "at", 60).collect()
    assert sum(c["n"] for c in cells) == 1000 and max(c["n"] for c in cells) <= 60


def test_collections(spark):
    m = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), ("b", 99)], "c string, entry long")
    assert sorted(map(tuple, collections.summaries(m, "c").collect())) == [("a", 25, True), ("b", 2, False)]
    assert collections.items(m, m.filter("entry < 50").select("entry").distinct(), "entry").count() == 31
    names = spark.createDataFrame([(" ",), (None,), ("Spring ",)], "name string")
    assert [r["name"] for r in collections.named(names, "name").collect()] == ["Untitled collection"] * 2 + ["Spring"]
    assert collections.search(names, "name", " SPR ").count() == 1


def test_provider(spark):
    class Broken:
        dimensions = 4

        def embed(self, texts):
            raise OSError("no answer")

    df = spark.createDataFrame([(1, "red rose"), (2, None), (3, ""), (4, "red rose")], "id long, text string")
    got = {r["id"]: r["v"] for r in embed(df, "id", "text", HashEmbedder(8)).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1)
    assert all(r["v"] is None for r in embed(df, "id", "text", Broken()).collect())


def test_objects(spark, tmp_path):
    for name, body in (("a", '{"id": "a", "status": "done", "frames": [{"t": 1.5}]}'), ("b", "{oops"), ("c", '{"status": "x"}')):
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "job.json").write_text(body)
    got = objects.jobs(spark, str(tmp_path / "jobs")).collect()
    assert [(r["id"], r["frames"][0]["t"]) for r in got] == [("a", 1.5)]
    assert objects.listing(spark, str(tmp_path / "jobs"), "*.json").count() == 3
    index = spark.createDataFrame([(1, "x", ""), (2, None, "y")], "id long, title string, place string")
    objects.write_index(index, str(tmp_path / "index"))
    assert objects.read_index(spark, str(tmp_path / "index")).count() == 2
    assert objects.read_index(spark, str(tmp_path / "none")) is None
    objects.export_json(index, str(tmp_path / "json"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"id":1,"title":"x"}', '{"id":2,"place":"y"}']
    assert objects.missing_columns(index, {"title": "int", "extra": "string"}) == ({"extra": "string"}, {"title": ("string", "int")})
    assert objects.with_columns(index, {"extra": "string"}).columns[-1] == "extra"


def test_stream_suppresses_copies(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in range(3)] + [("b", dt.datetime(2024, 1, 1)), ("c", dt.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    history = spark.createDataFrame([("b",)], "k string")
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in drain(suppress_copies(stream, history, "k", "at", "30 days"), "t").collect()) == ["a", "c"]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    ups = spark.createDataFrame([(i % 5, i, f"t{i}", "" if i % 3 else f"h{i}", i) for i in range(40)], "k long, seq long, title string, hash string, born long")
    ups.repartition(4).write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ups.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    args = ("k", "seq", ["title"], ["hash"], ["born"])
    stream.writeStream.foreachBatch(fold_into(str(tmp_path / "log"), *args)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    want = {r["k"]: (r["title"], r["hash"]) for r in overlay.fold(ups, *args).collect()}
    assert {r["k"]: (r["title"], r["hash"]) for r in read_overlay(log, "k", *args[2:]).collect()} == want
