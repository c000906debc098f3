import random
from math import comb

import pytest
from pyspark.sql import functions as F

from trellis.llm.components import connected_components
from trellis.llm.history import FingerprintStore, choice_masks, mark_duplicates
from trellis.plans.blocks import rotated
from trellis.runtime import Workspace


def groups_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "src string, dst string, u string, r int")
    rows = connected_components(df).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["group_id"] for r in rows}


def test_chains_stars_loops_and_doubles(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    star = [("hub", f"s{i:03}") for i in range(300)]
    odd = [("x", "x"), (None, "y"), ("z", None), ("p", "q"), ("q", "p"), ("p", "q")]
    random.Random(1).shuffle(chain)
    assert run(spark, chain + star + odd) == groups_of(chain + star + odd)


def test_random_graph(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)]
    assert run(spark, edges) == groups_of(edges)


def test_no_link(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a"), (None, None)]) == {}


def test_long_vertices(spark):
    df = spark.createDataFrame([(5, 3), (3, 9), (1, 2)], "src long, dst long")
    assert {(r["id"], r["group_id"]) for r in connected_components(df).collect()} == {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1)}


def test_rounds_and_one_task_agree(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(500)}", f"n{rng.randrange(500)}") for _ in range(400)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for most in (0, 60, 400):
        assert {r["id"]: r["group_id"] for r in connected_components(df, one_task=most).collect()} == groups_of(edges)


def test_few_links_take_few_queries(spark, monkeypatch):
    saved = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda ws, df: saved.append(1) or save(ws, df))
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    assert run(spark, chain) == groups_of(chain)
    assert len(saved) <= 4


def brute(rows, radius=6):
    base = min(r[0] for r in rows)
    out = set()
    for s, sha, fp in rows:
        if s == base:
            continue
        for s2, sha2, fp2 in rows:
            if s2 < s and ((sha is not None and sha == sha2) or (fp is not None and fp2 is not None and bin((fp ^ fp2) & (1 << 64) - 1).count("1") <= radius)):
                out.add(s)
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def history(seed, n=160):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for i in range(n):
        fp = rng.choice(fps)
        for _ in range(rng.choice([0, 1, 3, 6, 7, 9])):
            fp ^= 1 << rng.randrange(64)
        rows.append((0 if i < 60 else i, rng.choice([None, None, "a", "b", f"s{rng.randrange(60)}"]), None if rng.random() < 0.1 else signed(fp)))
    return rows


def test_duplicates_against_brute_force(spark):
    rows = history(3)
    at = lambda s: 0 if s == 0 else 1 if s < 90 else 2 if s < 130 else 7
    df = spark.createDataFrame([(at(r[0]), *r, "clash") for r in rows + rows[:30] + rows[-30:]], "batch int, seq long, sha string, fp long, block string")
    found = [r["seq"] for r in mark_duplicates(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_duplicates_of_nothing(spark):
    schema = "batch int, seq long, sha string, fp long"
    assert mark_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert mark_duplicates(spark.createDataFrame([(0, 0, None, None), (1, 1, None, None), (None, 3, "a", 1)], schema)).collect() == []


def test_one_hot_fingerprint(spark):
    df = spark.range(1, 3001).select(F.lit(1).alias("batch"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("sha"), F.lit(77).cast("long").alias("fp"))
    df = df.union(spark.sql("select 0, 0L, cast(null as string), cast(null as long)"))
    assert mark_duplicates(df).count() == 2999


def test_store_by_batches_equals_replay(spark, tmp_path):
    rows = history(5, 120)
    schema = "seq long, sha string, fp long"
    store = FingerprintStore(spark, str(tmp_path))
    batch = lambda lo, hi: spark.createDataFrame([r for r in rows if lo <= r[0] < hi], schema)
    store.append(batch(0, 1), 0)
    found = set()
    for n, (lo, hi) in enumerate(((1, 80), (80, 100), (100, 999)), 1):
        found |= {r["seq"] for r in store.lookup(batch(lo, hi)).collect()}
        store.append(batch(lo, hi), n)
        files = {name: spark.table(t).count() for name, t in store.names.items()}
        store.append(batch(lo, hi), n)  # an attempt made again stores nothing twice
        assert {name: spark.table(t).count() for name, t in store.names.items()} == files
        store.close()
        store = FingerprintStore(spark, str(tmp_path))  # as another session finds it
    assert found == brute(rows)


def test_lookup_moves_the_batch_alone(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path), rows=5_000)
    df = spark.range(4_000).selectExpr("id seq", "cast(null as string) sha", "xxhash64(id) fp")
    store.append(df, 0)
    stored = store._stored("keys").select(F.col("key").alias("block"), "entry")
    asked = spark.range(50).selectExpr("xxhash64(id + 7) fp")
    asked = rotated(asked, "fp", store.blocks, store.kept)
    plan = asked.hint("shuffle_merge").join(stored, "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_are_verified(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, 5, long), (2, None, 5, "quite another text of some length here"), (3, None, 7, long + " more"), (4, None, 7, None), (5, None, None, long)]
    store = FingerprintStore(spark, str(tmp_path))
    frame = lambda x: spark.createDataFrame(x, "seq long, sha string, fp long, text string")
    store.append(frame([(0, None, 4, long)]), 0)
    assert {r["seq"] for r in store.lookup(frame(rows)).collect()} == {1, 3, 4}


def test_the_history_is_stored_a_few_tables_at_a_time(spark, tmp_path, monkeypatch):
    store = FingerprintStore(spark, str(tmp_path), rows=3_000_000, asked=3_000_000)
    df = spark.range(300).selectExpr("id seq", "cast(id % 7 as string) sha", "xxhash64(id) fp")
    write, sizes = FingerprintStore._write, []
    monkeypatch.setattr(FingerprintStore, "_write", lambda self, rows, *a, **kw: (sizes.append(rows.count()), write(self, rows, *a, **kw)))
    every = comb(store.blocks, store.kept)
    for _ in range(2):  # an attempt made again stores nothing twice
        sizes.clear()
        store.append(df, 0)
        assert every > 7 and max(sizes) <= 7 * 300 + 7 and sum(sizes) == every * 300 + 7
        stored = store._stored("keys")
        assert stored.count() == stored.distinct().count() == every * 300 + 7
    same = store.keys(df).drop("first").withColumn("batch", F.lit(0).cast("long")).select(stored.columns)
    assert same.exceptAll(stored).isEmpty()
    store.close()


def test_more_fingerprints_take_no_more_tables(spark, tmp_path):
    # 7 tables asked 28 of some 500 000 fingerprints and 84 of 100 million
    sizes = (10_000, 500_000, 100_000_000)
    stores = [FingerprintStore(spark, str(tmp_path / str(n)), rows=n, asked=n // 4) for n in sizes]
    assert [comb(s.blocks, s.kept) for s in stores] == [s.blocks for s in stores] and stores[-1].blocks <= 9
    for s in stores:
        s.close()
    rng = random.Random(4)
    for whole in (1, 2, 3):
        masks = choice_masks(6 + whole, whole)
        assert sum(map(len, masks)) == comb(6 + whole, whole) and max(map(len, masks)) * len(masks) < 1.5 * comb(6 + whole, whole)
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 6))
            assert any(signed(bits) & m == 0 for table in masks for m in table)


@pytest.mark.parametrize("way", ["shuffle_hash", "merge"])
def test_choices_of_blocks_against_brute_force(spark, tmp_path, monkeypatch, way):
    monkeypatch.setattr(FingerprintStore, "_way", lambda self, asked: way)
    rows = history(11)
    schema = "seq long, sha string, fp long"
    store = FingerprintStore(spark, str(tmp_path), rows=50_000_000, asked=10_000_000)
    assert store.whole > 1
    store.append(spark.createDataFrame([r for r in rows if r[0] == 0], schema), 0)
    found = [r["seq"] for r in store.lookup(spark.createDataFrame([r for r in rows if r[0] > 0], schema)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    store.close()
