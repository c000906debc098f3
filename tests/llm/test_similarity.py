import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm.canonical import canonical, prefix_join
from trellis.llm import nearest
from trellis.llm.nearest import similar_vectors, usable
from trellis.llm.similar_sets import similar_records, similar_sets


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets_of(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            s = set(rng.choice(out))
            for _ in range(rng.randrange(3)):
                s ^= {rng.choice(words)}
        else:
            s = set(rng.sample(words, rng.randrange(5, 16)))
        out.append(frozenset(s))
    return [s for s in dict.fromkeys(out) if s]


@pytest.mark.parametrize("crowd", [400, 3])
def test_set_pairs_against_brute_force(spark, crowd):
    sets = sets_of(crowd)
    df = spark.createDataFrame([(i, sorted(s), "clash") for i, s in enumerate(sets)], "set_id long, terms array<string>, place string")
    found = [(r["set_a"], r["set_b"]) for r in similar_sets(df, 0.8, crowd=crowd).collect()]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i], sets[j]) >= 0.8}
    assert len(found) == len(set(found)) and set(found) == true


def test_records_classes_and_dirt(spark):
    rows = [
        (1, ["A ", "b", "c", None], ["d", "e", ""]), (2, ["a", "B", "c", "d"], ["e", "e"]), (3, None, None), (4, [], ["x"]), (5, ["a", "b", "c", "d"], ["e", "f"]), (1, ["A ", "b", "c", None], ["d", "e", ""]), (None, ["a", "b", "c", "d"], ["e"]),
    ]
    df = spark.createDataFrame(rows, "k long, t array<string>, m array<string>")
    members, pairs = similar_records(df, "k", ["t", "m"])
    assert {(r["k"], r["set_id"]) for r in members.collect()} == {(1, 1), (2, 1), (5, 5)}
    assert [(r["set_a"], r["set_b"]) for r in pairs.collect()] == [(1, 5)]
    members, pairs = similar_records(df.limit(0), "k", ["t", "m"])
    assert members.count() == pairs.count() == 0


def vectors_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    x = np.concatenate([base, base[rng.integers(0, len(base), n - len(base))] + 0.25 * rng.standard_normal((n - len(base), dims))])
    return x.astype("f4")


def test_vectors_against_brute_force(spark):
    x = vectors_of(1, 1200, 48)
    rows = [(i, i % 2, [float(c) for c in v], "clash") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:50], "id long, grp int, v array<float>, key string")
    found = [(r["vec_a"], r["vec_b"]) for r in similar_vectors(df).collect()]
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    true = set()
    for i in range(len(x)):
        near = [j for j in range(len(x)) if j != i and i % 2 == j % 2 and s[i, j] >= 0.8]
        true |= {(min(i, j), max(i, j)) for j in sorted(near, key=lambda j: (-s[i, j], j))[:5]}
    assert len(found) == len(set(found))
    assert len(set(found) & true) / len(true) >= 0.99
    assert len(set(found) - true) <= 0.01 * len(true)


def test_trees_grow_slowly_with_the_vectors():
    # sides of hyperplanes asked 33 trees of 145 000 vectors and 272 of 62 million
    trees = [nearest.tree_count(nearest.prefix_bits(n), 0.8, 0.97) for n in (145_000, 62_000_000)]
    assert trees[0] <= 16 and trees[1] <= 70
    # and the probability they are reckoned with is that of the keys
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for dims, digits in ((8, [3]), (24, [10]), (96, [7, 3])):
        x = unit(rng.standard_normal((400, dims)))
        y = rng.standard_normal((400, dims))
        y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        same = 0
        for t in range(60):
            ways = nearest._directions(dims, t, digits)
            a, b = (nearest._key(v.astype("f4"), ways, digits) for v in (x, 0.8 * x + 0.6 * y))
            same += (a == b).mean() / 60
        assert abs(same - nearest.meet(digits, 0.8)) < 0.02


def test_a_sketch_moves_once_a_tree(spark, monkeypatch):
    x = vectors_of(6, 1200, 24)
    vectors = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in enumerate(x)], "id long, grp int, v array<float>")
    save, plans = nearest.Workspace.save, []
    monkeypatch.setattr(nearest.Workspace, "save", lambda ws, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(ws, df))[1])
    assert similar_vectors(vectors).count()
    passes = -(-nearest.tree_count(nearest.prefix_bits(1200), 0.8, 0.97) // nearest.PASS)
    # no arrays besides those compared: the bounds come from the same ones, and are joined to nothing
    assert len([p for p in plans if "Exchange hashpartitioning(grp" in p and "MapInArrow" in p]) == passes
    assert not [p for p in plans if "keys#" in p and "Join" in p]


@pytest.mark.parametrize("n", [4, 6, 7, 300])
def test_bounds_from_the_longest_prefixes(n):
    bits = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype("u8")
    got = nearest._reached(bits, 6)
    for i in range(n):
        seen = sorted(int(np.bitwise_count(bits[i] ^ bits[j]).sum()) for j in range(max(0, i - nearest.LOOK), min(n, i + nearest.LOOK + 1)) if j != i)
        assert got[i] == (seen[5] if len(seen) > 5 else nearest.SKETCH_BITS)


def test_a_vector_moves_once_and_not_with_each_pair(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((30, 16)), 20, axis=0) + 0.05 * rng.standard_normal((600, 16))
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")
    pairs = [(a, b) for a in range(600) for b in range(a + 1, 600) if a // 20 == b // 20 or (a + b) % 97 == 0]
    ws, plans = nearest.Workspace(spark, "test"), []
    save = ws.save
    ws.save = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(df))[1]
    found = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in nearest._scored(spark.createDataFrame(pairs, "vec_a long, vec_b long"), vectors, 0.8, ws).collect()}
    u = x.astype("f4").astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = {(a, b): u[a] @ u[b] for a, b in pairs if u[a] @ u[b] >= 0.8}
    assert found.keys() == true.keys() and all(abs(found[p] - true[p]) < 1e-9 for p in true)
    assert not [line for line in plans[-1].splitlines() if "Exchange hashpartitioning(vec_" in line]
    ws.clear()


def test_vectors_equal_and_few(spark):
    same = spark.range(41).select(F.when(F.col("id") < 40, F.col("id")).alias("id"), F.lit(1).alias("grp"), F.array(*(F.lit(float(i)) for i in range(8))).cast("array<float>").alias("v"))
    got = {(r["vec_a"], r["vec_b"]) for r in similar_vectors(same, k=2).collect()}
    assert (0, 1) in got and (0, 2) in got and all(a in (0, 1) for a, _ in got)
    assert similar_vectors(same.limit(0)).count() == 0
    assert similar_vectors(same.limit(1)).count() == 0
    assert similar_vectors(same.withColumn("v", F.lit(None).cast("array<float>"))).count() == 0


def test_vectors_in_crowds(spark):
    # a third copies and near copies: 700 copies of one vector, 700 near copies of another
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4200, 24))
    x[:700] = x[0]
    x[700:1400] = x[700] + 0.1 * rng.standard_normal((700, 24))
    x = x.astype("f4")[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in enumerate(x)], "id long, grp int, v array<float>")
    found = {(r["vec_a"], r["vec_b"]) for r in similar_vectors(df).collect()}
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    true = set()
    for i in range(len(x)):
        near = [j for j in np.flatnonzero(s[i] >= 0.8) if j != i]
        true |= {(min(i, int(j)), max(i, int(j))) for j in sorted(near, key=lambda j: (-s[i, j], j))[:5]}
    assert len(found & true) / len(true) >= 0.99
    assert len(found - true) <= 0.01 * len(true)


def test_usable_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [r["id"] for r in df.filter(usable(F.col("v"), F.lit(2))).collect()] == [1]


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8])
def test_prefix_join_against_brute_force(spark, threshold):
    rng = random.Random(2)
    make = lambda n: [{rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 8))} for _ in range(n)]
    left, right = make(90), make(60)
    table = lambda sets: spark.createDataFrame([(f"{i}", sorted(s)) for i, s in enumerate(sets)], "id string, set array<string>")
    got = {(int(r["l"]), int(r["r"])): r["jaccard"] for r in prefix_join(table(left), table(right), threshold).collect()}
    true = {(i, j): jaccard(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and jaccard(a, b) >= threshold}
    assert set(got) == set(true) and all(abs(got[k] - true[k]) < 1e-9 for k in true)


CATALOG = [(1, "Lumen Wreath", "PLMN-2020"), (2, "Lumen Bowl", "PLMN-2522"), (3, "The Ivoryn Bowl", "PTHV-1408"), (4, "Peony", None), (5, "Sweet Pea", "FSWT-8829"), (6, "Sage Kestrelle Bouquet", ""), (7, "Narcissus", "x-1"), (8, "Tamsin Vase", "PTMS-9967")]


def test_values_to_entries(spark):
    expect = {
        "lumen wraeth": 1, "WREATH, LUMEN": 1, "LumenBowl": 2, "plmn 2522": 2, "The Ivoryn": 3, "ivoryn - Large": 3, "Ivoryn Bwl": 3, "peonies x12": 4, "pale pink Peony (3 stems)": 4, "sweetpea": 5, "swe etpea": 5,
        "Kestrelle Bqt.": 6, "narcissuses": 7, "Lumen": None, "Ivoryn Vase": None, "linen tablecloth": None, "n/a": None, "Zuqbolu Bowl": None, "x" * 5000: None,
    }
    ref = spark.createDataFrame(CATALOG, "product_id long, name string, sku string")
    values = spark.createDataFrame([(v, 0) for v in [*expect, *expect, None, "", "  "]], "value string, entry int")
    got = {r["value"]: r["entry"] for r in canonical(values, "value", ref, "product_id", "name", "sku").collect()}
    assert got == expect


def test_values_without_a_list_or_values(spark):
    ref = spark.createDataFrame(CATALOG, "product_id long, name string, sku string")
    values = spark.createDataFrame([("Peony",)], "v string")
    assert [tuple(r) for r in canonical(values, "v", ref.limit(0), "product_id", "name", "sku").collect()] == [("Peony", None)]
    assert canonical(values.limit(0), "v", ref, "product_id", "name", "sku").count() == 0
