"""All pairs of records whose sets overlap strongly, by sorted sketch forests.

Each distinct set gets minhash signatures.  A tree orders the sets by one signature string;
sets that share a prefix of it are neighbours, and a pair of Jaccard J shares ``d`` leading
values with probability J**d.  A level therefore uses so many independent trees that a pair
at the threshold is met with the target recall:

    trees(d) = ceil(log(1 - recall) / log(1 - threshold**d))

Neighbourhoods of up to ``crowd`` sets are compared.  Sets of a larger one go on to the next
level, where longer prefixes in fresh, more numerous trees part them, until the last depth;
what still crowds there is compared in full, in blocks over many tasks.  No neighbourhood
is cut short.  A 64-bit mark, one bit for each term's hash, travels along: marks can't differ
in more bits than their sets do in terms, which rules strangers out where they meet.  Every
pair that is left is verified on the sets themselves.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.runtime import Workspace

LAST_DEPTH = 12
SALTS = 16
#: Jaccard of two strangers, as assumed for the first depth; it sets costs, not results.
STRANGERS = 0.04


def depths(sets: int) -> list[int]:
    """The first leaves a set about ten strangers a tree; the others part what still crowds."""
    first = max(2, round(log(max(sets, 20) / 10) / log(1 / STRANGERS)))
    return [first, *range(first + 1, first + 4), *range(first + 6, max(LAST_DEPTH, first + 7), 3)]


def trees(depth: int, threshold: float, recall: float) -> int:
    return ceil(log(1 - recall) / log(1 - threshold**depth))


def _prefixes(sets: DataFrame, depth: int, count: int) -> DataFrame:
    """(set_id, size, mark, place) for each tree; place is the tree and the prefix, as a hash."""
    value = lambda t, i: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(1000 * depth + t), F.lit(i))))
    places = F.array(*(F.xxhash64(F.lit(t), *(value(t, i) for i in range(depth))) for t in range(count)))
    return sets.select("set_id", "size", "mark", F.explode(places).alias("place"))


def similar_sets(sets: DataFrame, threshold: float = 0.8, recall: float = 0.99999, crowd: int = 400) -> DataFrame:
    """(set_a, set_b) with set_a < set_b for each pair of sets of Jaccard >= threshold.

    ``sets`` has ``set_id`` (long, unique) and ``terms`` (array of distinct strings, no two
    rows alike).  Empty and null sets have no pairs; other columns are ignored.  The result
    is free of false pairs and, for the given recall, misses at most that share of true ones.
    """
    ws = Workspace(sets.sparkSession, "sets")
    hashed = sets.filter("size(terms) > 0").select("set_id", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"))
    mark = F.aggregate("hashes", F.lit(0).cast("bigint"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))))
    base = ws.save(hashed.select("set_id", "hashes", F.size("hashes").alias("size"), mark.alias("mark")))
    least = F.lit(threshold)
    # |A - B| + |B - A| of a pair at the threshold, as a share of |A| + |B|
    apart = (1 - threshold) / (1 + threshold)
    plan = depths(base.count())
    level, found, kept = base, None, []
    for n, depth in enumerate(plan):
        rows = ws.save(_prefixes(level, depth, trees(depth, threshold, recall)))
        kept.append(rows)
        sizes = rows.groupBy("place").agg(F.count("*").alias("n"))
        last = n == len(plan) - 1
        small = sizes.filter((F.col("n") > 1) if last else F.col("n").between(2, crowd))
        near = rows.join(small.select("place"), "place")
        a = near.select("place", F.col("set_id").alias("set_a"), F.col("size").alias("size_a"), F.col("mark").alias("mark_a"))
        b = near.select("place", F.col("set_id").alias("set_b"), F.col("size").alias("size_b"), F.col("mark").alias("mark_b"))
        if last:
            # blocks of one crowded place go to many tasks
            a = a.withColumn("salt", F.pmod(F.col("set_a"), F.lit(SALTS)))
            b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = a.join(b, ["place", "salt"] if last else "place").filter(
            (F.col("set_a") < F.col("set_b"))
            & (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - F.lit(1e-9))
            & (F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b"))) <= F.lit(apart) * (F.col("size_a") + F.col("size_b")) + F.lit(1e-9))
        )
        pairs = ws.save(met.select("set_a", "set_b").distinct())
        kept.append(pairs)
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        crowded = rows.join(sizes.filter(F.col("n") > crowd).select("place"), "place", "left_semi").select("set_id").distinct()
        level = ws.save(base.join(crowded, "set_id", "left_semi"))
        kept.append(level)
        if level.isEmpty():
            break
    side = lambda x: base.select(F.col("set_id").alias(f"set_{x}"), F.col("hashes").alias(f"h_{x}"))
    both = found.distinct().join(side("a"), "set_a").join(side("b"), "set_b")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    exact = shared >= least * (F.size("h_a") + F.size("h_b") - shared) - F.lit(1e-9)
    out = ws.save(both.filter(exact).select("set_a", "set_b"))
    for df in (base, *kept):
        ws.drop(df)
    return out


def record_sets(records: DataFrame, key: str, arrays: list[str], least_terms: int) -> DataFrame:
    """(key, terms): the set of each record.

    Terms are trimmed and lower-cased; null, blank and repeated ones don't count.  Records of
    fewer than ``least_terms`` terms are left out, and so are those without a key.  Rows of one key count once.
    """
    trimmed = lambda t: F.regexp_replace(F.lower(t), r"(?U)^\s+|\s+$", "")
    parts = [F.coalesce(F.transform(a, trimmed), F.array().cast("array<string>")) for a in arrays]
    terms = F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda t: t.isNotNull() & (t != ""))))
    return records.select(key, terms.alias("terms")).filter((F.size("terms") >= least_terms) & F.col(key).isNotNull()).dropDuplicates([key])


def similar_records(records: DataFrame, key: str, arrays: list[str], threshold: float = 0.8, least_terms: int = 5) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (key, set_id) of each record, and the pairs of different sets that are similar.

    Copies of one set are one class, so they aren't spelled out as pairs here.
    """
    ws = Workspace(records.sparkSession, "records")
    named = ws.save(record_sets(records, key, arrays, least_terms))
    sets = ws.save(named.groupBy("terms").agg(F.min(key).alias("set_id")))
    members = ws.save(named.join(sets, "terms").select(key, "set_id"))
    ws.drop(named)
    return members, similar_sets(sets, threshold)
