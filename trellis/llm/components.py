"""Group identifiers from pairwise links, by randomised contraction.

Each round every vertex hooks to the member of its closed neighbourhood that is first in a
fresh pseudo-random order.  Edges are renamed to the representatives, loops and doubles go,
and the rounds repeat until no edge is left.  A round removes a constant share of the
vertices in expectation, whatever the graph's shape (long chains included), so the number
of rounds is logarithmic and all rounds together move a constant multiple of the edges.
Links that one task takes are settled in one more round by union-find, as each further round
would cost the driver several queries for a handful of links.  The mappings of the rounds
are then expanded from the last back to the first.

The smallest member of each contracted vertex is carried along, so no group is ever
gathered in one place to find its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from trellis.plans.skew import lookup
from trellis.runtime import Workspace


#: Links, each in both directions, that one task settles.
ONE_TASK = 100_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, r): each vertex of the links (u, v) with one of its group, the same for all of the group."""
    above: dict = {}

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            above[top(a)] = top(b)
    if above:
        members = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(members, kind), pa.array([top(x) for x in members], kind)], names=["u", "r"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", seed: int = 20_240_101, one_task: int = ONE_TASK) -> DataFrame:
    """One row (``id``, ``group_id``) for each vertex of a link; group_id is the least id.

    Links are undirected.  Rows with a null end and links of a vertex to itself don't count,
    repeated links count once, extra columns are ignored.  No link gives an empty result.
    ``one_task`` sets how many links a single task settles; results don't depend on it.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "components")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    e = ws.save(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    n = e.count()
    kind = e.schema["u"].dataType
    if kind not in (StringType(), BinaryType(), LongType(), IntegerType()):  # equal in Python just where they are in Spark
        one_task = 0
    hooks: list[DataFrame] = []  # of each round: (u, r)
    leasts: list[DataFrame] = []  # of each round's representatives: (u, least), the least original member
    while n:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed + len(hooks))).alias("h"), c.alias("w"))
        last = n <= one_task
        if last:
            hook = ws.save(e.coalesce(1).mapInArrow(_settle, f"u {kind.simpleString()}, r {kind.simpleString()}"))
        else:
            best = e.groupBy("u").agg(F.min(order(F.col("v"))).alias("b"))
            hook = ws.save(best.select("u", F.least(F.col("b"), order(F.col("u")))["w"].alias("r")))
        member = hook.withColumn("least", F.col("u")) if not leasts else hook.join(leasts[-1], "u")
        least = ws.save(member.groupBy(F.col("r").alias("u")).agg(F.min("least").alias("least")))
        if last:
            hooks.append(hook)
            leasts.append(least)
            break
        by_v = lookup(e, hook.select("u", F.col("r").alias("ru")), "u", n).select("ru", "v")
        renamed = lookup(by_v, hook.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v", n)
        after = ws.save(renamed.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        ws.drop(e)
        hooks.append(hook)
        leasts.append(least)
        e, n = after, after.count()
    if not hooks:
        return e.select(F.col("u").alias("id"), F.col("u").alias("group_id"))
    # a representative without a further edge is a whole group; the others get their own representative's group
    groups = leasts[-1].select(F.col("u").alias("r"), F.col("least").alias("group_id"))
    for i in range(len(hooks) - 1, -1, -1):
        named = lookup(hooks[i], groups, "r", hooks[i].count()).select(F.col("u").alias("r"), "group_id")
        if i:
            whole = leasts[i - 1].join(hooks[i], "u", "left_anti").select(F.col("u").alias("r"), F.col("least").alias("group_id"))
            named = named.unionByName(whole)
        groups = named
    out = ws.save(groups.select(F.col("r").alias("id"), "group_id"))
    for df in (*hooks, *leasts, e):
        ws.drop(df)
    return out
