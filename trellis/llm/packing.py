"""Items of varying length in containers of one capacity, by a grouping genetic algorithm.

The items are dealt to groups of bounded size by a hash of their key.  Each group is packed by
several islands, every island a row of its own that any task can work on; a round lets each breed
for some generations.  A genome is a packing; crossover puts some of the best-filled containers
of one parent whole into the other, drops the containers of the other that hold the same items,
and best-fits the displaced ones; mutation opens the emptiest containers.  Between rounds the
islands are a table, and each island's elite moves to the next island of its group by a join, so
islands of one group may be on different executors and a lost one costs its round only.  A group
whose best packing needs no more containers than its sizes do is done.

Containers that a group leaves loose are opened again and their items dealt anew to fewer groups,
until a deal saves no container; so the space lost at the borders of groups doesn't grow with
their number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.runtime import Workspace

#: Items of a group on average: the unit of work, small enough for a row.
GROUP = 1_500
ISLANDS, PEOPLE, GENERATIONS, ROUNDS = 3, 6, 6, 4
#: A container filled to less than this share is loose.
TIGHT = 0.985


def _best_fit(sizes: list[int], capacity: int, items: list[int], bins: list[list[int]]) -> list[list[int]]:
    """Put ``items`` one by one where the least room stays; ``bins`` grows in place."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(room, (left - sizes[i], k))
    return bins


def _fitness(sizes: list[int], capacity: int, bins: list[list[int]]) -> tuple[int, float]:
    """Fewer containers first, then unequal filling, which leaves room in one piece."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def _cross(rng, sizes, capacity, one, two):
    fills = sorted(range(len(two)), key=lambda k: -sum(sizes[i] for i in two[k]))
    take = fills[: max(1, int(len(fills) * rng.uniform(0.2, 0.6)))]
    whole = [two[k] for k in take]
    inside = {i for b in whole for i in b}
    keep, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            keep.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: -sizes[i])
    return _best_fit(sizes, capacity, displaced, [list(b) for b in whole] + keep)


def _mutate(rng, sizes, capacity, bins):
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    n = max(1, min(len(bins), int(rng.integers(1, 5))))
    opened = {*order[:n], int(rng.integers(len(bins)))}
    items = [i for k in opened for i in bins[k]]
    rng.shuffle(items)
    items.sort(key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
    return _best_fit(sizes, capacity, items, [list(b) for k, b in enumerate(bins) if k not in opened])


def found(sizes: list[int], capacity: int, seed: list[int]) -> list[list[list[int]]]:
    """An island's first people: best fit of the items in falling and in shaken orders, the best first."""
    rng = np.random.default_rng(seed)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [_best_fit(sizes, capacity, falling, [])]
    while len(people) < PEOPLE:
        order = sorted(falling, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        people.append(_best_fit(sizes, capacity, order, []))
    return sorted(people, key=lambda b: _fitness(sizes, capacity, b), reverse=True)


def breed(sizes: list[int], capacity: int, people: list[list[list[int]]], seed: list[int], guest: list[list[int]] | None = None, generations: int = GENERATIONS) -> tuple[list[list[list[int]]], int]:
    """(people, crossovers) after some generations, the best first; a guest takes the worst one's place.

    Ends early only once a generation has bred and no packing can have fewer containers.
    """
    rng = np.random.default_rng(seed)
    least = ceil(sum(sizes) / capacity)
    score = lambda b: _fitness(sizes, capacity, b)
    if guest is not None:
        people = sorted([*people[:-1], guest], key=score, reverse=True)
    crossed = 0
    for _ in range(generations):
        one, two = rng.choice(PEOPLE // 2 + 1, 2, replace=False)
        child = _cross(rng, sizes, capacity, people[one], people[two])
        crossed += 1
        people = sorted([*people[:-1], max(child, _mutate(rng, sizes, capacity, child), key=score)], key=score, reverse=True)
        if len(people[0]) <= least:
            break
    return people, crossed


def _places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _bins(places: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(places) + 1)]
    for i, k in enumerate(places):
        out[k].append(i)
    return out


ISLAND = "grp long, island int, sizes array<int>, people array<array<int>>, bins int, least int, crossed int, moved int"


def _round(capacity: int, seed: int, number: int):
    """One round of each island, a row each; ``people`` is null in the first and ``guest`` where none has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                sizes, at = r["sizes"], [seed, r["grp"], r["island"], number]
                people = found(sizes, capacity, at) if r["people"] is None else [_bins(p) for p in r["people"]]
                people, crossed = breed(sizes, capacity, people, [*at, 1], _bins(r["guest"]) if r["guest"] else None)
                rows.append((r["grp"], r["island"], sizes, [_places(b, len(sizes)) for b in people], len(people[0]), ceil(sum(sizes) / capacity), r["crossed"] + crossed, r["moved"] + bool(r["guest"])))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), *[pa.int32()] * 4)
            names = [c.split()[0] for c in ISLAND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def evolve(groups: DataFrame, capacity: int, ws: Workspace, seed: int = 0) -> DataFrame:
    """The islands of each group after the last round: ISLAND's columns, the best packing first in ``people``.

    ``groups`` has ``grp`` (long) and ``sizes`` (array of int between 1 and the capacity, of
    bounded length).  ``crossed`` counts an island's crossovers, ``moved`` the elites it got.
    """
    spread = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    islands = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes")
    fresh = islands.selectExpr("*", "cast(null as array<array<int>>) people", "0 crossed", "0 moved", "cast(null as array<int>) guest").repartition(spread, "grp", "island")
    done: DataFrame | None = None
    for number in range(ROUNDS):
        state = ws.save(fresh.mapInArrow(_round(capacity, seed, number), ISLAND))
        reached = state.groupBy("grp").agg((F.min("bins") <= F.min("least")).alias("reached"))
        marked = state.join(reached, "grp")
        last = number == ROUNDS - 1
        ended = marked.filter(F.lit(last) | F.col("reached")).drop("reached")
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        going = marked.filter(~F.col("reached")).drop("reached")
        elite = going.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("people")[0].alias("guest"))
        fresh = going.drop("bins", "least").join(elite, ["grp", "island"])
        if going.isEmpty():
            break
    return done


def _deal(rest: DataFrame, groups: int, turn: int, capacity: int, ws: Workspace) -> DataFrame:
    """(container, loose, key, part, first, tokens): one deal of the items to groups, each packed by its islands."""
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("key", "part", F.lit(turn)), F.lit(groups)).cast("long"))
    item = F.sort_array(F.collect_list(F.struct("tokens", "key", "part", "first")))
    items = ws.save(dealt.groupBy("grp").agg(item.alias("items")))
    sized = items.select("grp", F.transform("items", lambda i: i["tokens"].cast("int")).alias("sizes"))
    islands = evolve(sized, capacity, ws, turn)
    best = islands.groupBy("grp").agg(F.min_by(F.col("people")[0], F.struct("bins", "island")).alias("places"))
    rows = items.join(best, "grp").select("grp", F.explode(F.arrays_zip("items", "places")).alias("x")).select("grp", "x.items.*", F.col("x.places").alias("place"))
    rows = ws.save(rows)
    full = rows.groupBy("grp", "place").agg((F.sum("tokens") < TIGHT * capacity).alias("loose"))
    name = F.concat_ws("-", F.lit(f"r{turn}"), "grp", "place")
    return ws.save(rows.join(full, ["grp", "place"]).select(name.alias("container"), "loose", "key", "part", "first", "tokens"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container_id string, key, part_no, first, size) for each part of each item.

    ``key`` is a long and unique.  An item is one part unless it exceeds the capacity; then it
    is cut into full parts, each a container of its own, and a rest that is packed like any
    item.  ``first`` is the part's offset in its item.  Items of null, zero or negative size
    need no room: they come out with a null container_id and size 0.  Items without a key are
    left out.  No item gives an empty result; other columns are ignored.
    """
    ws = Workspace(items.sparkSession, "packing")
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)))).alias("k")
    parts = rows.select("key", "n", at).select(
        "key", (F.col("k") + 1).cast("int").alias("part"), (F.col("k") * capacity).alias("first"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("k") * capacity).alias("tokens")
    )
    parts = ws.save(parts)
    none = parts.filter("tokens = 0").selectExpr("cast(null as string) container", "key", "part", "first", "tokens")
    # a full part is a container of its own
    full = parts.filter(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("f"), "key", "part").alias("container"), "key", "part", "first", "tokens")
    done = [none, full]
    rest, turn = parts.filter(F.col("tokens").between(1, capacity - 1)), 0
    n, before = rest.count(), None
    while n:
        groups = ceil(n / GROUP)
        packed = _deal(rest, groups, turn, capacity, ws)
        loose = packed.filter("loose")
        bins, tokens = loose.agg(F.count_distinct("container"), F.sum("tokens")).first()
        done.append(packed.filter("not loose").drop("loose"))
        # one group has seen all that is left, no packing has fewer containers, or the deal has saved none
        if groups == 1 or bins <= ceil((tokens or 0) / capacity) or (before is not None and bins >= before):
            done.append(loose.drop("loose"))
            break
        rest, turn, before = loose.select("key", "part", "first", "tokens"), turn + 1, bins
        n = rest.count()
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.toDF("container_id", key, "part_no", "first", size)
