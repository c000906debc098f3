"""Duplicates of new batches against everything accepted before, by stored block tables.

A fingerprint is a 64-bit string of bit differences, cut into blocks.  Two of them that differ in
at most ``radius`` bits leave ``whole`` = blocks - radius blocks untouched.  There is one table for
each block, of all fingerprints under that block's bits as their key.  Every choice of ``whole``
blocks belongs to the table of one of its blocks; where a batch is looked up, both sides come once
for each choice of their table with these blocks' bits, and the join is on them too.  No pair within
the radius is missed; the Hamming distance is verified, and the texts where both have one.  Then the
batch's own fingerprints are appended.  More fingerprints ask for more choices, which are made where
the rows lie and are neither stored nor moved; of tables there are ``radius`` + ``whole`` only.

The stored tables are bucketed by their key, so a lookup shuffles the batch alone: history is
neither reprocessed nor moved.  An append writes the partition of its batch and replaces what an
earlier attempt has left there.  How many blocks there are sets costs only, never the result.
"""

from __future__ import annotations

import uuid
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.plans.blocks import BITS, choose_blocks, rotated
from trellis.plans.skew import lookup
from trellis.runtime import Workspace, joined_in_place, shuffles_removed

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
#: Rows of one bucket of a stored table.
BUCKET_ROWS = 2_000_000
#: Waiting batches are looked up together up to this share of what is stored.
GATHER = 0.05
#: Tables that an append makes and shuffles at a time.
SLICE = 7
#: Rows of a batch that one task holds for a join by hashes.
HASHED = 500_000
#: Words of a shingle, and the least Jaccard of two texts' shingles.
SHINGLE, TEXT_JACCARD = 5, 0.8


def shingles(text: Column) -> Column:
    """The distinct hashes of a text's five-word shingles; of a shorter text its words; null for null and blank."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(runs))


def choice_masks(blocks: int, whole: int) -> list[list[int]]:
    """The bits of each choice of ``whole`` blocks, as signed numbers, by the table that it belongs to, none having half as many again as the mean."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks: list[list[int]] = [[] for _ in range(blocks)]
    for chosen in combinations(range(blocks), whole):
        mask = sum((1 << BITS - edges[b]) - (1 << BITS - edges[b + 1]) for b in chosen)
        masks[min(chosen, key=lambda b: len(masks[b]))].append(mask - (1 << BITS) if mask >> BITS - 1 else mask)
    return masks


class FingerprintStore:
    """Block tables kept under ``path``: look a batch up, then append it.

    Batches have ``seq`` (of any type that has an order), ``sha``, ``fp`` (long; both null where unusable) and perhaps
    ``text``; other columns are ignored.  A row repeats a stored one, or one of its batch with a
    lower ``seq``, that has its ``sha``, or an ``fp`` at most ``radius`` bits from its own and, if
    both have a text, a text of Jaccard TEXT_JACCARD or more by five-word shingles.  Rows without
    either key repeat nothing; a row given twice repeats itself no more than once; an empty batch has no duplicates.

    ``rows`` and ``asked`` are about the fingerprints to be stored and looked up in all.  Copies
    of a fingerprint are one entry of a batch, however many rows have it.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = 6, rows: int = 100_000, asked: int = 10_000, sha: str = "string"):
        self.spark, self.path, self.radius = spark, path, radius
        # blocks kept by a table's key, and by a choice
        (self.blocks, self.whole), self.kept = choose_blocks(rows, asked, radius), 1
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(least, ceil(rows * comb(self.blocks, self.kept) / BUCKET_ROWS))
        kinds = {"keys": f"key bigint, entry bigint, sha {sha}", "texts": "key bigint, marks array<bigint>"}
        self.names = {}
        for name, columns in kinds.items():
            self.names[name] = f"trellis_{name}_{uuid.uuid4().hex}"
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
            spark.sql(
                f"create table {self.names[name]} ({columns}, batch bigint) using parquet partitioned by (batch) "
                f"clustered by (key) sorted by (key) into {self.buckets} buckets location '{path}/{name}'"
            )
            spark.sql(f"alter table {self.names[name]} recover partitions")

    def _stored(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def _write(self, df: DataFrame, name: str, number: int, more: bool = False) -> None:
        columns = [c for c in self._stored(name).columns if c != "batch"]
        rows = df.select(*columns, F.lit(number).cast("bigint").alias("batch")).repartition(self.buckets, "key").sortWithinPartitions("key")
        before = self.spark.conf.get(OVERWRITE)
        self.spark.conf.set(OVERWRITE, "dynamic")  # replaces the batch's partition alone
        try:
            with shuffles_removed(self.spark):
                rows.write.mode("append" if more else "overwrite").insertInto(self.names[name])
        finally:
            self.spark.conf.set(OVERWRITE, before)

    def _rows(self, batch: DataFrame) -> DataFrame:
        marks = shingles(F.col("text")) if "text" in batch.columns else F.lit(None).cast("array<bigint>")
        return batch.select("seq", "sha", "fp", marks.alias("marks")).filter("seq is not null")

    def _entries(self, rows: DataFrame) -> DataFrame:
        return rows.filter("fp is not null").groupBy(F.col("fp").alias("entry")).agg(F.min("seq").alias("first"))

    def _keys(self, entries: DataFrame, rows: DataFrame, tables: range | None = None) -> DataFrame:
        """The rows of all tables, or of some; the sha's are with the first table."""
        fps = rotated(entries, "entry", self.blocks, self.kept, tables).drop("rotated").withColumnRenamed("block", "key").withColumn("sha", F.lit(None).cast(rows.schema["sha"].dataType))
        if tables and tables.start:
            return fps
        shas = rows.filter("sha is not null").groupBy("sha").agg(F.min("seq").alias("first"))
        key = F.xxhash64("sha").bitwiseAND(F.lit((1 << 56) - 1)).bitwiseOR(F.lit(127 << 56))
        return fps.unionByName(shas.withColumn("key", key), allowMissingColumns=True)

    def keys(self, batch: DataFrame) -> DataFrame:
        """(key, entry, sha, first): the batch's rows of the tables, a sha's key being its hash."""
        rows = self._rows(batch)
        return self._keys(self._entries(rows), rows)

    def append(self, batch: DataFrame, number: int, keys: DataFrame | None = None) -> None:
        """Store ``batch`` as number ``number``; the same number again replaces what it stored before.

        Without ``keys`` the tables are made a few at a time, so that the disk holds their shuffle
        alone.  The first few replace an earlier attempt: a table lacks no fingerprint, so they
        are empty only if all are.
        """
        if keys is not None:
            self._write(keys, "keys", number)
        else:
            ws, rows = Workspace(self.spark, "append"), self._rows(batch)
            entries, every = ws.save(self._entries(rows)), comb(self.blocks, self.kept)
            step = ceil(every / ceil(every / SLICE))
            for start in range(0, every, step):
                self._write(self._keys(entries, rows, range(start, min(start + step, every))), "keys", number, more=start > 0)
            ws.clear()
        if "text" in batch.columns:
            self._write(self._rows(batch).filter("fp is not null").select(F.col("fp").alias("key"), "marks").distinct(), "texts", number)

    def _alike(self, a: Column, b: Column) -> Column:
        """Two texts' shingles, or at least one without a text (null or none)."""
        shared = F.size(F.array_intersect(a, b))
        return a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0) | (shared >= TEXT_JACCARD * (F.size(a) + F.size(b) - shared))

    def _chosen(self, rows: DataFrame, fp: str) -> DataFrame:
        """``rows`` of the tables once for each choice of their table, with its bits as ``chosen``; a sha's row once."""
        masks = F.get(F.lit(choice_masks(self.blocks, self.whole)), F.shiftrightunsigned("key", 56).cast("int"))
        rows = rows.withColumn("mask", F.explode(F.coalesce(masks, F.array(F.lit(0).cast("bigint")))))
        return rows.withColumn("chosen", F.xxhash64("mask", F.col(fp).bitwiseAND(F.col("mask")))).drop("mask")

    def _way(self, asked: DataFrame) -> str:
        """A join by hashes of the batch, which leaves history unsorted; one that may spill, if much of the batch meets in one task."""
        most = asked.groupBy(F.pmod(F.hash("key"), F.lit(self.buckets))).count().agg(F.max("count")).first()[0] or 0
        return "shuffle_hash" if most * max(map(len, choice_masks(self.blocks, self.whole))) <= HASHED else "merge"

    def lookup(self, batch: DataFrame, keys: DataFrame | None = None, rows: int = 0) -> DataFrame:
        """The ``seq`` of the batch's rows that repeat a stored row or an earlier row of the batch.

        ``keys`` is ``keys(batch)`` where it is at hand, ``rows`` about the batch's size.
        """
        ws = Workspace(self.spark, "history")
        asked, batch_rows = keys or ws.save(self.keys(batch)), self._rows(batch)
        near = (F.col("sha") == F.col("s")) | (F.bit_count(F.col("entry").bitwiseXOR(F.col("other"))) <= self.radius)
        first = [F.max("old").alias("old"), F.min("since").alias("since")]
        # both sides are parted by the key, as the tables' buckets are: only the batch is shuffled
        stored = self._stored("keys").select("key", F.col("sha").alias("s"), F.col("entry").alias("other"), F.lit(True).alias("old"), F.lit(None).cast(asked.schema["first"].dataType).alias("since"))
        there = asked.repartition(self.buckets, "key")
        own = there.select("key", F.col("sha").alias("s"), F.col("entry").alias("other"), F.lit(False).alias("old"), F.col("first").alias("since"))
        ours = self._chosen(there.drop("first"), "entry").hint(self._way(asked))
        met = [ours.join(self._chosen(side, "other"), ["key", "chosen"]).filter(near).select("entry", "sha", "other", "old", "since") for side in (stored, own)]
        met = met[0].unionByName(met[1])
        with joined_in_place(self.spark):
            met = ws.save(met.distinct() if "text" in batch.columns else met.groupBy("entry", "sha").agg(*first))
        earlier = F.col("old") | (F.col("since") < F.col("seq"))
        since = met.filter("sha is not null").groupBy("sha").agg(*first)
        found = lookup(batch_rows.filter("sha is not null").select("seq", "sha"), since, "sha", rows).filter(earlier).select("seq")
        some = batch_rows.filter("fp is not null").select("seq", F.col("fp").alias("entry"), "marks")
        near = met.filter("entry is not null")
        if "text" in batch.columns:
            texts = self._stored("texts").select(F.col("key").alias("other"), F.col("marks").alias("theirs"))
            theirs = some.select(F.col("entry").alias("other"), F.col("seq").alias("since"), F.col("marks").alias("theirs"))
            old = near.filter("old").select("entry", "other", "old", "since").join(texts, "other")
            new = near.filter("not old").select("entry", "other", "old").distinct().join(theirs, "other")
            alike = some.join(old.unionByName(new), "entry").filter(earlier & self._alike(F.col("marks"), F.col("theirs")))
        else:
            alike = lookup(some.drop("marks"), near.drop("sha"), "entry", rows).filter(earlier)
        out = ws.save(found.unionByName(alike.select("seq")).distinct())
        ws.drop(met)
        if keys is None:
            ws.drop(asked)
        return out

    def close(self) -> None:
        """Forget the tables; their files stay for the next store at this path."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")


def mark_duplicates(rows: DataFrame, radius: int = 6) -> DataFrame:
    """The ``seq`` of each row that repeats an earlier one, worked out batch by batch through a store.

    ``rows`` has ``batch`` (int; the least one is the accepted history and never reported),
    ``seq`` (long, the order within a batch), ``sha`` and ``fp``, perhaps ``text``.  A lookup reads
    the stored tables once, so batches that wait together are looked up together, in their order,
    until they hold GATHER of what is stored; that changes no result.  An empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "batches")
    columns = ["batch", "seq", "sha", "fp", *(["text"] if "text" in rows.columns else [])]
    rows = ws.save(rows.select(*columns).filter("batch is not null and seq is not null").distinct())
    numbers = [tuple(r) for r in rows.groupBy("batch").agg(F.count("*")).orderBy("batch").collect()]
    total = sum(n for _, n in numbers)
    asked = total - (numbers[0][1] if numbers else 0)
    store = FingerprintStore(spark, f"{ws.root}/store", radius, max(total, 1), max(asked, 1), rows.schema["sha"].dataType.simpleString())
    out = rows.filter("false").select("seq")
    ordered = rows.withColumn("seq", F.struct("batch", "seq"))
    steps, stored = [], 0
    for i, (number, n) in enumerate(numbers):
        if i < 2 or steps[-1][2] >= GATHER * stored:
            stored += steps[-1][2] if steps else 0
            steps.append([number, number, 0])
        steps[-1][1:] = number, steps[-1][2] + n
    for i, (low, high, n) in enumerate(steps):
        batch = ordered.filter(F.col("batch").between(low, high))
        if not i:  # nothing is looked up, so its tables needn't be kept beside the store
            if len(steps) > 1:
                store.append(batch, high)
            continue
        keys = ws.save(store.keys(batch))
        out = out.unionByName(store.lookup(batch, keys, n).select("seq.seq"))
        if i < len(steps) - 1:
            store.append(batch, high, keys)
        ws.drop(keys)
    out = ws.save(out.distinct())
    store.close()
    ws.drop(rows)
    return out
