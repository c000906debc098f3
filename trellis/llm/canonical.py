"""Free-entered values mapped to the entries of a reference list.

Two set-similarity joins by prefix filter.  The first maps what a value is made of, its words
and adjoining words run together, to the words of the list: sets of letter pairs, ordered by
global rarity, joined on their rare prefixes, filtered by length and position, verified by
exact Jaccard and edit distance.  The second maps the words so found to the entries: an entry
is met through its rarest word, verified by exact Jaccard of the word sets, the best is kept.
Words that mean nothing to the list (sizes, counts, "assorted") drop out between the two.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.plans.skew import lookup
from trellis.runtime import Workspace

# Words that name nothing.
EMPTY_WORDS = frozenset({"the", "a", "an", "of", "in", "and"})
#: Least Jaccard of two words' letter pairs, and of a value's and an entry's words.
WORD_JACCARD, ENTRY_JACCARD = 0.25, 0.4

_CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")


def stem(word: str) -> str:
    """The singular of an English plural; other words stay."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("ses", "xes", "ches", "shes")) and not word.endswith(("oses", "ases", "uises")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def words(text: str) -> list[tuple[str, bool]]:
    """(word, whether it ends in a period) in order: no accents, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    out = []
    for m in _WORD.finditer(_CAMEL.sub(" ", plain)):
        w = m.group().lower().replace("'", "").replace("’", "")
        short = w.endswith(".")
        out.append((w.rstrip("."), short))
    return [(w, s) for w, s in out if w]


def skeleton(word: str) -> str:
    """The word without its vowels, but for a leading one."""
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def units(text: str) -> list[tuple[str, int, bool]]:
    """(unit, words in it, whether an abbreviation): each word, and up to four neighbours run together."""
    ws = words(text)
    found = [(stem(w), 1, s) for w, s in ws]
    for n in (2, 3, 4):
        found += [(stem("".join(w for w, _ in ws[i : i + n])), n, False) for i in range(len(ws) - n + 1)]
    return list(dict.fromkeys(found))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, *u) for v in batch.column(0).to_pylist() for u in units(v)]
        columns = [[r[i] for r in rows] for i in range(4)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([skeleton(u) for u in columns[1]], pa.string())],
            names=["value", "unit", "width", "short", "bones"],
        )


UNITS = "value string, unit string, width int, short boolean, bones string"


def _reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, unit, terms): what stands for each entry's words: one word, several run together, or its code."""
    for batch in batches:
        rows = []
        for entry, name, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = [w for w, _ in words(name or "")]
            terms = [stem(w) for w in own if w not in EMPTY_WORDS]
            rows += [(entry, w, [w], False) for w in terms]
            runs = {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 2, len(own) + 1)}
            rows += [(entry, stem("".join(r)), [stem(w) for w in r if w not in EMPTY_WORDS], False) for r in sorted(runs)]
            plain = re.sub(r"[\W_]", "", code or "").lower()
            if plain:
                rows.append((entry, plain, terms, True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.bool_()), pa.array([skeleton(r[1]) for r in rows], pa.string())],
            names=["entry", "ref", "terms", "code", "bones"],
        )


def letter_pairs(c: Column) -> Column:
    """The distinct pairs of neighbouring letters, the ends counting as letters."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def prefix_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, jaccard) of all pairs of sets with Jaccard >= threshold.

    Both sides have a unique ``id`` and ``set`` (array of distinct strings).  Tokens are ordered
    by their frequency on both sides, rarest first.  A set of n tokens that is similar to
    another shares one of its first n - ceil(threshold n) + 1 tokens with the other's; pairs
    met there must fit in length, and in what their positions leave to share.  Empty sets have
    no pair.
    """
    both = left.select("set").unionByName(right.select("set"))
    rarity = both.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        tokens = df.select("id", F.size("set").alias("size"), F.explode("set").alias("token")).join(rarity, "token")
        order = F.row_number().over(Window.partitionBy("id").orderBy("n", "token"))
        keep = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
        cut = tokens.withColumn("place", order).filter(F.col("place") <= keep)
        return cut.select("token", F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("place").alias(f"{side}_place"))

    met = prefixes(left, "l").join(prefixes(right, "r"), "token")
    need = F.lit(threshold / (1 + threshold)) * (F.col("l_size") + F.col("r_size")) - 1e-9
    rest = F.least(F.col("l_size") - F.col("l_place"), F.col("r_size") - F.col("r_place")) + F.least("l_place", "r_place")
    lengths = (F.col("l_size") >= F.lit(threshold) * F.col("r_size") - 1e-9) & (F.col("r_size") >= F.lit(threshold) * F.col("l_size") - 1e-9)
    pairs = met.filter(lengths & (rest >= need)).select("l", "r").distinct()
    sets = lambda df, side: df.select(F.col("id").alias(side), F.col("set").alias(f"{side}_set"))
    both = pairs.join(sets(right, "r"), "r").join(sets(left, "l"), "l")
    shared = F.size(F.array_intersect("l_set", "r_set"))
    jaccard = shared / (F.size("l_set") + F.size("r_set") - shared)
    return both.select("l", "r", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)


def canonical(values: DataFrame, value: str, reference: DataFrame, entry: str, name: str, code: str) -> DataFrame:
    """(value, entry): the entry each distinct value means, null where it means none.

    ``reference`` has a unique long ``entry``, its ``name`` and a ``code`` (null where it has
    none).  A value means the entry whose words it shares best, if it holds that entry's rarest
    word and at least ENTRY_JACCARD of all words of both, or nothing but words of it; if two
    entries fit equally well, it means none.  Null and blank values are left out.  An empty
    reference leaves every value without an entry.
    """
    ws = Workspace(values.sparkSession, "canonical")
    text = F.col(value)
    distinct = ws.save(values.filter(F.regexp_replace(text, r"(?U)\s+", "") != "").select(text.alias("value")).distinct())
    typed = ws.save(distinct.mapInArrow(_units, UNITS))
    refs = ws.save(reference.select(F.col(entry).cast("long"), name, code).mapInArrow(_reference, "entry long, ref string, terms array<string>, code boolean, bones string"))
    known = ws.save(refs.groupBy("ref", "bones").agg(F.min("terms").alias("terms"), F.max("code").alias("code")))
    asked = ws.save(typed.groupBy("unit", "bones").agg(F.min("width").alias("width"), F.max("short").alias("short")))
    # a word of the list for each unit: by letter pairs and edit distance, as an abbreviation, by its consonants
    similar = prefix_join(
        asked.filter(F.length("unit") >= 3).select(F.col("unit").alias("id"), letter_pairs(F.col("unit")).alias("set")),
        known.filter("not code").select(F.col("ref").alias("id"), letter_pairs(F.col("ref")).alias("set")),
        WORD_JACCARD,
    ).select(F.col("l").alias("unit"), F.col("r").alias("ref"), "jaccard")
    edits = F.levenshtein("unit", "ref")
    letters = lambda c: F.array_sort(F.split(c, ""))
    longer, lesser = F.greatest(F.length("unit"), F.length("ref")), F.least(F.length("unit"), F.length("ref"))
    allowed = F.when(longer <= 3, 0).when(longer <= 5, F.when(lesser < 3, 0).when(letters("unit") == letters("ref"), 2).otherwise(1)).otherwise(2)
    by_pairs = similar.withColumn("edits", edits).filter(F.col("edits") <= allowed)
    exact = asked.join(known, asked.unit == known.ref).select("unit", "ref", F.lit(0).alias("edits"), F.lit(1.0).alias("jaccard"))
    single = known.filter("size(terms) = 1 and ref = terms[0] and not code")
    shorts = asked.filter("short and length(unit) >= 3").select("unit", F.substring("unit", 1, 3).alias("head"))
    by_start = shorts.join(single.select("ref", F.substring("ref", 1, 3).alias("head")), "head").filter(F.col("ref").startswith(F.col("unit"))).select("unit", "ref", F.lit(1).alias("edits"), F.lit(0.5).alias("jaccard"))
    by_bones = asked.filter("(length(bones) >= 3 or short and length(bones) = 2) and width = 1").join(single.drop("terms"), "bones").filter("bones = unit").select("unit", "ref", F.lit(1).alias("edits"), F.lit(0.5).alias("jaccard"))
    found = by_pairs.unionByName(exact).unionByName(by_start).unionByName(by_bones).groupBy("unit", "ref").agg(F.min("edits").alias("edits"), F.max("jaccard").alias("jaccard"))
    found = found.join(asked.select("unit", "width"), "unit").join(known.select("ref", "terms", "code"), "ref")
    # neighbours run together stand for several words of the list, or exactly for one
    found = found.filter((F.col("width") == 1) | (F.size("terms") > 1) & (F.col("edits") <= 1) | F.col("code") | (F.col("edits") == 0))
    # of words equally near, the one that shares most letter pairs, then the one of the fewest entries
    common = refs.select("ref", "entry").distinct().groupBy("ref").agg(F.count("*").alias("common"))
    found = found.join(common, "ref")
    best = F.rank().over(Window.partitionBy("unit").orderBy("edits", F.desc("jaccard"), F.desc(F.size("terms")), "common"))
    found = ws.save(found.withColumn("rank", best).filter("rank = 1").select("unit", "terms"))
    heard = typed.join(found, "unit").select("value", F.explode("terms").alias("term")).distinct()
    heard = ws.save(heard.groupBy("value").agg(F.collect_set("term").alias("heard")))
    # the entries, met through the rare prefix of their words
    entries = refs.filter("size(terms) = 1 and not code").select("entry", F.col("terms")[0].alias("term")).distinct()
    spread = entries.groupBy("term").agg(F.count("*").alias("n"))
    own = Window.partitionBy("entry")
    ranked = entries.join(spread, "term").withColumn("least", F.min("n").over(own)).withColumn("place", F.row_number().over(own.orderBy("n", "term")))
    full = ranked.groupBy("entry").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("n") == F.col("least"), F.col("term"))).alias("rarest"))
    size = F.size("terms")
    prefix = ranked.join(full, "entry").filter(F.col("place") <= size - F.ceil(size * F.lit(ENTRY_JACCARD) - 1e-9) + 1).select("entry", "term", "terms", "rarest")
    met = heard.select("value", "heard", F.explode("heard").alias("term")).join(prefix, "term").select("value", "heard", "entry", "terms", "rarest").distinct()
    shared = F.size(F.array_intersect("heard", "terms"))
    met = met.withColumn("fit", shared / (F.size("heard") + F.size("terms") - shared)).filter((F.col("fit") >= ENTRY_JACCARD) | (shared == F.size("heard")))
    top = F.rank().over(Window.partitionBy("value").orderBy(F.desc("fit")))
    sure = F.arrays_overlap("heard", "rarest")
    chosen = met.withColumn("rank", top).filter("rank = 1").groupBy("value").agg(F.min("entry").alias("entry"), F.count("*").alias("n"), F.min(sure).alias("sure"))
    out = ws.save(distinct.join(chosen.filter("n = 1 and sure").select("value", "entry"), "value", "left"))
    for df in (distinct, typed, refs, known, asked, found, heard):
        ws.drop(df)
    return out


def map_to_reference(rows: DataFrame, value: str, reference: DataFrame, entry: str, name: str, code: str) -> DataFrame:
    """``rows`` with an ``entry`` column; one value that most rows have is looked up like any other."""
    known = canonical(rows, value, reference, entry, name, code).withColumnRenamed("value", value)
    return lookup(rows, known, value, rows.count(), "left")
