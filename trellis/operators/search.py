"""Ranked search over a catalogue: vectors, lexical boosts, keywords and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.functions.text import direct_hit, keyword_boost
from trellis.functions.vectors import constant_unit, dot, unit

# Fixed values of the ranking: hits that are ranked, hits of a page.
RANKED, PAGE = 300, 24


def cosine_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(rank, id, score): the ``k`` vectors of the highest cosine, ties by id; ``vectors`` has id and v.

    Partial top-k in every task, then one merge; nothing is sorted as a whole.
    """
    q = constant_unit(query)
    scored = vectors.select("id", dot(unit(F.col("v")), q).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), "id").limit(k), [F.desc("score"), "id"])


def ranked(few: DataFrame, order: list) -> DataFrame:
    """``few``, which a limit bounds, with its rank."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def hybrid(rows: DataFrame, query: str, vector: list[float] | None) -> DataFrame:
    """``rows`` that match with their ``score``: cosine plus boosts for names, phrase and terms.

    ``rows`` has people (array of names), product, hay (lower case) and v (null where a row has
    no vector).  A row without a vector counts only if its boosts do.
    """
    said = F.lit(query.lower())
    terms = F.array(*(F.lit(t) for t in query.lower().split())) if query.split() else F.array().cast("array<string>")
    boost = keyword_boost(said, F.col("people"), F.col("product")) + direct_hit(said, terms, F.col("hay"))
    if vector is None:
        return rows.withColumn("score", boost).filter("score > 0")
    q = constant_unit(vector)
    near = F.when(F.col("v").isNotNull(), dot(unit(F.col("v")), q))
    return rows.filter(near.isNotNull() | (boost > 0)).withColumn("score", F.coalesce(near, F.lit(0.0)) + boost)


def offset_of(cursor: str | None) -> int:
    """Where a page begins: the whole number of its cursor, else the start."""
    return int(cursor) if cursor and cursor.strip().isascii() and cursor.strip().isdigit() else 0


def page(rows: DataFrame, order: list, offset: int, size: int = PAGE, cap: int | None = RANKED) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in that order, of the first ``cap`` ones if there is one.

    The partial top-(offset + size) of each task is all that is gathered.
    """
    end = offset + size if cap is None else min(cap, offset + size)
    return ranked(rows.orderBy(*order).limit(max(0, end)), order).filter(F.col("rank") > offset)


def keyword_filter(query: str, fields: list[str]) -> Column:
    """True if each word of the query occurs in some of the fields, whatever its case; true for no word."""
    some = lambda t: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(t)) for f in map(F.col, fields)))
    return reduce(lambda a, b: a & b, map(some, query.lower().split()), F.lit(True))


def text_fields(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted fields that the table has as strings."""
    return [f for f in wanted if dict(df.dtypes).get(f) == "string"]


def after(created: str, key: str, at: tuple) -> Column:
    """What follows the row ``at`` (created, key) in descending order of both."""
    return (F.col(created) < F.lit(at[0])) | ((F.col(created) == F.lit(at[0])) & (F.col(key) < F.lit(at[1])))
