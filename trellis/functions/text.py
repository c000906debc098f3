"""Text expressions: cleaning, tokens, lexical boosts, slugs, chunks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the ranking.
PERSON_BOOST, PRODUCT_BOOST, PHRASE_BOOST, TERM_BOOST = 0.20, 0.15, 0.50, 0.45
SLUG_LENGTH, CHUNK_LENGTH, SUMMARY_LENGTH = 60, 2000, 140


def bare(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    """A missing text is empty."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """An empty text is missing."""
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text(c)), r"(?U)\s+"), lambda t: t != "")


def haystack(*fields: Column) -> Column:
    """The non-empty fields, one a line, in lower case."""
    return F.lower(F.concat_ws("\n", *(filled(f) for f in fields)))


def keyword_boost(query: Column, people: Column, product: Column) -> Column:
    """PERSON_BOOST once if a person's name occurs in the query, and PRODUCT_BOOST if the product's does."""
    person = F.exists(people, lambda n: (n != "") & F.contains(query, F.lower(n)))
    named = (text(product) != "") & F.contains(query, F.lower(text(product)))
    return F.when(F.coalesce(person, F.lit(False)), PERSON_BOOST).otherwise(0.0) + F.when(named, PRODUCT_BOOST).otherwise(0.0)


def direct_hit(query: Column, terms: Column, hay: Column) -> Column:
    """PHRASE_BOOST for the whole query in the haystack, else TERM_BOOST times the share of terms in it.

    Terms of one letter can't hit but count in the share.
    """
    hits = F.size(F.filter(terms, lambda t: (F.length(t) >= 2) & F.contains(hay, t)))
    some = F.when(F.size(terms) > 0, F.lit(TERM_BOOST) * hits / F.size(terms)).otherwise(0.0)
    none = (query == "") | (hay == "")
    return F.when(none, 0.0).when((F.length(query) >= 2) & F.contains(hay, query), PHRASE_BOOST).otherwise(some)


def ascii_slug(c: Column) -> Column:
    """A slug of a text without accents: lower case, runs of anything else as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition less the combining accents; batches travel by Arrow."""
    fold = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not "̀" <= c <= "ͯ")
    return s.map(fold)


def slugify(c: Column) -> Column:
    return ascii_slug(without_accents(F.lower(c)))


def short_slug(slug: Column) -> Column:
    """At most SLUG_LENGTH letters, cut back to a whole part."""
    return F.when(F.length(slug) > SLUG_LENGTH, F.regexp_replace(F.left(slug, F.lit(SLUG_LENGTH)), "-[^-]*$", "")).otherwise(slug)


def asset_slug(context: Column, filename: Column, extension: Column, sha256: Column) -> Column:
    """context-or-name, then six base-36 digits of the content hash, then the extension."""
    stem = F.regexp_replace(text(filename), r"\.[^.]*$", "")
    base = short_slug(F.coalesce(filled(slugify(text(context))), filled(slugify(stem)), F.lit("asset")))
    mark = F.lower(F.substring(F.conv(F.substring(sha256, 1, 16), 16, 36), 1, 6))
    return F.concat(base, F.lit("-"), mark, F.lit("."), extension)


def chunks(c: Column, length: int = CHUNK_LENGTH) -> Column:
    """The text in pieces of ``length`` letters; one empty piece for an empty text."""
    last = F.greatest(F.floor((F.length(c) - 1) / length), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * length + 1, F.lit(length)))


def summary(c: Column, length: int = SUMMARY_LENGTH) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit("…"))).otherwise(c)


def base_name(filename: Column) -> Column:
    """Without its extension; "frame" if nothing is left."""
    return F.coalesce(filled(F.regexp_replace(text(filename), r"\.[^.]+$", "")), F.lit("frame"))


def scene_name(filename: Column, number: Column) -> Column:
    return F.concat(base_name(filename), F.lit("-scene-"), F.lpad(number.cast("string"), 2, "0"))
