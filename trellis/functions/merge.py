"""Merging a contribution into what is there, column by column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import bare, text


def fill(old: Column, new: Column) -> Column:
    """The new text, trimmed, where the old one is empty."""
    return F.when((text(old) == "") & (bare(text(new)) != ""), bare(new)).otherwise(text(old))


def append_text(old: Column, new: Column) -> Column:
    """The new text on a line of its own, unless the old one holds it already."""
    add = bare(text(new))
    return F.when((add == "") | F.contains(text(old), add), text(old)).when(text(old) == "", add).otherwise(F.concat(old, F.lit("\n"), add))


def merge_tags(old: Column, new: Column) -> Column:
    """The old tags, then those of the new ones that aren't there, whatever their case."""
    none = F.array().cast("array<string>")
    have = F.transform(F.coalesce(old, none), lambda t: F.lower(t))
    return F.concat(F.coalesce(old, none), F.filter(F.coalesce(new, none), lambda t: ~F.array_contains(have, F.lower(t))))


def merge_people(old: Column, new: Column) -> Column:
    """The old people with consents filled from the new ones of the same name, then the new names.

    Names are the same whatever their case; a consent once known isn't changed.
    """
    same = lambda a: F.filter(new, lambda b: (F.lower(b["name"]) == F.lower(a["name"])) & b["consent"].isNotNull())
    kept = F.transform(old, lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["consent"], F.try_element_at(same(a), F.lit(1))["consent"]).alias("consent")))
    have = F.transform(old, lambda a: F.lower(a["name"]))
    added = F.filter(new, lambda b: ~F.array_contains(have, F.lower(b["name"])))
    first = F.filter(added, lambda b, i: F.array_position(F.transform(added, lambda x: F.lower(x["name"])), F.lower(b["name"])) == i + 1)
    return F.concat(kept, first)
