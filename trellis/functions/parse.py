"""Readers of semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import bare, filled, text

PEOPLE = "array<struct<name:string,consent:boolean>>"
RIGHTS = ("internal", "licensed", "restricted")


def split_list(c: Column) -> Column:
    """Values between commas and semicolons, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text(c), "[,;]+"), bare), lambda t: t != "")


def _json_array(c: Column) -> Column:
    return F.try_parse_json(F.when(bare(c).startswith("["), c))


def people_names(c: Column) -> Column:
    """Names of a people text, leniently: members of a JSON array that have one, else values between , and ;."""
    parsed = F.from_json(F.when(F.is_valid_utf8(c) & bare(c).startswith("["), c), "array<string>")
    name = lambda m: F.coalesce(F.get_json_object(m, "$.name"), F.when(~m.startswith("{"), m))
    listed = F.filter(F.transform(parsed, name), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(listed, split_list(c))


def people(c: Column) -> Column:
    """Names and consents, strictly: a JSON array all of whose members have a name, else names between , and ;.

    Consent is true, false or unknown.
    """
    parsed = F.from_json(F.when(bare(c).startswith("["), c), PEOPLE)
    sound = parsed.isNotNull() & F.forall(parsed, lambda p: bare(text(p["name"])) != "")
    strict = F.transform(parsed, lambda p: F.struct(bare(p["name"]).alias("name"), p["consent"].alias("consent")))
    loose = F.transform(split_list(c), lambda n: F.struct(n.alias("name"), F.lit(None).cast("boolean").alias("consent")))
    return F.when(F.coalesce(sound, F.lit(False)), strict).otherwise(loose)


def rights_kind(c: Column) -> Column:
    """One of RIGHTS; anything else reads as the first."""
    x = F.lower(bare(text(c)))
    return F.when(x.isin(*RIGHTS), x).otherwise(RIGHTS[0])


def number(c: Column) -> Column:
    """The text as a finite number, else 0."""
    x = F.expr("cast(null as double)") if c is None else c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)


def clamped(c: Column) -> Column:
    """A score between 0 and 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), number(c)))


def overall(subject: Column, composition: Column, quality: Column) -> Column:
    """The weighted mean of three clamped scores."""
    return 0.4 * clamped(subject) + 0.4 * clamped(composition) + 0.2 * clamped(quality)


def embedded_json(c: Column) -> Column:
    """The JSON object in a model's answer: from a code fence, else from the first { to the last }."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(F.trim(fence) != "", fence).otherwise(c)
    return F.regexp_extract(inner, r"(?s)(\{.*\})", 1)


def scene_times(log: Column) -> Column:
    """The times of a scene log, in order."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda t: t.try_cast("double"))


def frame_rate(ratio: Column) -> Column:
    """num/den as a number, 0 if the denominator is 0 or the text is no ratio."""
    num, den = F.split_part(ratio, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(ratio, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when(den != 0, num / den), F.lit(0.0))


def beats(rows: Column) -> Column:
    """Beats (start, end, text, kind, use) one a line; null for none."""
    line = lambda b: F.concat(b["start"].cast("string"), F.lit("–"), b["end"].cast("string"), F.lit("s: "), b["text"], F.lit(" ["), b["kind"], F.lit("; use: "), b["use"], F.lit("]"))
    return filled(F.array_join(F.transform(rows, line), "\n"))
