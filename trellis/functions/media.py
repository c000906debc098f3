"""Kinds of media by file name and declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import text

# The extensions of each kind, and the types taken as uploads with their extensions.
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "avif", "heic", "tiff", "bmp")
VIDEOS = ("mp4", "mov", "webm", "m4v", "avi", "mkv", "gifv")
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif"}
VIDEO_TYPES = {"mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "webm": "video/webm", "mkv": "video/x-matroska"}


def extension(filename: Column) -> Column:
    """What follows the last period, in lower case; white space after it doesn't count."""
    return F.regexp_extract(F.lower(text(filename)), r"\.([a-z0-9]+)\s*$", 1)


def media_type(filename: Column, declared: Column, asset_type: Column) -> Column:
    """image, video or other: by extension, then by declared type, then by what is stated."""
    ext, mime, said = extension(filename), F.lower(text(declared)), F.lower(text(asset_type))
    by_name = F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")
    by_type = F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video")
    return F.coalesce(by_name, by_type, F.when(said.isin("image", "video"), said), F.lit("other"))


def resolve_mime(declared: Column, filename: Column, types: dict[str, str]) -> Column:
    """The declared type without parameters if it is one of ``types``, else the extension's, else null."""
    said = F.trim(F.substring_index(F.lower(text(declared)), ";", 1))
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for kv in types.items() for x in kv)), extension(filename))
    return F.coalesce(F.when(said.isin(*set(types.values())), said), by_name)
