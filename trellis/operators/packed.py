"""Several values packed in one field: one row a value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.packed import split_packed

SCHEMA = "key long, field string, pos int, item string, values int, errors array<string>"


def _split(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, field in enumerate(fields, 1):
                for key, text in zip(keys, batch.column(i).to_pylist()):
                    items, errors = split_packed(text)
                    for pos, item in enumerate(items, 1):
                        for column, x in zip(out, (key, field, pos, item, len(items), errors)):
                            column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "field", "pos", "item", "values", "errors"])

    return run


def packed_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, pos, item, values, errors): each value of each field in order.

    pos counts non-empty values from 1, ``values`` is their number in that text, ``errors``
    holds its flags (see the grammar).  Null, empty and blank texts give no row, and neither
    do rows with a null key.  Rows that share a key count once.  Other columns are ignored.
    The rows of a key don't depend on one another, so nothing but that deduplication is
    shuffled, and it moves only the rows that hold a text.
    """
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""
    some = None
    for f in fields:
        some = ~blank(F.col(f)) if some is None else some | ~blank(F.col(f))
    rows = df.select(F.col(key).cast("long").alias("key"), *fields).filter(F.col("key").isNotNull() & some).dropDuplicates(["key"])
    return rows.mapInArrow(_split(fields), SCHEMA)
