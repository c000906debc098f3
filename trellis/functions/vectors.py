"""Vectors as arrays of float."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products of float32 components summed as doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Of length one; the zero vector stays."""
    # the length is bound by a lambda, so that it isn't worked out again for each component
    by = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0).cast("float"))
    return F.element_at(F.transform(F.array(norm(v)), by), 1)


def constant_unit(v: list[float]) -> Column:
    """A unit vector as a literal."""
    x = np.asarray(v, dtype="f8")
    n = float(np.sqrt(x @ x))
    return F.array(*(F.lit(float(np.float32(c / n if n else 0.0))).cast("float") for c in x))


def usable(v: Column, dimensions: Column) -> Column:
    """True for a vector of that length, all finite and not all zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def to_blob(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, blob): each vector as raw little-endian float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["key", "blob"])

    return df.select(key, vector).mapInArrow(run, "key long, blob binary")


def from_blob(df: DataFrame, dimensions: int) -> DataFrame:
    """(key, pos, vector): the rows of each raw float32 blob; a last part too short for a row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, out = [], [], []
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob is None:
                    continue
                rows = np.frombuffer(blob[: len(blob) // (4 * dimensions) * 4 * dimensions], dtype="<f4").reshape(-1, dimensions)
                keys += [k] * len(rows)
                places += range(len(rows))
                out += list(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(out, pa.list_(pa.float32()))], names=["key", "pos", "vector"])

    return df.mapInArrow(run, "key long, pos int, vector array<float>")
