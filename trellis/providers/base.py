"""Model providers: what a service would answer, behind one call a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class TextEmbedder(Protocol):
    """Turns texts into vectors of one length; an answer of None means that the call failed."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[tuple[int, list[float] | None]]:
        """(place of the text in the call, its vector), in whatever order the service answers."""
        ...


def in_order(answers: list[tuple[int, list[float] | None]], n: int) -> list[list[float] | None]:
    """The vectors in the order of the ``n`` texts asked; null for what has no answer."""
    out: list[list[float] | None] = [None] * n
    for place, vector in answers:
        if 0 <= place < n:
            out[place] = vector
    return out


def embed(df: DataFrame, key: str, text: str, provider: TextEmbedder) -> DataFrame:
    """(key, v): each text's vector, null where the provider failed or the text is null or empty.

    One call a batch of rows; the batch size is the session's Arrow batch size.  A failed call
    costs its batch's vectors and not the job.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            asked = [t for t in texts if t]
            try:
                answers = iter(in_order(provider.embed(asked), len(asked)) if asked else [])
            except Exception:  # the contract is best effort
                answers = iter([None] * len(asked))
            out = [next(answers) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["key", "v"])

    return df.select(key, text).mapInArrow(run, f"key {kind}, v array<float>").withColumnRenamed("key", key)
