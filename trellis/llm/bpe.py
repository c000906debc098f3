"""Encoding by a byte-level BPE vocabulary through a sentencepiece model made from it.

The rank file is serialised as a sentencepiece BPE model: each token becomes a piece whose
bytes are mapped to printable characters, scored by its negative rank, with the identity
as normalisation.  Of two neighbours the pair with the best score is joined first, which is
the order of the ranks.  Texts are cut into pre-tokens by the vocabulary's pattern, each
pre-token is mapped and encoded, and decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens a worker remembers before it forgets all of them.
MEMORY = 100_000
#: Pre-tokens beyond this length are rarely met again.
MEMORABLE = 24


def byte_map() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i + 1 is token i; piece 0 is the unknown one it must have."""
    chars = byte_map()
    # piece: text 1, score 2, type 3 (2 unknown); trainer: model type 3 (2 BPE), vocabulary 4, ids of
    # unknown, start, end and padding 40 to 43; normaliser: name 1, dummy prefix 3, white space 4 and 5
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, float(-rank))))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes and decodes by a serialised model."""

    def __init__(self, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_map()
        self.to_chars = dict(enumerate(chars))
        self.to_bytes = {ord(c): b for b, c in enumerate(chars)}
        self.cut = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return []
        memory, ids = self.memory, []
        if len(memory) > MEMORY:
            memory.clear()
        words = self.cut(text)
        fresh = list({w for w in words if w not in memory})
        own: dict[str, list[int]] = {}
        if fresh:
            mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars) for w in fresh]
            for w, found in zip(fresh, self.pieces.encode(mapped, num_threads=1)):
                (memory if len(w) <= MEMORABLE else own)[w] = [i - 1 for i in found]
        for w in words:
            ids += memory[w] if w in memory else own[w]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no text come out as replacement characters."""
        chars = "".join(self.pieces.id_to_piece(int(i) + 1) for i in ids)
        return bytes(chars.translate(self.to_bytes), "latin-1").decode("utf-8", "replace") if chars else ""


def model_for(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The model, made on the driver and sent to each executor once (about a megabyte, the vocabulary's size)."""
    return spark.sparkContext.broadcast(serialise(read_ranks(os.path.join(folder, vocabulary))))


def encode(documents: DataFrame, key: str, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY, only_sizes: bool = False) -> DataFrame:
    """(key, ids) of each row, or (key, tokens) with ``only_sizes``.

    Null and empty texts have the empty list (0 tokens); white space is text like any other.
    Rows are encoded one by one where they lie, whole; nothing is shuffled, and a row given
    twice comes out twice.  Other columns are ignored.
    """
    model = model_for(documents.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            last = pa.array([len(x) for x in ids], pa.int32()) if only_sizes else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), last], names=["key", "out"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(key, text).mapInArrow(run, f"key {kind}, out {'int' if only_sizes else 'array<int>'}")
    return out.toDF(key, "tokens" if only_sizes else "ids")
