"""Encoding of a corpus with a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged, so the text may be cut
there. A cut is used where it also leaves the pre-tokenizer's view of both sides unchanged: the left
character is no white space (its run could look ahead) and the right one no apostrophe (it could start
a contraction). Fragments are encoded independently, each distinct one once while it is remembered,
and concatenated.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanwork.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments remembered by a Python worker before it starts anew; bounds its memory.
REMEMBERED = 400_000

#: Code points that \s matches.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_encoders: dict[int, "FragmentEncoder"] = {}


class FragmentEncoder:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.whole = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.space = np.zeros(0x110000, bool)
        self.space[SPACES] = True
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, vocabulary: bytes) -> "FragmentEncoder":
        key = zlib.crc32(vocabulary)
        if key not in _encoders:
            _encoders[key] = cls(vocabulary)
        return _encoders[key]

    def cuts(self, text: str) -> np.ndarray:
        """Positions in text (in characters) before which a cut is certain."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.where(c < 0x80, c, np.where(c < 0x800, 0xC0 | c >> 6, np.where(c < 0x10000, 0xE0 | c >> 12, 0xF0 | c >> 18)))
        last = np.where(c < 0x80, c, 0x80 | c & 0x3F)
        certain = ~self.inside[last[:-1], first[1:]] & ~self.space[c[:-1]] & (c[1:] != ord("'"))
        return np.flatnonzero(certain) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts in a row."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        if not joined:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        at = np.union1d(self.cuts(joined), ends)
        at = at[at > 0]
        starts = np.concatenate([[0], at[:-1]]).tolist()
        known, whole, parts = self.known, self.whole, []
        for a, b in zip(starts, at.tolist()):
            fragment = joined[a:b]
            ids = known.get(fragment)
            if ids is None:
                ids = whole.encode_ordinary(fragment)
                if len(fragment) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[fragment] = ids
            parts.append(ids)
        filled = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(filled[-1]))
        return np.concatenate([[0], filled[np.searchsorted(at, ends, side="right")]]), flat


def _encoder(spark, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file, about 1 MB whatever the corpus


def _batches(table: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes each (a longer single text stays whole)."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(table.column(1)), 0).to_pylist()):
        if held and held + n > most:
            yield table.slice(start, i - start)
            start, held = i, 0
        held += n
    yield table.slice(start)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>), a row for each row of df: the ids of text_col without special tokens.

    Empty and null texts give the empty list. Strings that look like special tokens are ordinary text.
    Null and repeated ids are kept as they are; other columns of df play no part, whatever their names.
    A narrow map: no shuffle, and only two columns are read.
    """
    held = _encoder(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(held.value)
        for whole in batches:
            for batch in _batches(whole):
                offsets, ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens BIGINT): the lengths of the lists that encode_corpus gives, without moving the lists."""
    held = _encoder(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder.of(held.value)
        for whole in batches:
            for batch in _batches(whole):
                offsets, _ = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)
