"""Byte-level views of Arrow text columns, shared by the corpus operators.

A task gets Arrow batches from Spark, cuts them into blocks of a few MB and runs
vector operations on each block's UTF-8 bytes.  Every character of two or more
bytes consists of bytes >= 0x80, so word classes that are told apart by ASCII
characters alone can be evaluated on bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
U64 = np.uint64

#: bytes of words of letters and digits: 0-9, A-Z, a-z and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: bytes of words split at white space
INK = np.ones(256, bool)
INK[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Block:
    """Some documents' texts as one run of bytes.

    buf: the bytes; off: where each document begins, and the end.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self._sums = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def lowered(self) -> Block:
        return Block(LOWER[self.buf], self.off)

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in the table, never across documents: starts, ends, and for
        each document the index of its first run (one more entry than documents)."""
        inside = table[self.buf]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        if n:
            cuts = self.off[(self.off > 0) & (self.off < n)]
            begins[1:] &= ~inside[:-1]
            begins[cuts] = inside[cuts]
            ends[:-1] &= ~inside[1:]
            ends[cuts - 1] = inside[cuts - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes, by prefix sums of a polynomial."""
        power, inverse = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(_BYTE_CODES[self.buf] * power[: len(self.buf)], out=self._sums[1:])
        value = (self._sums[stops] - self._sums[starts]) * inverse[starts]
        return mix(value + (stops - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per document, its bytes that are in the table."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(table[self.buf], out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each run, the document that it lies in."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def of_strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty string."""
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def blocks(batches: Iterable[pa.RecordBatch], text_at: int = 1, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with at most about `limit` text bytes, with their bytes.

    A text that is longer has a slice of its own; texts are never cut.
    """
    for batch in batches:
        buf, off = of_strings(batch.column(text_at))
        k = 0
        while k < batch.num_rows:
            end = max(k + 1, int(np.searchsorted(off, off[k] + limit, "right")) - 1)
            yield batch.slice(k, end - k), Block(buf[off[k] : off[end]], off[k : end + 1] - off[k])
            k = end


def rows_of_text(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches' slices with their texts as Python strings; null counts as empty."""
    for part, block in blocks(batches):
        raw = block.buf.tobytes()
        yield part, [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)]


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, the text and the columns to pass on, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(docs[c] for c in carry))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def carried_ddl(docs: DataFrame, names: tuple[str, ...]) -> str:
    """The columns that an operator passes on as they are, as they follow its own in a schema."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in names)


def carried(made: pa.RecordBatch, part: pa.RecordBatch, names: tuple[str, ...], at: int = 2) -> pa.RecordBatch:
    """What was made of a slice, and the slice's own columns from `at` on."""
    if not names:
        return made
    return pa.RecordBatch.from_arrays([*made.columns, *(part.column(at + k) for k in range(len(names)))], names=[*made.schema.names, *names])
