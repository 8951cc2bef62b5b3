"""Whole batches of texts as numpy arrays: bytes, words, lines and shingles without a Python object per word.

A text column arrives as Arrow batches. `chunks` cuts each batch into runs of rows of about CHUNK_BYTES (a longer
text stands alone and whole), so the memory of a task is bounded by that and by its longest text. A word is a maximal
run of characters other than \\x20 and \\x09-\\x0D; a null text is empty.

Words and lines are compared by 64-bit hashes of their bytes: equal strings always agree. Each 8-byte piece is mixed
with its place before the sum, so no family of strings is known whose hashes agree more often than by chance, 2**-64 a
pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: Of an Arrow batch between Spark and a worker: about the most bytes, or one longer row.
BATCH_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES.

    Both ends of the pipe hold a whole batch outside the heap, and Spark's own bound is 64 MB. The plan reads the bound
    from the session, so it is set there and stays, unless the application was started with one. Workers live on between
    tasks, so at a task's end they give the memory that it freed back to the system.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library alone has it
            trim(0)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(key):
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df.mapInArrow(released, schema)


@dataclass
class Chunk:
    """Rows [first, first + n) of a batch: their bytes, one after another, and where each begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where inside holds; no run crosses the end of a text."""
        if not len(inside):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    def rows_of(self, starts: np.ndarray) -> np.ndarray:
        """The row, from 0 in this chunk, that each start lies in."""
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending starts lie in each row."""
        return np.diff(np.searchsorted(starts, self.offsets))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span: the sum of its 8-byte pieces, each mixed with its place, and the length."""
        length = ends - starts
        pieces = (length + 7) >> 3
        before = np.cumsum(pieces) - pieces
        place = np.arange(int(pieces.sum())) - np.repeat(before, pieces)
        at = np.repeat(starts, pieces) + 8 * place
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        words = np.lib.stride_tricks.as_strided(padded.view(), (len(self.data) + 1, 8), (1, 1))[at].view("<u8").ravel()
        spare = np.maximum(8 - (np.repeat(ends, pieces) - at), 0).astype(np.uint64) * np.uint64(8)
        words &= np.uint64(0xFFFFFFFFFFFFFFFF) >> spare
        mixed = mix(words ^ mix((place + 1).astype(np.uint64) * np.uint64(_P)))
        return mix(per_row_sum(mixed, pieces) + length.astype(np.uint64) * np.uint64(_P))


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """A text column cut into runs of rows of about CHUNK_BYTES."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        part = data[offsets[first] : offsets[last]]
        yield Chunk(first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first])
        first = last


def runs_within(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of width consecutive words of one row: the hash, the index of its first word, and how many in each row."""
    per_row = np.maximum(counts - width + 1, 0)
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(per_row) - per_row), per_row) + np.arange(int(per_row.sum()))
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total += hashes[at + k] * _MULTIPLIERS[k]
    return mix(total), at, per_row


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hashes of each run of width words of each row, in order, with how many each row has and the words' spans.

    A row with fewer words, but at least one, has one shingle: all its words.
    """
    starts, ends = chunk.words()
    counts = chunk.counts(starts)
    words = chunk.hashes(starts, ends)
    found, _, per_row = runs_within(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = (np.cumsum(per_row) - per_row)[short]
        begin = (np.cumsum(counts) - counts)[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] += words[begin[has] + k] * _MULTIPLIERS[k]
        found = np.insert(found, at, mix(whole + counts[short].astype(np.uint64)))
        per_row = per_row.copy()
        per_row[short] = 1
    return found, per_row, (starts, ends)


def per_row_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts[i] values for row i; 0 for a row without values."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later
