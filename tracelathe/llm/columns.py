"""Vectorised text helpers shared by the operators: words of whole Arrow batches as numpy arrays.

Every helper works on the raw UTF-8 bytes of a batch, so no per-word Python object is made. Null texts are
treated as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the polynomial hash (odd, so it has an inverse modulo 2**64) and of the sequence hash.
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words made of letters and everything outside ASCII.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
#: Bytes of words that only blanks (0x20, 0x09 to 0x0D) separate.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def powers(n: int, base: int = _P) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _POW[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts one after the other, and where each begins (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = texts.buffers()
    at = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_runs(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every maximal run of word bytes; no run crosses a text's end."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[1:] = table[data]
    begin = inside[1:] & ~inside[:-1]
    first = at[:-1][at[:-1] < n]
    begin[first] |= inside[1:][first]
    end = np.zeros(n + 1, bool)
    end[:-1] = inside[:-1] & ~inside[1:]
    end[-1] = inside[-1]
    last = at[1:][at[1:] > 0]
    end[last] |= inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end)


def coded_words(texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a batch, with A-Z lower-cased: which text each is in, its code, and the distinct words by code."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    begin, end = word_runs(data, at, table)
    ends = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[table[data]])).dictionary_encode()
    return np.searchsorted(at, begin, "right") - 1, words.indices.to_numpy(), words.dictionary


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes (not empty)."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=total[1:])
    return mix((total[end] - total[begin]) * powers(len(data) + 1, _P_INV)[begin] + (end - begin).astype(U64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * U64(pow(_Q, j, 1 << 64))
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, one row at least."""
    rows = batch.num_rows
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(texts.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = 4 << 20):
    """A function for mapInArrow that applies `work` to slices of bounded size."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return run


class Kept:
    """What a worker has resolved, by text, in `table` (a dict): about `limit` bytes at most; long texts are forgotten after a batch."""

    LONG = 256

    def __init__(self, limit: int):
        self.limit, self.size, self.long, self.table = limit, 0, [], {}

    def add(self, text: str, packed: bytes) -> None:
        self.table[text] = packed
        self.size += 220 + len(text) + len(packed)
        if len(text) > self.LONG:
            self.long.append((text, packed))

    def trim(self) -> None:
        """Before a batch."""
        for text, packed in self.long:
            self.table.pop(text, None)
            self.size -= 220 + len(text) + len(packed)
        self.long.clear()
        if self.size > self.limit:
            self.table.clear()
            self.size = 0


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names (only(docs, doc_id="id")): others can't clash with results."""
    return docs.select(*(F.col(f"`{was}`").alias(name) for name, was in columns.items()))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder for a query. Two of the session's settings are set: Arrow batches are kept small, as single texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
