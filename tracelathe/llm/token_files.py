"""Token ids in word-aligned binary files, and back.

The code is Simple-8b: every 64-bit word has a 4-bit selector and packs as many ids of one width as fit. Blocks
of 1024 ids begin at known words, so the blocks of a file are coded and decoded side by side by numpy. A value of
more than 60 bits is an escape: selector 0 and its place in a list of raw 64-bit values at the file's end.

A file is a little-endian sequence: magic "S8b1", block count (u32), id count (u64), escape count (u64), the first
word of every block and the word count (u64 each), the words, the escapes. Files are the `data` column of a Parquet
table in a folder that all executors share (Spark's writer commits a task's files only once, so lost executors
leave nothing half written), beside the documents' ids and lengths, as columns of their own, and the file's place in the whole sequence.

Documents are dealt by ranges of doc_id and written in ascending order (rows with null ids first; equal ids in the order of
a hash of their texts, so that a repeated id is no single range). Every document ends with id 0. Null and empty texts have that id only; an empty table writes no file. Texts
may be of any length: a file holds whole documents, at least `file_ids` ids if there are as many. Other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.llm.columns import U64, Kept, only, pieces
from tracelathe.llm.graph import table_path
from tracelathe.llm.pretokens import split_pattern, tokenizers_classes

BLOCK = 1024
FILE_IDS = 1 << 19
MAGIC = b"S8b1"
#: Fixed values of the code: how many ids of which width a word holds, by selector; 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAD = 128


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    left = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = left >= (U64(1) << U64(step))
        out[high] += step
        left[high] >>= U64(step)
    return out + (values > 0)


def pack_ids(ids: np.ndarray) -> bytes:
    """One file of the given ids (any unsigned 64-bit values)."""
    ids = np.ascontiguousarray(ids, U64)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK + _PAD), U64)
    full = np.zeros(blocks * BLOCK, U64)
    full[: len(ids)] = ids
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = _bits(grid)
    choice = np.zeros((blocks, BLOCK), np.uint8)
    open_ = np.ones((blocks, BLOCK), bool)
    for s in range(1, 16):
        c = int(COUNTS[s])
        top, size = bits, 1
        while size < c:
            step = min(size, c - size)
            top = np.maximum(top[:, :-step], top[:, step:])
            size += step
        fits = open_ & (top[:, :BLOCK] <= WIDTHS[s])
        choice[fits] = s
        open_ &= ~fits
    # All blocks step from word to word together.
    sizes = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(blocks))
    rows, place, words_at = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        words_at.append((rows, place))
        place = place + COUNTS[choice[rows, place]]
        more = place < sizes[rows]
        rows, place = rows[more], place[more]
    row = np.concatenate([x for x, _ in words_at]) if words_at else np.zeros(0, np.int64)
    col = np.concatenate([x for _, x in words_at]) if words_at else np.zeros(0, np.int64)
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    chosen = choice[row, col]
    words = chosen.astype(U64) << U64(60)
    flat, base = grid.reshape(-1), row * (BLOCK + _PAD) + col
    escapes = np.zeros(0, U64)
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        if s == 0:
            escapes = flat[base[own]]
            words[own] |= np.arange(len(own), dtype=U64)
        elif WIDTHS[s]:
            for j in range(COUNTS[s]):
                words[own] |= flat[base[own] + j] << U64(j * WIDTHS[s])
    first = np.searchsorted(row, np.arange(blocks + 1)).astype(U64)
    head = MAGIC + np.uint32(blocks).tobytes() + np.array([len(ids), len(escapes)], U64).tobytes()
    return head + first.tobytes() + words.tobytes() + escapes.tobytes()


def unpack_ids(data: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of a file; with begin and end only the blocks that hold those are decoded."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    blocks = int(np.frombuffer(data, np.uint32, 1, 4)[0])
    count, n_escapes = (int(x) for x in np.frombuffer(data, U64, 2, 8))
    end = count if end is None else min(end, count)
    first = np.frombuffer(data, U64, blocks + 1, 24).astype(np.int64)
    words = np.frombuffer(data, U64, first[-1], 24 + 8 * (blocks + 1))
    escapes = np.frombuffer(data, U64, n_escapes, 24 + 8 * (blocks + 1 + len(words)))
    if begin >= end:
        return np.zeros(0, U64)
    low, high = begin // BLOCK, -(-end // BLOCK)
    words = words[first[low] : first[high]]
    row = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
    chosen = (words >> U64(60)).astype(np.int64)
    body = words & U64((1 << 60) - 1)
    step = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    step -= step[first[low:high] - first[low]][row]
    out = np.zeros((high - low, BLOCK + _PAD), U64)
    flat, base = out.reshape(-1), row * (BLOCK + _PAD) + step
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        if s == 0:
            flat[base[own]] = escapes[body[own].astype(np.int64)]
        elif WIDTHS[s]:
            mask = U64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                flat[base[own] + j] = (body[own] >> U64(j * WIDTHS[s])) & mask
    return out[:, :BLOCK].reshape(-1)[begin - low * BLOCK : end - low * BLOCK]


class LibraryEncoder:
    """Ids as the tokenizers library gives them, each different pre-token being encoded by it once."""

    #: Bytes of resolved pre-tokens that a worker keeps at most.
    KEPT_BYTES = 80 << 20

    def __init__(self, path: str, classes: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as text:
            spec = json.load(text)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.classes = tokenizers_classes() if classes is None else classes
        self.kept = Kept(self.KEPT_BYTES)
        # Byte-level models spell bytes as printable signs: those that are printable as they are, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.spell = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids; the strings of special tokens become these, as by default."""
        if any(s in x for s in self.special for x in texts):
            return [self._with_special(x) for x in texts]
        return self._plain(texts)

    def _with_special(self, text: str) -> bytes:
        for s, i in self.special.items():
            if s in text:
                return np.uint32(i).tobytes().join(self._with_special(x) for x in text.split(s))
        return self._plain([text])[0]

    def _plain(self, texts: list[str]) -> list[bytes]:
        tokens, at = split_pattern(texts, self.classes)
        self.kept.trim()
        new = set(tokens).difference(self.kept.table)
        if new:
            table = {ord(chr(b)): s for b, s in self.spell.items()}
            for x in new:
                ids = [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(table))]
                self.kept.add(x, np.array(ids, "<u4").tobytes())
        ids = list(map(self.kept.table.__getitem__, tokens))
        return [b"".join(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str, classes: np.ndarray | None = None) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path, classes)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id="doc_id", text="text", file_ids: int = FILE_IDS) -> None:
    """Writes the files of the documents' ids as the Parquet table `path`."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(tokenizers_classes())  # one byte per code point

    def run(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, docs_, held = [], [], 0

        def file():
            nonlocal number, before, held
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = {
                "part": [part], "number": [number], "before": [before], "n_ids": [len(flat)], "doc_ids": [docs_[:]],
                "lengths": [[len(x) // 4 for x in ids]], "data": [pack_ids(flat)],
            }
            number, before, held = number + 1, before + len(flat), 0
            ids.clear()
            docs_.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                for d, x in zip(piece.column(0).to_pylist(), library_encoder(tokenizer, classes.value).encode(texts), strict=True):
                    docs_.append(d)
                    ids.append(x + b"\0\0\0\0")
                    held += len(x) // 4 + 1
                    if held >= file_ids:
                        yield file()
        if ids:
            yield file()

    long = pa.int64()
    schema = pa.schema([("part", long), ("number", long), ("before", long), ("n_ids", long), ("doc_ids", pa.list_(long)), ("lengths", pa.list_(long)), ("data", pa.binary())])
    dealt = only(docs, doc_id=doc_id, text=text).withColumn("mark", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    dealt.mapInArrow(run, "part bigint, number bigint, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens, ids_crc32, and `ids` (packed u32) if asked for."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per partition of the writing job, which bounds this table.
    starts = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    placed = files.join(F.broadcast(starts), F.col("part") == F.col("of")).select((F.col("ahead") + F.col("before")).alias("start"), "doc_ids", "lengths", "data")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        for batch in batches:
            for start, doc_ids, lengths, data in zip(*(c for c in batch.columns), strict=True):
                flat = unpack_ids(data.as_buffer().to_pybytes()).astype("<u4")
                ends = np.cumsum(np.array(lengths.as_py(), np.int64))
                begins = ends - np.array(lengths.as_py(), np.int64)
                own = [flat[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(start.as_py() + begins), pa.array(ends - begins), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, names=names)

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = table_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path, ids=False)
