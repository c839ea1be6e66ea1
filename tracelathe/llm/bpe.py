"""Byte-level BPE encoding and decoding with a public rank file.

Encoding is a two-tier lookup. Pre-tokens that are vocabulary entries as a whole are resolved for a batch at a
time through a minimal perfect hash over the vocabulary; the others are merged with a heap of candidate pairs
over a linked list of bytes. A worker keeps what it has resolved in a table of bounded size, which changes the
speed only.

Texts may be null or empty (no tokens) and of any length; repeated rows and rows without id are encoded each; an empty
table gives an empty table. Other columns are kept as they are; the result columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import heapq
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.columns import U64, Kept, by_batch, mix, run_hashes
from tracelathe.llm.pretokens import split_pattern, tiktoken_classes

#: Bytes of resolved pre-tokens that a worker keeps at most.
KEPT_BYTES = 150 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def hash_all(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, none of them empty."""
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(x) for x in keys])
    return run_hashes(data, np.concatenate(([0], ends[:-1])).astype(np.int64), ends)


class PerfectHash:
    """A minimal perfect hash: hash and displace, n slots for n keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        h = hash_all(keys)
        home = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = order[first[b] : first[b] + sizes[b]]
            base = 0
            while True:
                tries = np.arange(base, base + 64, dtype=U64)
                slots = np.sort(self._slot(h[own][None, :], tries[:, None]), axis=1)
                good = ~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if good.any():
                    d = base + int(good.argmax())
                    break
                base += 64
            self.shift[b] = d
            slot_of[own] = self._slot(h[own], np.full(len(own), d, U64))
            taken[slot_of[own]] = True
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        self.shift[single] = -1 - free
        slot_of[order[first[single]]] = free
        self.value = np.zeros(n, np.int64)
        self.value[slot_of] = values
        self.check = np.zeros(n, U64)
        self.check[slot_of] = h

    def _slot(self, h, d):
        return (mix(h ^ (d * U64(0x9E3779B97F4A7C15))) % U64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Each key's value if it may be a key of the table, else -1; the caller compares the keys themselves."""
        h = hash_all(keys)
        d = self.shift[(h % U64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0).astype(U64)))
        return np.where(self.check[slot] == h, self.value[slot], -1)


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always merge the pair of lowest rank, the leftmost of equal ones."""
    n = len(piece)
    get, none, pop, push = ranks.get, -1, heapq.heappop, heapq.heappush
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    wanted = [get(piece[i : i + 2], none) for i in range(n - 1)]
    wanted.append(none)
    heap = [r << 40 | i for i, r in enumerate(wanted) if r >= 0]
    heapq.heapify(heap)
    while heap:
        x = pop(heap)
        i = x & 0xFFFFFFFFFF
        if wanted[i] != x >> 40:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        wanted[gone] = none
        if end < n:
            before[end] = i
            r = wanted[i] = get(piece[i : after[end]], none)
            if r >= 0:
                push(heap, r << 40 | i)
        else:
            wanted[i] = none
        p = before[i]
        if p >= 0:
            r = wanted[p] = get(piece[p:end], none)
            if r >= 0:
                push(heap, r << 40 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes lists of texts; ids come as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, table: PerfectHash | None = None, classes: np.ndarray | None = None):
        self.ranks = read_ranks(path)
        self.words = {i: b for b, i in self.ranks.items()}
        self.table = table or PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.classes = tiktoken_classes() if classes is None else classes
        self.kept = Kept(KEPT_BYTES)

    def learn(self, new: list[str]) -> None:
        raw = [x.encode("utf-8", "replace") for x in new]
        for text, piece, i in zip(new, raw, self.table.find(raw).tolist(), strict=True):
            ids = [i] if i >= 0 and self.words[i] == piece else heap_merge(piece, self.ranks)
            self.kept.add(text, pack("<%dI" % len(ids), *ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        tokens, at = split_pattern(texts, self.classes)
        self.kept.trim()
        new = list(set(tokens).difference(self.kept.table))
        if new:
            self.learn(new)
        ids = list(map(self.kept.table.__getitem__, tokens))
        return [b"".join(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, built: tuple[PerfectHash, np.ndarray] = (None, None)) -> Encoder:
    """This process's encoder for a rank file; `built`: its hash and its character classes if they exist already."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, *built)
    return _ENCODERS[path]


def _built(spark, path: str):
    """What all tasks' encoders share: as large as the vocabulary and the code points, whatever the input's size."""
    own = encoder(path)
    return spark.sparkContext.broadcast((own.table, own.classes))


def _append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [x for x in batch.schema.names if x not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in kept] + list(columns.values()), names=[*kept, *columns])


def _schema(docs: DataFrame, new: dict[str, str]) -> str:
    kept = docs.drop(*new)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return ", ".join([*fields, *(f"`{k}` {v}" for k, v in new.items())])


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (binary: packed little-endian unsigned 32-bit integers) and `n_tokens` to every row."""

    built = _built(docs.sparkSession, ranks_path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        ids = encoder(ranks_path, built.value).encode(texts)
        return _append(batch, ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()))

    return docs.mapInArrow(by_batch(work, text), _schema(docs, {"ids": "binary", "n_tokens": "bigint"}))


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes that the packed ids stand for (null ids: no bytes)."""

    built = _built(encoded.sparkSession, ranks_path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return _append(batch, decoded=pa.array([encoder(ranks_path, built.value).decode(x or b"") for x in packed], pa.binary()))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                yield work(batch.slice(a, 200))

    return encoded.mapInArrow(run, _schema(encoded, {"decoded": "binary"}))


def round_trip_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its packed ids and of what they decode to."""
    encoded = encode_documents(docs.select("doc_id", "text"), ranks_path).select("doc_id", "ids", "n_tokens")
    return decode_documents(encoded, ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
