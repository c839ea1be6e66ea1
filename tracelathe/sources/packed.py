"""Blocks of packed event records, written and read: variable length, with a dictionary of strings that grows along a block, and tagged values.

A record, little-endian: id u32, pid u32, tid u64, ts u64, dur u64, type u8, ph u8, number of values u16, the strings name and cat, then each value as tag
u8, the string key and what the tag says: 1 an i64, 2 a u64, 3 a double, 4 a text, 5 a piece of JSON (both u32 length and bytes). A string is a u16: with its
highest bit set a place in the block's dictionary, else the length of the bytes that follow, which become the dictionary's next entry while it has
room. So blocks are read alone, in any order and on any executor.

Values are (key, i, u, d, s, j), one of the last five set. A block that is cut off or has an unknown tag or place gives the records before
the fault and one row with `error`.
"""

from __future__ import annotations

import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = struct.Struct("<IIQQQBBH")
FIELD, SIZE = struct.Struct("<H"), struct.Struct("<I")
NUMBERS = struct.Struct("<q"), struct.Struct("<Q"), struct.Struct("<d")
MOST = 0x7FFF
VALUES = "array<struct<key string, i bigint, u decimal(20,0), d double, s string, j string>>"
EVENTS = f"id bigint, pid bigint, tid bigint, ts bigint, dur bigint, type int, ph int, name string, cat string, `values` {VALUES}"
_HEAD_FIELDS = ("id", "pid", "tid", "ts", "dur", "type", "ph")


def pack(rows) -> bytes:
    """One block of records (dicts with the columns of EVENTS)."""
    out, places = bytearray(), {}

    def text(value: str) -> None:
        data = (value or "").encode()
        if data in places:
            out.extend(struct.pack("<H", 0x8000 | places[data]))
            return
        if len(data) > MOST:
            raise ValueError("a name, category or key has at most 32767 bytes")
        out.extend(struct.pack("<H", len(data)) + data)
        if len(places) < MOST:
            places[data] = len(places)

    for row in rows:
        values = row["values"] or []
        out.extend(HEAD.pack(*(row[k] or 0 for k in _HEAD_FIELDS), len(values)))
        text(row["name"])
        text(row["cat"])
        for v in values:
            tag = next((n for n, k in enumerate("iudsj", 1) if v[k] is not None), 4)
            out.append(tag)
            text(v["key"])
            if tag <= 3:
                out.extend(struct.pack(("<q", "<Q", "<d")[tag - 1], int(v["u"]) if tag == 2 else v["iud"[tag - 1]]))
            else:
                data = (v["s"] if tag == 4 else v["j"] or "") or ""
                out.extend(struct.pack("<I", len(data.encode())) + data.encode())
    return bytes(out)


def unpack(data: bytes):
    """The records of a block, as dicts; raises ValueError or struct.error where it breaks off."""
    for row in _records(data):
        values = [dict.fromkeys("iudsj") | {"key": key, "iudsj"[tag - 1]: Decimal(value) if tag == 2 else value} for tag, key, value in row["values"]]
        yield row | {"values": values}


def _records(data: bytes):
    """The records of a block, as dicts with values as (tag, key, value); raises ValueError or struct.error where it breaks off."""
    at, words = 0, []

    def text() -> str:
        nonlocal at
        (field,) = FIELD.unpack_from(data, at)
        at += 2
        if field & 0x8000:
            if field & MOST >= len(words):
                raise ValueError("no such place in the dictionary")
            return words[field & MOST]
        found = view(field)
        if len(words) < MOST:
            words.append(found)
        return found

    def view(n: int) -> str:
        nonlocal at
        if at + n > len(data):
            raise ValueError("cut off")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    while at < len(data):
        *head, many = HEAD.unpack_from(data, at)
        at += HEAD.size
        row = dict(zip(_HEAD_FIELDS, head, strict=True)) | {"name": text(), "cat": text(), "values": []}
        for _ in range(many):
            if at >= len(data):
                raise ValueError("cut off")
            tag = data[at]
            at += 1
            key = text()
            if 1 <= tag <= 3:
                (value,) = NUMBERS[tag - 1].unpack_from(data, at)
                at += 8
            elif tag in (4, 5):
                (n,) = SIZE.unpack_from(data, at)
                at += 4
                value = view(n)
            else:
                raise ValueError(f"unknown tag {tag}")
            row["values"].append((tag, key, value))
        yield row


def pack_events(events: DataFrame, records: int = 4096) -> DataFrame:
    """(block, data): the events (columns of EVENTS) of each partition in blocks of so many records, in the order in which they come."""

    def run(batches):
        held = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= records:
                yield block(held[:records])
                held = held[records:]
        if held:
            yield block(held)

    def block(rows):
        return pa.RecordBatch.from_arrays([pa.array([pack(rows)], pa.binary())], names=["data"])

    whole = events.select(*(f.strip().split()[0].strip("`") for f in ("id", "pid", "tid", "ts", "dur", "type", "ph", "name", "cat", "values")))
    return whole.mapInArrow(run, "data binary").select(F.monotonically_increasing_id().alias("block"), "data")


class _Columns:
    """Records of blocks as columns, with the values in flat lists, and as a batch."""

    HEAD = dict.fromkeys(_HEAD_FIELDS[:5], pa.int64()) | {"type": pa.int32(), "ph": pa.int32()}
    KINDS = {"i": pa.int64(), "u": pa.decimal128(20, 0), "d": pa.float64(), "s": pa.string(), "j": pa.string()}

    def __init__(self):
        self.heads, self.names, self.cats, self.ends, self.keys, self.tags, self.values, self.faults = [], [], [], [0], [], [], [], []

    def add(self, row: dict) -> None:
        self.heads.append([row[k] for k in _HEAD_FIELDS])
        self.names.append(row["name"])
        self.cats.append(row["cat"])
        for tag, key, value in row["values"]:
            self.keys.append(key)
            self.tags.append(tag)
            self.values.append(value)
        self.ends.append(len(self.keys))
        self.faults.append(None)

    def fault(self, error: str) -> None:
        self.heads.append([None] * len(_HEAD_FIELDS))
        self.names.append(None)
        self.cats.append(None)
        self.ends.append(len(self.keys))
        self.faults.append(error)

    def batch(self) -> pa.RecordBatch:
        heads = list(zip(*self.heads, strict=True))
        tags = np.array(self.tags, np.int8)
        parts = [pa.array(self.keys, pa.string())]
        for n, (name, kind) in enumerate(self.KINDS.items(), 1):
            own = np.flatnonzero(tags == n)
            found = [self.values[k] for k in own.tolist()]
            known = _unsigned(found) if name == "u" else pa.array(found, kind)
            place = np.zeros(len(tags), np.int32)
            place[own] = np.arange(len(own), dtype=np.int32)
            parts.append(known.take(pa.array(place, mask=tags != n)))
        value = pa.struct([("key", pa.string()), *self.KINDS.items()])
        entries = pa.StructArray.from_arrays(parts, fields=list(value))
        ends = np.array(self.ends, np.int32)
        none = np.array([x is not None for x in self.faults] + [False])  # a fault's row has no list
        columns = [pa.array(c, t) for c, t in zip(heads, self.HEAD.values(), strict=True)] + [pa.array(self.names, pa.string()), pa.array(self.cats, pa.string())]
        columns += [pa.ListArray.from_arrays(pa.array(ends, mask=none), entries, type=pa.list_(value)), pa.array(self.faults, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*self.HEAD, "name", "cat", "values", "error"])


def _unsigned(values: list[int]) -> pa.Array:
    """64-bit unsigned numbers as decimals, by their bytes."""
    data = np.zeros((len(values), 2), np.uint64)
    data[:, 0] = np.array(values, np.uint64)
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(data.tobytes())])


def unpack_events(blocks: DataFrame) -> DataFrame:
    """The events of blocks (column `data`), and `error`: null, or why a block breaks off there."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = _Columns()
                try:
                    for row in _records(data.as_py() or b""):
                        rows.add(row)
                        if len(rows.heads) == 4096:
                            yield rows.batch()
                            rows = _Columns()
                except (ValueError, struct.error) as fault:
                    rows.fault(str(fault))
                if rows.heads:
                    yield rows.batch()

    return blocks.select("data").mapInArrow(run, f"{EVENTS}, error string")
