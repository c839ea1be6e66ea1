"""Traces read by ranges of time or id: an index of blocks of lines, and a data source that reads only the blocks that a filter needs.

The index is a table with a row per block of a plain file's lines: file, first byte, bytes, first line, lines, and the extremes of ts and id. It is built
in one pass over ranges of files, by as many tasks. `spark.read.format("traced")` takes it as an option; filters on ts and id reach its
reader, which chooses blocks by their extremes and reads these by seek, neighbours in one stretch of up to TASK bytes. Every filter is checked on
the rows again, so blocks only have to be enough. The driver holds the index rows of the chosen blocks (one per MB of trace), so a whole trace is better
read by `sources.traces`. Gzip traces are cut at their members (`sources.members`), which are read whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

from tracelathe.operators.written import written
from tracelathe.sources.members import dealt, file_ranges, located, open_file
from tracelathe.sources.traces import parse_events

#: Bytes of lines in a block of the index, and of a range that one task indexes.
BLOCK = 1 << 20
RANGE = 64 << 20
CHUNK = 4 << 20
#: Bytes of neighbouring blocks that one task reads.
TASK = 32 << 20
SCHEMA = "file string, line bigint, id bigint, ts bigint, value string"


def _line_table(data: bytes, at: int, file: str) -> pa.RecordBatch:
    """The lines of bytes that end with a line feed, with their offsets, without a Python object per line."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    places = np.append(starts, len(data)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array([file] * len(ends)), pa.array(starts + at), values.cast(pa.binary())], names=["file", "offset", "value"])


def lines_at(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """(file, offset, value): the lines of plain files with the place of their first byte; each range's task reads the lines that begin in it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["file"]) as file:
                    at, past, held = row["first"], row["past"], b""
                    if at:  # a line that began before belongs to the range before
                        at = _next_line(file, at - 1, row["length"])
                    file.seek(at)
                    read = at
                    while at < past:
                        part = file.read(CHUNK)
                        read += len(part)
                        held += part if part else b"\n" if held else b""
                        if not held:
                            break
                        whole = held[: held.rfind(b"\n") + 1]
                        if whole:
                            if at + len(whole) > past:  # up to the end of the line that holds the range's last byte
                                cut = whole.find(b"\n", max(0, past - at - 1)) + 1
                                whole = whole[:cut]
                            yield _line_table(whole, at, row["file"])
                            at += len(whole)
                            held = held[len(whole) :]
                        if not part:
                            break

    ranges = dealt(file_ranges(spark, path, size), size)
    rows = ranges.mapInArrow(run, "file string, offset bigint, value binary")
    return rows.select("file", "offset", F.octet_length("value").alias("bytes"), F.decode("value", "utf-8").alias("value"))


def _next_line(file, at: int, length: int) -> int:
    """The first place past a line feed at or after `at`."""
    file.seek(at)
    while at < length:
        part = file.read(1 << 16)
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return length


def build_index(spark: SparkSession, path: str | list[str], block: int = BLOCK, size: int = RANGE) -> DataFrame:
    """(file, first_byte, bytes, first_line, lines, min_ts, max_ts, min_id, max_id) per block of lines that begin in it."""
    lines = lines_at(spark, path, size)
    events = lines.withColumn("v", F.expr("try_parse_json(regexp_replace(trim(value), ',$', ''))"))
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string").try_cast("bigint")
    number = F.call_function("div", F.col("offset"), F.lit(block)).alias("block")
    blocks = events.groupBy("file", number).agg(
        F.min("offset").alias("first_byte"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("lines"),
        F.min(get("ts")).alias("min_ts"), F.max(get("ts")).alias("max_ts"), F.min(get("id")).alias("min_id"), F.max(get("id")).alias("max_id"),
    )
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return written(blocks).select("file", "first_byte", "bytes", F.coalesce(before, F.lit(0)).alias("first_line"), "lines", "min_ts", "max_ts", "min_id", "max_id")


@dataclass
class Block(InputPartition):
    file: str
    first_byte: int
    bytes: int
    first_line: int


class IndexedReader(DataSourceReader):
    """Chooses blocks by the filters on ts and id and reads them."""

    def __init__(self, options: dict):
        self.index, self.low, self.high = options["index"], {}, {}

    def pushFilters(self, filters):
        for one in filters:
            if isinstance(one, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)) and one.attribute in (("ts",), ("id",)):
                (name,) = one.attribute
                if isinstance(one, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[name] = max(one.value, self.low.get(name, one.value))
                if isinstance(one, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[name] = min(one.value, self.high.get(name, one.value))
        return filters  # each is checked on the rows again

    def partitions(self):
        where = None
        for name, edge, over in ((n, e, o) for o, table in ((True, self.low), (False, self.high)) for n, e in table.items()):
            one = ds.field(f"max_{name}") >= edge if over else ds.field(f"min_{name}") <= edge
            where = one if where is None else where & one
        index = _arrow_dataset(self.index).to_table(columns=["file", "first_byte", "bytes", "first_line"], filter=where)
        chosen: list[Block] = []
        for row in index.sort_by([("file", "ascending"), ("first_byte", "ascending")]).to_pylist():
            last = chosen[-1] if chosen else None
            if last and last.file == row["file"] and last.first_byte + last.bytes == row["first_byte"] and last.bytes < TASK:
                last.bytes += row["bytes"]
            else:
                chosen.append(Block(**row))
        return chosen

    def read(self, partition: Block):
        with open_file(partition.file) as file:
            file.seek(partition.first_byte)
            data = file.read(partition.bytes)
        lines = data.decode("utf-8", "replace").split("\n")
        if lines[-1] == "":
            lines.pop()
        for k, line in enumerate(lines):
            try:
                record = json.loads(line.strip().rstrip(","))
            except ValueError:
                record = None
            head = record if isinstance(record, dict) else {}
            yield partition.file, partition.first_line + k, _whole(head.get("id")), _whole(head.get("ts")), line


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _arrow_dataset(path: str):
    system, place = located(path)
    return ds.dataset(place, filesystem=system, format="parquet")


class IndexedTrace(DataSource):
    """`spark.read.format("traced").option("index", <folder>)`: lines of indexed traces with file, line, id and ts."""

    @classmethod
    def name(cls) -> str:
        return "traced"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options)


def read_indexed(spark: SparkSession, index: str) -> DataFrame:
    """The lines of an index's files; conditions on ts and id choose the blocks that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedTrace)
    return spark.read.format("traced").option("index", index).load()


def indexed_events(spark: SparkSession, index: str, first_ts: int, past_ts: int) -> DataFrame:
    """The events of a time range."""
    return parse_events(read_indexed(spark, index).filter((F.col("ts") >= first_ts) & (F.col("ts") < past_ts)).select("file", "value"))
