"""Gzip files as their members, in bounded memory and in many tasks for a file of any size.

A file is cut into ranges. A task looks for the first member that begins in its range: a place with a member's head at which inflation runs to a
valid end (checksum and length). From there on members follow each other, the last one past the range's end if it must. Bytes are read and inflated
in pieces of CHUNK, so memory depends neither on the file's size nor on a member's. What no task could read shows as gaps between members: at a
file's end a member that is cut off, elsewhere one that is broken; the members after it are found again.

Files are opened by their path through Arrow's file systems (local, HDFS, object stores), which can seek.
"""

from __future__ import annotations

import gzip
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators.written import written

CHUNK = 1 << 20
#: Bytes that are read of a member at first, as many are small; then twice as many, up to CHUNK.
FIRST = 16 << 10
#: Bytes of a file that one task looks through.
RANGE = 64 << 20
#: Fixed value: how a gzip member with deflated content begins.
HEAD = b"\x1f\x8b\x08"


def located(path: str):
    """The file system and the place in it of a path or address."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_file(path: str):
    """A file of any store that Arrow knows, with seek and read."""
    system, place = located(path)
    return system.open_input_file(place)


def file_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """(file, length, first, past): stretches of files, from a listing alone."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("first")
    return files.select("file", "length", starts).withColumn("past", F.least(F.col("first") + size, "length"))


def dealt(ranges: DataFrame, size: int) -> DataFrame:
    """The ranges over as many tasks as keep all cores busy, none with more than about RANGE bytes; Spark joins partitions of so few bytes unless it is given a number."""
    many = ranges.count()
    tasks = max(4 * ranges.sparkSession.sparkContext.defaultParallelism, many * size // RANGE + 1)
    return ranges.repartition(max(1, min(many, tasks)))


class Inflated:
    """A member's text in pieces: iterate, then read `end`, the offset past it; None if it is cut off or broken."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.offset, self.length, self.end = file, offset, length, None

    def __iter__(self):
        inflate, at, step = zlib.decompressobj(31), self.offset, FIRST
        self.file.seek(at)
        try:
            while not inflate.eof:
                part = self.file.read(min(step, self.length - at))
                step = min(2 * step, CHUNK)
                if not part:
                    rest = inflate.decompress(b"", CHUNK)  # text that is still held back
                    if not rest:
                        return
                    yield rest
                at += len(part)
                while part and not inflate.eof:
                    yield inflate.decompress(part, CHUNK)
                    part = inflate.unconsumed_tail
            self.end = at - len(inflate.unused_data)
        except zlib.error:
            return


def first_member(file, first: int, past: int, length: int) -> int | None:
    """Where the first whole member begins that begins in a range."""
    at = first
    while at < past:
        file.seek(at)
        part = file.read(min(CHUNK, past - at) + len(HEAD) - 1)
        found = part.find(HEAD)
        while found >= 0 and at + found < past:
            whole = Inflated(file, at + found, length)
            for _ in whole:
                pass
            if whole.end is not None:
                return at + found
            found = part.find(HEAD, found + 1)
        at += CHUNK
    return None


def _walk(row):
    """(offset, Inflated) of the members that begin in a range."""
    with open_file(row["file"]) as file:
        at = first_member(file, row["first"], row["past"], row["length"])
        while at is not None and at < row["past"]:
            member = Inflated(file, at, row["length"])
            yield at, member
            at = member.end if member.end is not None else first_member(file, at + 1, row["past"], row["length"])


def _lines(pieces):
    """Lines of pieces of text; a line is held until its end has come."""
    rest = b""
    for piece in pieces:
        whole, feed, rest = (rest + piece).rpartition(b"\n")
        if feed:
            yield from whole.split(b"\n")
    if rest:
        yield rest


def member_lines(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """(file, offset, line, value): the lines of the members of gzip files, numbered from 0 in each member; of a broken or cut-off one up to the fault."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(file, offset, first, lines):
            n = len(lines)
            columns = [[file] * n, [offset] * n, list(range(first, first + n)), [x.decode("utf-8", "replace") for x in lines]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "line", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                for offset, member in _walk(row):
                    held, first, held_bytes = [], 0, 0
                    for line in _lines(member):
                        held.append(line)
                        held_bytes += len(line)
                        if held_bytes >= CHUNK:
                            yield batch_of(row["file"], offset, first, held)
                            first, held, held_bytes = first + len(held), [], 0
                    if held:
                        yield batch_of(row["file"], offset, first, held)

    ranges = file_ranges(spark, path, size)
    return dealt(ranges, size).mapInArrow(run, "file string, offset bigint, line bigint, value string")


def members(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """One row per member and per gap: file, member (from 1), offset, size, state (good, broken, cut off), raw_size, lines, whole_last_line."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for offset, member in _walk(row):
                    raw, feeds, last = 0, 0, b"\n"
                    for piece in member:
                        raw, feeds, last = raw + len(piece), feeds + piece.count(b"\n"), piece[-1:] or last
                    if member.end is not None:
                        columns = [[row["file"]], [offset], [member.end - offset], [raw], [feeds + (last != b"\n")], [last == b"\n"]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "offset", "size", "raw_size", "lines", "whole_last_line"])

    ranges = file_ranges(spark, path, size)
    good = written(dealt(ranges, size).mapInArrow(run, "file string, offset bigint, size bigint, raw_size bigint, lines bigint, whole_last_line boolean"))
    order = Window.partitionBy("file").orderBy("offset")
    ends = good.select("file", "offset", (F.col("offset") + F.col("size")).alias("past")).union(ranges.select("file", F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")).distinct())
    length = ranges.select("file", "length").distinct().withColumnRenamed("file", "_file")
    after = ends.withColumn("next", F.lead("offset").over(order)).join(length, F.col("file") == F.col("_file"))
    gap = after.select("file", F.col("past").alias("offset"), (F.coalesce("next", "length") - F.col("past")).alias("size"), F.when(F.col("next").isNull(), "cut off").otherwise("broken").alias("state")).filter("size > 0")
    every = good.withColumn("state", F.lit("good")).unionByName(gap, allowMissingColumns=True)
    return every.select("file", F.row_number().over(order).alias("member"), "offset", "size", "state", "raw_size", "lines", "whole_last_line")


def member_checks(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """`members` with records (lines that hold JSON) and bad_lines (that should), and `splittable`: a whole member of whole lines, all good."""
    body = F.regexp_replace(F.trim("value"), ",$", "")
    shown = ~body.isin("", "[", "]")
    parsed = F.expr("try_parse_json(regexp_replace(trim(value), ',$', ''))").isNotNull()
    lines = member_lines(spark, path, size).groupBy("file", "offset").agg(F.count_if(shown & parsed).alias("records"), F.count_if(shown & ~parsed).alias("bad_lines"))
    zero = lambda c: F.when(F.col("state") == "good", F.coalesce(c, F.lit(0))).alias(c)
    found = members(spark, path, size).join(lines, ["file", "offset"], "left")
    good = (F.col("state") == "good") & F.coalesce(F.col("whole_last_line"), F.lit(False)) & (F.coalesce("bad_lines", F.lit(0)) == 0)
    return found.select("file", "member", "offset", "size", "state", "raw_size", "lines", "whole_last_line", zero("records"), zero("bad_lines"), good.alias("splittable"))


def write_members(lines: DataFrame, folder: str, lines_per_member: int) -> DataFrame:
    """Writes each partition's lines (column `value`) as one gzip file of members of whole lines; returns (file, members, lines), already written.

    A task writes under a name of its attempt and renames the file when it is whole, so repeated tasks leave one file.
    """

    def run(batches):
        context = TaskContext.get()
        system, place = located(folder)
        system.create_dir(place)
        name = f"part-{context.partitionId():05d}.gz"
        own = f"{place}/_{context.taskAttemptId()}-{name}"
        held, members, total = [], 0, 0
        with system.open_output_stream(own, compression=None) as out:
            for batch in batches:
                held += batch.column(0).to_pylist()
                while len(held) >= lines_per_member:
                    out.write(packed(held[:lines_per_member]))
                    held, members, total = held[lines_per_member:], members + 1, total + lines_per_member
            if held:
                out.write(packed(held))
                members, total = members + 1, total + len(held)
        system.move(own, f"{place}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([members]), pa.array([total])], names=["file", "members", "lines"])

    def packed(rows):
        return gzip.compress("".join(f"{x or ''}\n" for x in rows).encode(), 6, mtime=0)

    return written(lines.select("value").mapInArrow(run, "file string, members bigint, lines bigint"))
