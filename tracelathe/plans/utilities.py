"""Trace utilities as transformations of line tables (file, value, and an order within files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.functions.scalars import anonymize as user_replaced
from tracelathe.functions.scalars import pid_of_file, strip_unprintable
from tracelathe.operators.bins import bin_width
from tracelathe.operators.intervals import running
from tracelathe.sources.traces import event_lines, json_line, viewer_events, write_trace


def merge(*traces: DataFrame) -> DataFrame:
    """All event lines of the traces, without framing."""
    whole = traces[0]
    for t in traces[1:]:
        whole = whole.unionByName(t)
    return event_lines(whole)


#: Lines of one block; a file's blocks are summed in tasks of their own, and a table of blocks has what comes before each.
BLOCK_LINES = 1 << 16


def split(lines: DataFrame, chunk_bytes: int, group: str = "file", order: str = "line", ties: tuple[str, ...] = (), width: int | float = BLOCK_LINES) -> DataFrame:
    """Adds `chunk`: a group's lines in order, cut where their bytes (with line feeds) pass multiples of chunk_bytes; nothing is lost or doubled.

    Bytes are added up per block of `width` in the unit of `order`, so a file of any size is spread over tasks.
    """
    placed = running(lines.withColumn("_size", F.octet_length("value") + 1), [group], order, list(ties), ["_size"], width)
    return placed.select(*lines.columns, F.floor((F.col("_size_so_far") - F.col("_size")) / chunk_bytes).cast("bigint").alias("chunk"))


def compact(lines: DataFrame, lines_per_file: int, group: str = "file", order: str = "line", ties: tuple[str, ...] = (), width: int | float = BLOCK_LINES) -> DataFrame:
    """Adds `part`: a group's lines in order, so many a part; counted by blocks, as in `split`."""
    placed = running(lines.withColumn("_one", F.lit(1)), [group], order, list(ties), ["_one"], width)
    return placed.select(*lines.columns, F.call_function("div", F.col("_one_so_far") - 1, F.lit(lines_per_file)).alias("part"))


def compact_by_pid(lines: DataFrame, lines_per_file: int, order: str = "line") -> DataFrame:
    """The lines of one process's files, by the pid in their names, so many a part, in the order of lines and files."""
    return compact(lines.withColumn("pid", pid_of_file(F.col("file"))), lines_per_file, "pid", order, ("file",))


def event_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count_if(F.length("value") > 8).alias("events"))


def index(events: DataFrame, by: str = "file") -> DataFrame:
    """What is needed to choose files: rows and the range of ids and times of each."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def sanitize(lines: DataFrame) -> DataFrame:
    """Without unprintable signs and without lines that aren't JSON then."""
    return event_lines(lines.withColumn("value", strip_unprintable(F.col("value")))).filter(F.expr("try_parse_json(value)").isNotNull())


def anonymize(lines: DataFrame, user: str) -> DataFrame:
    return lines.withColumn("value", user_replaced(F.col("value"), user))


def recompress(lines: DataFrame, path: str) -> None:
    lines.select("value").write.option("compression", "gzip").text(path)


def viewer_file(events: DataFrame, path: str) -> None:
    """A folder of JSON lines in the viewer's format, which reads them without the enclosing array."""
    write_trace(viewer_events(events), path)


def viewer_arrays(events: DataFrame, chunk_bytes: int = 64 << 20, group: str = "pid") -> DataFrame:
    """(group, chunk, value): whole JSON arrays in the viewer's format, each of about chunk_bytes of a group's events in order of time."""
    shown = viewer_events(events)
    lines = split(shown.select(group, "ts", "id", json_line(shown).alias("value")), chunk_bytes, group, "ts", ("id",), bin_width(events, "ts"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "value"))), lambda x: x["value"])
    return lines.groupBy(group, "chunk").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("value"))


def write_rolled(lines: DataFrame, path: str, megabytes: float, group: str = "file", order: str = "line") -> None:
    """One folder per group and chunk of so many MB; lines are whole."""
    split(lines, int(megabytes * (1 << 20)), group, order).select(group, "chunk", "value").write.partitionBy(group, "chunk").option("compression", "gzip").text(path)


def write_summary(rows: DataFrame, path: str, order: list[str]) -> None:
    """A table of a few groups as one CSV file with a header."""
    rows.orderBy(*order).coalesce(1).write.option("header", True).csv(path)


def preview(events: DataFrame, n: int = 10, last: bool = False) -> DataFrame:
    """The first or last n events by time."""
    return events.orderBy(F.desc("ts") if last else F.asc("ts"), F.desc("id") if last else F.asc("id")).limit(n)


def sampled(events: DataFrame, one_in: int, by: str = "id") -> DataFrame:
    """Every event whose id's hash is divisible by `one_in`: the same ones on every run and partitioning."""
    return events.filter(F.conv(F.substring(F.md5(F.col(by).cast("string").cast("binary")), 1, 6), 16, 10).cast("bigint") % one_in == 0)
