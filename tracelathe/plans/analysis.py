"""Analyses of traces: derived columns, summaries, views by time and layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.operators.intervals import overlap_times
from tracelathe.operators.stats import operation_summary


def conditions() -> dict[str, Column]:
    """Default predicates of the overlap analysis by name."""
    return {"app_io": F.col("name").contains("item"), "compute": F.col("name").contains("compute"), "io": F.col("cat").isin("POSIX", "STDIO")}


def with_analysis_columns(events: DataFrame, granularity: int, extra: dict[str, Column] | None = None, midpoint: bool = False) -> DataFrame:
    """Adds te, phase (1: compute, 2: POSIX, which wins), trange, and further columns.

    trange is half of the end time over the granularity; with `midpoint` it is the middle of the interval.
    """
    end = F.col("ts") + F.col("dur")
    middle = (F.col("ts") + end) if midpoint else end
    phase = F.when(F.col("cat").contains("POSIX"), 2).when(F.col("name").contains("compute"), 1).otherwise(0)
    more = {"te": end, "phase": phase, "trange": F.floor(middle / 2 / granularity).cast("bigint")}
    return events.withColumns(more | (extra or {}))


def io_size(cat: Column, name: Column, ret: Column, image_size: Column | None = None) -> Column:
    """Bytes of an operation: in layer POSIX what writes and reads (not readdir) return, in others the image's size."""
    moved = name.contains("write") | name.contains("read") & ~name.contains("readdir")
    image = image_size if image_size is not None else F.lit(None).cast("bigint")
    return F.when(cat == "POSIX", F.when(moved, ret)).otherwise(image)


class Analyzer:
    """Views of one event table with the derived columns and `size`."""

    def __init__(self, events: DataFrame, granularity: int = 10_000):
        self.events = with_analysis_columns(events, granularity)

    def totals(self) -> DataFrame:
        e = self.events
        return e.agg(
            F.countDistinct("pid").alias("processes"), F.countDistinct("tid").alias("threads"), F.countDistinct("name").alias("operations"),
            F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("te").alias("last"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        )

    def times(self, keys: list[str]) -> DataFrame:
        return overlap_times(self.events, keys, F.col("phase") == 2, F.col("phase") == 1)

    def summary(self) -> DataFrame:
        return operation_summary(self.events.filter("phase = 2"))

    def flat_view(self, by: str) -> DataFrame:
        return self.events.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("time"), F.coalesce(F.sum("size"), F.lit(0)).alias("data_size"))

    def layer_view(self, cat: str, by: str) -> DataFrame:
        """Per view of one layer: data size and count, the longest event, bins of sizes, and the mean transfer (0 without any)."""
        bins = {"bin_0_4kb": (0, 4096), "bin_4_64kb": (4096, 65536), "bin_64kb_1mb": (65536, 1 << 20), "bin_1mb_": (1 << 20, 1 << 62)}
        counted = [F.count_if((F.col("size") >= a) & (F.col("size") < b)).alias(n) for n, (a, b) in bins.items()]
        view = self.events.filter(F.col("cat") == cat).groupBy(by).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("data_size_sum"), F.count("size").alias("data_count_sum"), F.max("dur").alias("time_max"), *counted)
        return view.withColumn("avg_xfer", F.coalesce(F.try_divide(F.col("data_size_sum").cast("double"), F.col("data_count_sum")), F.lit(0.0)))


def entities_by_phase(events: DataFrame, columns: tuple[str, ...], phase: str = "phase") -> DataFrame:
    """(phase, entity, value): each different value of each column by phase, as rows, so lists may be of any length; nulls are none."""
    kinds = F.array(*(F.struct(F.lit(c).alias("entity"), F.col(c).cast("string").alias("value")) for c in columns))
    return events.select(phase, F.explode(kinds).alias("x")).select(phase, "x.*").filter("value is not null").distinct()


def entity_counts(events: DataFrame, columns: tuple[str, ...], phase: str = "phase") -> DataFrame:
    """How many different values each column has, by phase."""
    return events.groupBy(phase).agg(*(F.countDistinct(c).alias(c) for c in columns))


def duration_of(events: DataFrame, name: str, cat: str | None = None, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """The longest of the processes' total times in an operation, in seconds; keys: what tells processes apart."""
    own = events.filter(F.col("name") == name) if cat is None else events.filter((F.col("name") == name) & (F.col("cat") == cat))
    return own.groupBy(*keys).agg(F.sum("dur").alias("d")).agg((F.max("d") / 1e6).alias("seconds"))


def slice_sql(events: DataFrame, text: str) -> DataFrame:
    """SQL in the trace viewer's terms; the text names its tables {slice}, {thread} and {thread_track}."""
    slices = events.select("id", "name", "cat", "ts", "dur", F.col("tid").alias("track_id"))
    threads = events.select(F.col("tid").alias("utid"), "tid", "pid").distinct()
    tracks = events.select(F.col("tid").alias("id"), F.col("tid").alias("utid")).distinct()
    return events.sparkSession.sql(text, slice=slices, thread=threads, thread_track=tracks)


def processes(metadata: DataFrame) -> DataFrame:
    """One row per process of (pid, key, value, ts) metadata: the last value of every key, as a map."""
    last = metadata.groupBy("pid", "key").agg(F.max_by("value", "ts").alias("value"))
    return last.groupBy("pid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("app"))
