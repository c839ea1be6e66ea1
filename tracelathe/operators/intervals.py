"""Interval algebra: unions, differences, overlaps and containment, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators.bins import bin_width
from tracelathe.operators.joins import asof_last, same_keys


def running(rows: DataFrame, keys: list[str], at: str, ties: list[str], sums: list[str], width: int | float) -> DataFrame:
    """Adds for each column its running sum per key in the order of `at` and `ties` (`<column>_so_far`, with the row itself), and `next_at`.

    Rows are swept per key and bin of `width`; what earlier bins add up to is one row per bin, summed in a table of bins and joined.
    So a key's rows are spread over as many tasks as it has bins. Rows without `at` come first, as one bin.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(at) / width))
    whole = binned.groupBy(*keys, "_bin").agg(*(F.sum(c).alias(f"_{c}") for c in sums), F.min(at).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_bin")
    before = [F.coalesce(F.sum(f"_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_before") for c in sums]
    carried = whole.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_bin").alias("_of"), *before, F.lead("_first").over(over).alias("_next"))
    own = Window.partitionBy(*keys, "_bin").orderBy(at, *ties)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    swept = binned.select("*", *(F.sum(c).over(so_far).alias(f"_{c}_own") for c in sums), F.lead(at).over(own).alias("_lead"))
    on = F.col("_bin").eqNullSafe(F.col("_of"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = swept.join(carried, on)
    return joined.select(*rows.columns, *((F.col(f"_{c}_own") + F.col(f"_{c}_before")).alias(f"{c}_so_far") for c in sums), F.coalesce("_lead", "_next").alias("next_at"))


def _timed(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull())


def interval_union(rows: DataFrame, keys: list[str], start: str = "ts", end: str = "te", width: int | None = None) -> DataFrame:
    """Maximal intervals (keys, s, e) that the rows' closed intervals cover; touching ones join. Rows without start or end take no part.

    Swept by bins of `width`, which follows from the rows' range and count if it isn't given.
    """
    rows, width = _timed(rows, start, end), width or bin_width(rows, start)
    ends = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))
    marks = rows.select(*keys, F.explode(ends).alias("m")).select(*keys, "m.*").groupBy(*keys, "at", F.when(F.col("step") > 0, 0).otherwise(1).alias("kind")).agg(F.sum("step").alias("step"))
    open_ = running(marks, keys, "at", ["kind"], ["step"], width)
    edges = open_.withColumn("opens", F.when(F.col("step_so_far") == F.col("step"), 1).otherwise(0)).filter("opens = 1 and kind = 0 or step_so_far = 0")
    edges = edges.withColumn("opens", F.when(F.col("kind") == 0, 1).otherwise(0)).select(*keys, "at", "kind", "opens")
    island = running(edges, keys, "at", ["kind"], ["opens"], width)
    return island.groupBy(*keys, "opens_so_far").agg(F.min("at").alias("s"), F.max("at").alias("e")).drop("opens_so_far")


def overlap_times(rows: DataFrame, keys: list[str], io: Column, compute: Column, start: str = "ts", end: str = "te", width: int | None = None) -> DataFrame:
    """Per key the time with I/O, with compute, with both, and with either alone: one sweep over the ends of intervals, by bins of `width`.

    Rows without start or end take no part.
    """
    rows, width = _timed(rows, start, end), width or bin_width(rows, start)
    marks = rows.select(
        *keys,
        F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("m"),
        io.cast("int").alias("_io"),
        compute.cast("int").alias("_compute"),
    ).select(*keys, "m.at", (F.col("m.step") * F.col("_io")).alias("io"), (F.col("m.step") * F.col("_compute")).alias("compute"))
    steps = marks.groupBy(*keys, "at").agg(F.sum("io").alias("io"), F.sum("compute").alias("compute"))
    open_ = running(steps, keys, "at", [], ["io", "compute"], width)
    i, c, wide = F.col("io_so_far") > 0, F.col("compute_so_far") > 0, F.col("next_at") - F.col("at")
    total = lambda when, name: F.coalesce(F.sum(F.when(when, wide)), F.lit(0)).cast("bigint").alias(name)
    return open_.groupBy(*keys).agg(total(i, "io_time"), total(c, "compute_time"), total(i & c, "both_time"), total(i & ~c, "only_io"), total(c & ~i, "only_compute"))


def overlap_degrees(rows: DataFrame, keys: list[str], node: str = "id", start: str = "ts", end: str = "te", width: int | None = None) -> DataFrame:
    """(keys, id, degree): how many other rows overlap each one (more than touch), counted without making pairs; rows with none are left out.

    Rows that start before my end, less those that end at or before my start; rows without length at one point don't meet.
    Rows without start or end take no part.
    """
    rows, width = _timed(rows, start, end), width or bin_width(rows, start)
    s, e = F.col(start), F.col(end)
    mark = lambda at, kind, ds, de, probe: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(ds).alias("starts"), F.lit(de).alias("ends"), F.lit(probe).alias("probe"))
    marks = rows.select(*keys, node, (s == e).alias("_empty"), F.explode(F.array(mark(e, 0, 0, 1, 0), mark(s, 1, 0, 0, 1), mark(e, 1, 0, 0, 2), mark(s, 2, 1, 0, 0))).alias("m")).select(*keys, node, "_empty", "m.*")
    seen = running(marks, keys, "at", ["kind"], ["starts", "ends"], width).filter("probe > 0")
    counts = seen.groupBy(*keys, node, "_empty").agg(F.max(F.when(F.col("probe") == 2, F.col("starts_so_far"))).alias("_starts"), F.max(F.when(F.col("probe") == 1, F.col("ends_so_far"))).alias("_ends"), F.max(F.when(F.col("probe") == 1, F.col("at"))).alias("_at"))
    points = rows.filter(s == e).groupBy(*keys, s.alias("_at")).agg(F.count(F.lit(1)).alias("_same"), F.lit(True).alias("_empty"))
    degree = F.col("_starts") - F.col("_ends") + F.when(F.col("_empty"), F.coalesce("_same", F.lit(0))).otherwise(-1)
    return counts.join(points, [*keys, "_at", "_empty"], "left").select(*keys, node, degree.cast("bigint").alias("degree")).filter("degree > 0")


def _binned(rows: DataFrame, start: str, end: str, width: int, suffix: str) -> DataFrame:
    named = rows.select(*(F.col(c).alias(c + suffix) for c in rows.columns))
    first, last = (F.floor(F.col(c + suffix) / width) for c in (start, end))
    return named.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_edges(rows: DataFrame, width: int, keys: list[str] = (), node: str = "id", start: str = "ts", end: str = "te") -> DataFrame:
    """Pairs (a, b), a < b, of rows whose intervals overlap (more than touch), per key.

    Intervals meet by the time bins that they cover, an equi-join; a pair that shares several bins is kept in the bin
    of the later start. Choose `width` near the long durations: rows are copied once per bin that they cover.
    """
    slim = rows.select(*keys, node, start, end)
    a, b = _binned(slim, start, end, width, "_a"), _binned(slim, start, end, width, "_b")
    same = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys]
    on = a["_bin"] == b["_bin"]
    for x in same:
        on = on & x
    later = F.floor(F.greatest(f"{start}_a", f"{start}_b") / width)
    meet = (F.col(f"{node}_a") < F.col(f"{node}_b")) & (F.col(f"{start}_a") < F.col(f"{end}_b")) & (F.col(f"{start}_b") < F.col(f"{end}_a"))
    return a.join(b, on & meet & (a["_bin"] == later)).select(*(F.col(f"{k}_a").alias(k) for k in keys), F.col(f"{node}_a").alias("a"), F.col(f"{node}_b").alias("b"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def outer_steps(regions: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """The regions (region, rs, re) that end later than all that start before them, per key: the others are never the first to hold anything."""
    width = width or bin_width(regions, "rs")
    rows = _timed(regions, "rs", "re").select(*keys, "region", "rs", "re", F.floor(F.col("rs") / width).alias("_bin"))
    earlier = Window.unboundedPreceding, -1
    tops = rows.groupBy(*keys, "_bin").agg(F.max("re").alias("_top"))
    carried = tops.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_bin").alias("_of__bin"), F.max("_top").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*earlier)).alias("_before"))
    own = F.max("re").over(Window.partitionBy(*keys, "_bin").orderBy("rs", "region").rowsBetween(*earlier))
    met = rows.withColumn("_own", own).join(carried, same_keys([*keys, "_bin"]))
    past = F.greatest("_own", "_before")
    return met.filter(past.isNull() | (F.col("re") > past)).select(*keys, "region", "rs", "re")


def contained_in(events: DataFrame, regions: DataFrame, keys: list[str] = (), width: int | None = None) -> DataFrame:
    """Each event (id, ts, te) with the first region (region, rs, re) that holds it, per key; events without one are left out.

    Two sweeps, no copies of regions: among the regions that end later than all before them, ends rise with starts, so an event's is the
    next one by its end (an as-of join on the ends, backwards), if that one starts early enough.
    """
    keys = list(keys)
    steps = outer_steps(regions, keys, width).select(*keys, (-F.col("re")).alias("_back"), F.struct("rs", "region").alias("_first"))
    found = asof_last(events.select(*keys, "id", "ts", (-F.col("te")).alias("_back")), steps, keys, "_first", "_back")
    return found.filter("_first.rs <= ts").select(*keys, "id", F.col("_first.region").alias("region"))


def int_ranges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: keys, low, high, n."""
    order = Window.partitionBy(*keys).orderBy(value)
    island = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(order))
    return island.groupBy(*keys, "_island").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).drop("_island")
