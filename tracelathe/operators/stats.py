"""Statistics of benchmarks and summaries of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators.selection import null_safe, quantiles, trimmed


def _with_quantiles(sums: DataFrame, rows: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """Adds exact quantiles, selected in a distributed way, to a table of groups; null for groups without values."""
    found = quantiles(rows, keys, value, names)
    right = found.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *names)
    return sums.join(right, null_safe([F.col(k) for k in keys], [F.col(f"_of_{k}") for k in keys]), "left").drop(*(f"_of_{k}" for k in keys))


def operation_summary(rows: DataFrame, key: str = "name", size: str = "size") -> DataFrame:
    """Per operation: time and count; sum, mean, median, extremes and quartiles of sizes (exact)."""
    sums = rows.groupBy(key).agg(
        F.sum("dur").alias("dur_sum"), F.count("dur").alias("dur_count"), F.sum(size).alias("size_sum"), F.avg(size).alias("size_mean"), F.min(size).alias("size_min"), F.max(size).alias("size_max"),
    )
    whole = _with_quantiles(sums, rows, [key], size, {"size_median": 0.5, "size_p25": 0.25, "size_p75": 0.75})
    return whole.select(key, "dur_sum", "dur_count", "size_sum", "size_mean", "size_median", "size_min", "size_max", "size_p25", "size_p75")


def transfer_table(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Per group the number of transfers and the sum, mean, median and extremes of their sizes."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size_sum"), F.avg(size).alias("size_mean"), F.min(size).alias("size_min"), F.max(size).alias("size_max"))
    return _with_quantiles(sums, rows, keys, size, {"size_median": 0.5})


def trimmed_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation of the values from index int((n-1)/4) to int(3(n-1)/4) in ascending order, and their number; exact."""
    return trimmed(rows, keys, value)


def variation(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population deviation over median; null for a median of 0."""
    sums = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    return _with_quantiles(sums, rows, keys, value, {"_median": 0.5}).select(*keys, F.try_divide("_sd", "_median").alias("cv"))


def weighted_average(rows: DataFrame, keys: list[str], total: str, count: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(total).cast("double"), F.sum(count)).alias("avg"))


def repetitions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return _with_quantiles(sums, rows, keys, value, {"median": 0.5})


def per_event(rows: DataFrame, keys: list[str], all_runs: list[str], total: str, rep: str) -> DataFrame:
    """The sum over a key divided by all repetitions of its run: a repetition without rows of the key counts as 0."""
    runs = rows.groupBy(*all_runs).agg(F.countDistinct(rep).alias("reps"))
    return rows.groupBy(*keys).agg(F.sum(total).alias("total")).join(runs, all_runs).select(*keys, F.try_divide(F.col("total").cast("double"), F.col("reps")).alias("per_event"))


def frozen(rows: DataFrame, series: list[str], value: str) -> DataFrame:
    """Series with more than one sample that never change."""
    found = rows.groupBy(*series).agg(F.count(value).alias("samples"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.filter("samples > 1 and low = high").select(*series, "samples")


def counter_delta(rows: DataFrame, series: list[str], value: str, first: str = "omit", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds `<value>_delta` to the previous sample of a series; the first one has none, its own value, or that against 0."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(*order))
    delta = F.col(value) - before
    if first in ("cumulative", "zero_base"):
        return rows.withColumn(f"{value}_delta", F.coalesce(delta, F.col(value)))
    return rows.withColumn(f"{value}_delta", delta).filter(F.col(f"{value}_delta").isNotNull() | F.col(value).isNull())


#: The order in which phases of the tracer's own work are shown.
PHASE_ORDER = ("init", "capture", "serialize", "compress", "write", "finalize")


def phase_profile(rows: DataFrame, events: str = "events") -> DataFrame:
    """Per process, mode, phase and layer: calls, time, mean time, and time per event of the run (events: a column of the run's events)."""
    sums = rows.groupBy("pid", "mode", "phase", "layer").agg(F.sum("count").alias("count"), F.sum("total_ns").alias("total_ns"), F.max(events).alias("run_events"))
    return sums.select("pid", "mode", "phase", "layer", "count", "total_ns", F.try_divide(F.col("total_ns").cast("double"), F.col("count")).alias("avg_ns"), F.try_divide(F.col("total_ns").cast("double"), F.col("run_events")).alias("ns_per_event"))


def phase_rank(phase, order: tuple[str, ...] = PHASE_ORDER):
    """A phase's place in an order; unknown ones come last."""
    known = F.create_map(*(F.lit(x) for k, p in enumerate(order) for x in (p, k)))
    return F.coalesce(F.try_element_at(known, phase), F.lit(len(order)))


def partitioned_quantile(rows: DataFrame, keys: list[str], part: str, value: str, q: float) -> DataFrame:
    """The quantile of the parts' quantiles: an approximation that sums up parts first (part: a column that deals rows)."""
    return quantiles(quantiles(rows, [*keys, part], value, {"x": q}), keys, "x", {"quantile": q})


def approximate_distinct(rows: DataFrame, keys: list[str], value: str, error: float = 0.02) -> DataFrame:
    """About how many values differ, from one fixed-size sketch per group and task (error: relative standard deviation)."""
    return rows.groupBy(*keys).agg(F.approx_count_distinct(value, error).alias("about"))


def added_time(rows: DataFrame, keys: list[str], mode: str, base: str, value: str) -> DataFrame:
    """Median of each mode with what it adds to the base mode's and their ratio, per key."""
    medians = quantiles(rows, [*keys, mode], value, {"median": 0.5})
    ground = medians.filter(F.col(mode) == base).select(*keys, F.col("median").alias("base"))
    both = medians.join(ground, keys, "left")
    return both.select(*keys, mode, "median", (F.col("median") - F.col("base")).alias("added"), F.try_divide("median", "base").alias("ratio"))
