"""Folding of events into tumbling intervals, routing, and re-aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.functions.scalars import interval_floor
from tracelathe.schema import NEVER_AGGREGATED, UNIT_NS, ArgRoles

BUCKET = ["cat", "name", "type", "tid"]


def interval_aggregate(events: DataFrame, width: int, keys: list[str] = (), values: list[str] = ()) -> DataFrame:
    """One row per interval and key: dft_cnt, and sum, min and max of dur and of every value; one shuffle, partial sums first."""
    folded = ["dur", *values]
    sums = [f(c).alias(f"{c}_{n}") for c in folded for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    at = events.withColumn("interval", interval_floor(F.col("ts"), width))
    return at.groupBy(*BUCKET, *keys, "interval").agg(F.count(F.lit(1)).alias("dft_cnt"), *sums)


def reaggregate(rows: DataFrame, keys: list[str] = (), values: list[str] = ()) -> DataFrame:
    """Merges aggregated rows of the same interval and key (late ones, or those of several files)."""
    folded = ["dur", *values]
    merged = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in folded for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*BUCKET, *keys, "interval").agg(F.sum("dft_cnt").alias("dft_cnt"), *merged)


def aggregate_open_args(events: DataFrame, width: int, roles: ArgRoles | None = None) -> DataFrame:
    """The same for an open set of arguments: `args` is a map of strings; the folded numbers come as a map of structs.

    Keys become a sorted map in `keys`. Numbers of one name that are whole in one row and fractions in another are
    folded as doubles; strings that are no keys are left out.
    """
    roles = roles or ArgRoles()
    entries = F.map_entries(F.coalesce("args", F.create_map().cast("map<string,string>")))
    is_key = lambda e: roles.is_key(e["key"], e["value"].try_cast("double").isNotNull())
    keyed = F.to_json(F.map_from_entries(F.array_sort(F.filter(entries, is_key))))
    numbers = F.filter(entries, lambda e: ~is_key(e) & e["value"].try_cast("double").isNotNull())
    at = events.select(*BUCKET, interval_floor(F.col("ts"), width).alias("interval"), keyed.alias("keys"), "dur", F.concat(F.array(F.struct(F.lit("dur").alias("key"), F.col("dur").cast("string").alias("value"))), numbers).alias("n"))
    long = at.select(*BUCKET, "interval", "keys", F.explode("n").alias("n")).select(*BUCKET, "interval", "keys", "n.key", F.col("n.value").cast("double").alias("x"))
    folded = long.groupBy(*BUCKET, "interval", "keys", "key").agg(F.count("x").alias("count"), F.sum("x").alias("sum"), F.min("x").alias("min"), F.max("x").alias("max"))
    entry = F.struct("key", F.struct("count", "sum", "min", "max").alias("value"))
    count = F.max(F.when(F.col("key") == "dur", F.col("count")))
    return folded.groupBy(*BUCKET, "interval", "keys").agg(count.alias("dft_cnt"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))


def aggregate_typed_args(events: DataFrame, width: int, roles: ArgRoles | None = None, mixed: str = "first", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row per interval, key and argument: its kind (integer, number or text), count, sum, min and max (text is only counted).

    `args` is a map of strings. An argument whose kind changes keeps that of its first row in `order`: with `first`, rows of other
    kinds are left out; with `cast`, numbers of another kind are cast to it. Kinds are folded apart, so one shuffle of partial sums does.
    """
    roles = roles or ArgRoles()
    entries = F.map_entries(F.coalesce("args", F.create_map().cast("map<string,string>")))
    is_number = lambda e: e["value"].try_cast("double").isNotNull()
    is_key = lambda e: roles.is_key(e["key"], is_number(e)) & ~(~is_number(e) & e["key"].isin(*roles.values))
    keyed = F.to_json(F.map_from_entries(F.array_sort(F.filter(entries, is_key))))
    at = events.select(*BUCKET, interval_floor(F.col("ts"), width).alias("interval"), keyed.alias("keys"), F.struct(*order).alias("_at"), F.explode(F.filter(entries, lambda e: ~is_key(e))).alias("e"))
    whole, number = F.col("e.value").try_cast("bigint"), F.col("e.value").try_cast("double")
    kind = F.when(whole.isNotNull(), "integer").when(number.isNotNull(), "number").otherwise("text")
    rows = at.select(*BUCKET, "interval", "keys", "e.key", kind.alias("kind"), number.alias("x"), F.when(F.abs(number) < 9e18, number.cast("bigint")).alias("w"), "_at")
    group = [*BUCKET, "interval", "keys", "key"]
    folded = rows.groupBy(*group, "kind").agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("count"), *(f(c).alias(f"{c}_{n}") for c in "xw" for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))))
    first = F.min(F.struct("_at", "kind"))["kind"].alias("first")
    kinds = F.collect_list(F.struct("kind", "count", "x_sum", "x_min", "x_max", "w_sum", "w_min", "w_max")).alias("all")  # three at most
    one = folded.groupBy(*group).agg(first, kinds)
    fits = F.col("x.kind") == F.col("first") if mixed == "first" else (F.col("x.kind") == F.col("first")) | (F.col("x.kind") != "text") & (F.col("first") != "text")
    parts = one.select(*group, "first", F.explode("all").alias("x")).filter(fits)
    value = lambda n: F.when(F.col("first") == "integer", F.col(f"x.w_{n}").cast("double")).when(F.col("first") == "number", F.col(f"x.x_{n}"))
    return parts.groupBy(*group, F.col("first").alias("kind")).agg(F.sum("x.count").alias("count"), F.sum(value("sum")).alias("sum"), F.min(value("min")).alias("min"), F.max(value("max")).alias("max"))


def shaped(rows: DataFrame, field: str = "dur") -> DataFrame:
    """As written to traces: a field folded once keeps its name, others have _sum, _min and _max."""
    once = F.col("dft_cnt") == 1
    kept = [c for c in rows.columns if not c.startswith(f"{field}_")]
    many = [F.when(~once, F.col(f"{field}_{n}")).alias(f"{field}_{n}") for n in ("sum", "min", "max")]
    return rows.select(*kept, F.when(once, F.col(f"{field}_sum")).alias(field), *many)


def aggregatable(cat: Column, kind: Column, external: tuple[int, ...] = (), own: str | None = None) -> Column:
    """Layers that may be folded: none of the tracer's own (layer 1, or the category `own`) and of time series; extensions if they are registered."""
    return ~kind.isin(*NEVER_AGGREGATED) & (cat != own if own else F.lit(True)) & ((kind < 128) | (kind.isin(*external) if external else F.lit(False)))


def selective_route(events: DataFrame, matches: Column, width: int, keys: list[str] = ()) -> DataFrame:
    """Events that match are folded (ph 3), the others stay as they are; rows of both in one table."""
    folded = interval_aggregate(events.filter(matches), width, keys).withColumn("ph", F.lit(3).cast("smallint")).withColumnRenamed("interval", "ts")
    rest = events.filter(~F.coalesce(matches, F.lit(False))).withColumn("dft_cnt", F.lit(1).cast("bigint"))
    return folded.unionByName(rest, allowMissingColumns=True)


def calls(ph: Column, count: Column) -> Column:
    """Calls that a row stands for."""
    return F.when(ph == 3, count).otherwise(1)


def min_duration(events: DataFrame, nanoseconds: int, unit: str = "US") -> DataFrame:
    """Drops events of less than a duration; the tracer's own layer stays."""
    return events.filter((F.col("dur") * UNIT_NS[unit] >= nanoseconds) | (F.col("type") == 1))
