"""Joins of traces with their dictionaries, hierarchies and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.functions.scalars import hash16, under
from tracelathe.operators.bins import bin_width


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """The write-once dictionary of a column: value (its hash16) and name."""
    return rows.select(hash16(F.col(column)).alias("value"), F.col(column).alias("name")).filter("name is not null").distinct()


def dictionary_join(rows: DataFrame, names: DataFrame, column: str, alias: str) -> DataFrame:
    """Adds the name that a hash stands for; unknown hashes stay, with null. Spark broadcasts the dictionary if it is small."""
    one = names.groupBy("value").agg(F.min("name").alias(alias)).withColumnRenamed("value", "_value")
    return rows.join(one, F.col(column) == F.col("_value"), "left").drop("_value")


def dangling(rows: DataFrame, column: str, names: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null id isn't in the other table."""
    return rows.filter(F.col(column).isNotNull()).join(names.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")


def longest_prefix(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each path with the mount that holds it: that of the same device first, then the longest, then the last.

    paths: path, dev; mounts: point, mount_dev, ord. A path meets mounts by its own prefixes, an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    met = paths.withColumn("point", F.explode(F.array_distinct(prefixes))).join(mounts, "point").filter(under(F.col("path"), F.col("point")))
    order = F.struct((F.col("dev") == F.col("mount_dev")).cast("int").alias("same"), F.length("point").alias("size"), F.col("ord"))
    return met.groupBy("path").agg(F.max_by("point", order).alias("mount"))


def same_keys(keys: list[str]) -> Column:
    """Equality of keys with those of a table whose columns are named `_of_<key>`; nulls are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return on


def asof_last(events: DataFrame, samples: DataFrame, keys: list[str], value: str, at: str = "ts", width: int | None = None) -> DataFrame:
    """Every event with the last sample's value at or before it, per key (null keys are a key): a sweep of both tables per bin of `width`.

    Events without a time, and those before all samples, have null. Samples without time or value take no part. What a bin begins
    with, the last sample of the bins before it, is one row per bin, found in a table of bins; the width follows from the events' range
    and count if it isn't given.
    """
    width = width or bin_width(events, at)
    left = events.withColumn("_kind", F.lit(1)).withColumn("_value", F.lit(None).cast(samples.schema[value].dataType))
    right = samples.filter(F.col(value).isNotNull() & F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bin", F.floor(F.col(at) / width))
    order = Window.partitionBy(*keys, "_bin").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.last("_value", ignorenulls=True).over(order)).filter("_kind = 1")
    ends = both.groupBy(*keys, "_bin").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.struct(F.col(at)))).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_bin").alias("_of__bin"), F.last("_end", ignorenulls=True).over(over).alias("_before"))
    found = seen.join(carried, same_keys([*keys, "_bin"]))
    return found.select(*(F.col(c) for c in events.columns if c != value), F.when(F.col(at).isNotNull(), F.coalesce("_own", "_before")).alias(value))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that don't occur equally often: keys, n_left, n_right."""
    counts = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = counts(left, "n_left").alias("l").join(counts(right, "n_right").alias("r"), on, "full_outer")
    n = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_left", "n_right")]
    return both.select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), *n).filter("n_left <> n_right")


def with_baseline(rows: DataFrame, keys: list[str], value: str, is_base: Column) -> DataFrame:
    """Mean, sample deviation and percent difference from the baseline group's mean, per key and mode."""
    base = rows.filter(is_base).groupBy(*keys).agg(F.avg(value).alias("base"))
    stats = rows.groupBy(*keys, "mode").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.join(base, keys).withColumn("overhead_percent", (F.col("mean") - F.col("base")) / F.col("base") * 100)


def lineage_edges(records: DataFrame) -> DataFrame:
    """(subject, relation, object) of records with id and relations, a map of lists."""
    return records.select(F.col("id").alias("subject"), F.explode("relations").alias("relation", "objects")).select("subject", "relation", F.explode("objects").alias("object"))


def correlated(records: DataFrame, calls: DataFrame, keys: list[str], by: str = "correlation_id") -> DataFrame:
    """Device records with the call that caused them, by its number within a process (keys): call_id, call_name, and `wait`, from the call's start to the record's.

    records: keys, by, id, name, ts, dur; calls: keys, by, id, name, ts. Records without a call stay, with nulls; a null number has no call.
    """
    made = calls.filter(F.col(by).isNotNull()).select(*keys, by, F.col("id").alias("call_id"), F.col("name").alias("call_name"), F.col("ts").alias("_call_ts"))
    met = records.join(made, [*keys, by], "left")
    return met.select(*records.columns, "call_id", "call_name", (F.col("ts") - F.col("_call_ts")).alias("wait"))
