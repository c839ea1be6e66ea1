"""Mergeable sketches as stored columns: of quantiles (KLL) and of distinct values (theta), per group, kept in files and merged later.

A KLL sketch of parameter k gives ranks within about 2.3 / k**0.9 of the count (99 %), and is exact up to about k values; a theta sketch of 2**log2 entries
counts distinct values with a relative deviation of 1 / sqrt(2**log2), and exactly up to that many. Sketches have a bounded size whatever they
have seen, partial sketches meet before the shuffle, and merging loses nothing against one sketch over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 4096
DISTINCT_LOG2 = 14


def quantile_error(k: int = QUANTILE_K) -> float:
    """The rank error of a KLL sketch, as a share of the count."""
    return 2.296 / k**0.9021


def distinct_error(log2: int = DISTINCT_LOG2, deviations: float = 3.0) -> float:
    """The relative error of a theta sketch at so many standard deviations."""
    return deviations / 2 ** (log2 / 2)


def sketched(rows: DataFrame, keys: list[str], value: str | None = None, distinct: str | None = None, k: int = QUANTILE_K, log2: int = DISTINCT_LOG2) -> DataFrame:
    """Per key the sketches `values` (of `value`'s quantiles, as integers) and `kinds` (of `distinct`'s values)."""
    made = []
    if value:
        made.append(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("values"))
    if distinct:
        made.append(F.theta_sketch_agg(F.col(distinct), F.lit(log2)).alias("kinds"))
    return rows.groupBy(*keys).agg(*made)


def merged(parts: DataFrame, keys: list[str], k: int = QUANTILE_K, log2: int = DISTINCT_LOG2) -> DataFrame:
    """Sketches of parts as sketches of larger groups."""
    made = []
    if "values" in parts.columns:
        made.append(F.kll_merge_agg_bigint("values", F.lit(k)).alias("values"))
    if "kinds" in parts.columns:
        made.append(F.theta_union_agg("kinds", F.lit(log2)).alias("kinds"))
    return parts.groupBy(*keys).agg(*made)


def quantile(q: float) -> Column:
    """The value at rank q of the sketch `values`: the smallest that at least q of the values don't exceed."""
    return F.kll_sketch_get_quantile_bigint("values", F.lit(q))


def quantile_bounds(q: float, k: int = QUANTILE_K, least: int | None = None) -> tuple[Column, Column]:
    """Two values of the sketch between which the exact quantile lies, by the sketch's error; least: the smallest count of a group, as an
    interpolated quantile may lie two places off."""
    error = quantile_error(k) + (2 / least if least else 0)
    return quantile(max(0.0, q - error)), quantile(min(1.0, q + error))


def distinct_count() -> Column:
    return F.theta_sketch_estimate("kinds")


def exact_distinct(whole: DataFrame, rows: DataFrame, keys: list[str], distinct: str, log2: int = DISTINCT_LOG2) -> DataFrame:
    """Adds `exact` to merged sketches (`whole`: keys, `kinds`; written): the number of different values of `distinct` in `rows`, of which they were made.

    Below the sketch's size it is the sketch's count; a sketch that has left values out says at least that size, and its group is counted in the rows.
    """
    full = F.theta_sketch_estimate("kinds") >= 2**log2
    large = whole.filter(full).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    kinds = rows.join(F.broadcast(large), same, "left_semi").select(*keys, F.col(distinct).alias("_x")).distinct()  # a large group has many rows, so they are few
    counts = kinds.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("_x").alias("_n"))
    return whole.join(counts, same, "left").select(*whole.columns, F.coalesce("_n", distinct_count().cast("bigint")).alias("exact"))
