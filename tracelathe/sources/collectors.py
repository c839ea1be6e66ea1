"""Collectors of system counters by name: built in or the user's own, with one form of result.

A collector turns the lines of its kind of snapshot (file, value) into a table with its series' keys and numbers. `collect` runs those
that are asked for over lines that say which collector they belong to, and gives every number as a row: collector, file, series, field,
value. Such rows go on as counters (`sources.traces.series_line`), deltas (`operators.stats.counter_delta`) or checks of frozen series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.sources import telemetry


@dataclass(frozen=True)
class Collector:
    """parse: a table of the lines' numbers; keys: the columns that name a series (others, but for `file`, are its numbers)."""

    parse: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]


COLLECTORS: dict[str, Collector] = {
    "cpu": Collector(telemetry.proc_stat, ("name",)),
    "memory": Collector(telemetry.meminfo, ("key",)),
    "io": Collector(telemetry.diskstats, ("device",)),
    "network": Collector(telemetry.net_dev, ("interface",)),
    "exposition": Collector(telemetry.exposition, ("metric", "labels")),
}


def register(name: str, parse: Callable[[DataFrame], DataFrame], keys: tuple[str, ...]) -> None:
    """Adds a collector, or replaces one."""
    COLLECTORS[name] = Collector(parse, tuple(keys))


def collect(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(collector, file, series, field, value) of lines (collector, file, value) by the collectors named, or all; numbers that are missing have no row.

    Collectors whose tables have no `file` give null. Each reads only its own lines.
    """
    parts = []
    for name in names or sorted(COLLECTORS):
        own = COLLECTORS[name]
        rows = own.parse(lines.filter(F.col("collector") == name).select("file", "value"))
        fields = [c for c in rows.columns if c not in (*own.keys, "file")]
        numbers = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields))
        file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string").alias("file")
        series = F.concat_ws(".", *(F.nullif(F.col(k), F.lit("")) for k in own.keys)).alias("series")
        parts.append(rows.select(F.lit(name).alias("collector"), file, series, F.explode(numbers).alias("x")).select("collector", "file", "series", "x.*").filter("value is not null"))
    return reduce(DataFrame.union, parts)
