"""Interval aggregation of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str = "0 seconds", keys: tuple[str, ...] = ("cat", "name")) -> DataFrame:
    """Rows per interval and key of a stream (or a table) with a timestamp column `at`.

    An interval is given out when later events have passed it by `late` (append mode). Rows that are later still are
    dropped by Spark; `merge_late` keeps them.
    """
    return events.withWatermark("at", late).groupBy(F.window("at", width), *keys).agg(F.count(F.lit(1)).alias("dft_cnt"), F.sum("dur").alias("dur_sum"), F.min("dur").alias("dur_min"), F.max("dur").alias("dur_max"))


def write_windows(events: DataFrame, width: str, path: str, checkpoint: str, late: str = "0 seconds", keys: tuple[str, ...] = ("cat", "name")):
    """Starts a query that writes each interval once, when a later one has opened: folders batch=N of rows start, keys and folds. events: at, keys, dur, closing.

    Intervals of closing rows aren't written, so a stream is drained by one such row: see `closing_row`.
    """
    folds = F.count(F.lit(1)).alias("dft_cnt"), F.sum("dur").alias("dur_sum"), F.min("dur").alias("dur_min"), F.max("dur").alias("dur_max")
    rows = events.withWatermark("at", late).groupBy(F.window("at", width), *keys, "closing").agg(*folds)
    rows = rows.select(F.col("window.start").alias("start"), *keys, "closing", "dft_cnt", "dur_sum", "dur_min", "dur_max")

    def write(batch: DataFrame, number: int) -> None:
        # Closing rows go here, as a filter in the stream would be pushed below the watermark, which they must reach. A batch that is
        # repeated after a failure replaces its own folder.
        batch.filter("not closing").drop("closing").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closing_row(events: DataFrame, beyond: str) -> DataFrame:
    """One row `beyond` (an interval: the width and what may be late) after all events: when the stream has read it, every open interval is written."""
    last = events.agg((F.max("at") + F.expr(f"interval {beyond}")).alias("at"))
    return last.filter("at is not null").select(*(F.col("at") if f.name == "at" else F.lit(True).alias("closing") if f.name == "closing" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))


def sliding(events: DataFrame, width: str, step: str, late: str = "0 seconds") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width, step)).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, keys: tuple[str, ...], late: str = "0 seconds") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def fold_batches(events: DataFrame, width_us: int, path: str, checkpoint: str, keys: tuple[str, ...] = ("cat", "name")):
    """Starts a query that folds every micro-batch on its own and appends the rows: late rows become second rows of their
    interval, as tracers write them, and `reaggregated` merges them. Nothing is dropped and no state is kept."""

    def write(batch: DataFrame, number: int) -> None:
        at = F.unix_micros("at")
        rows = batch.groupBy((at - F.pmod(at, F.lit(width_us))).alias("interval"), *keys).agg(F.count(F.lit(1)).alias("dft_cnt"), F.sum("dur").alias("dur_sum"), F.min("dur").alias("dur_min"), F.max("dur").alias("dur_max"))
        # A batch that is repeated after a failure replaces its own folder.
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reaggregated(rows: DataFrame, keys: tuple[str, ...] = ("cat", "name")) -> DataFrame:
    return rows.groupBy("interval", *keys).agg(F.sum("dft_cnt").alias("dft_cnt"), F.sum("dur_sum").alias("dur_sum"), F.min("dur_min").alias("dur_min"), F.max("dur_max").alias("dur_max"))
