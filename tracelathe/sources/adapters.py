"""Adapters of other tools' tables to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments_to_events(segments: DataFrame, names: DataFrame, factor: float = 10e6) -> DataFrame:
    """I/O segments (id, hostname, rank, op, length, start_time, end_time in seconds) and file names (id, file) as events of phase 2.

    Times are cut off, not rounded, after multiplication. The default factor is that of the analyses that these rows are compared with;
    1e6 gives microseconds.
    """
    start, end = ((F.col(c) * factor).cast("bigint") for c in ("start_time", "end_time"))
    head = [F.col("op").alias("name"), F.lit("POSIX").alias("cat"), F.col("rank").alias("pid"), F.lit(0).cast("bigint").alias("tid"), F.lit(2).alias("phase")]
    return segments.join(names, "id", "left").select(*head, start.alias("ts"), (end - start).alias("dur"), F.col("length").alias("size"), "hostname", "file")


def pair_enter_leave(marks: DataFrame) -> DataFrame:
    """Marks (location, region, time, kind: 'enter' or 'leave') as (location, region, ts, dur): a leave ends the last enter; dur is 0 without one."""
    order = Window.partitionBy("location", "region").orderBy("time", "seq")
    last = marks.withColumn("_kind", F.lead("kind").over(order)).withColumn("_time", F.lead("time").over(order))
    return last.filter("kind = 'enter'").select("location", "region", F.col("time").alias("ts"), F.when(F.col("_kind") == "leave", F.col("_time") - F.col("time")).otherwise(0).alias("dur"))


def recorder_to_events(records: DataFrame) -> DataFrame:
    """Records (func_id, name, rank, tid, tstart, tend) as events; no MPI calls, no unnamed functions."""
    kept = records.filter("func_id > 0 and not contains(name, 'MPI')")
    return kept.select("name", F.lit("POSIX").alias("cat"), F.col("rank").alias("pid"), "tid", F.col("tstart").alias("ts"), (F.col("tend") - F.col("tstart")).alias("dur"))


def packed_records(blocks: DataFrame) -> DataFrame:
    """Fixed-head binary records (id u32, pid u32, tid u64, ts u64, dur u64, type u8, ph u8, little-endian) as rows; column `data`."""
    import numpy as np
    import pyarrow as pa

    kind = np.dtype([("id", "<u4"), ("pid", "<u4"), ("tid", "<u8"), ("ts", "<u8"), ("dur", "<u8"), ("type", "u1"), ("ph", "u1")])
    types = {"id": "<i8", "pid": "<i8", "tid": "<i8", "ts": "<i8", "dur": "<i8", "type": "<i2", "ph": "<i2"}

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = np.frombuffer(data.as_buffer(), kind, len(data.as_buffer()) // kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(rows[k].astype(t)) for k, t in types.items()], names=list(types))

    return blocks.select("data").mapInArrow(run, "id bigint, pid bigint, tid bigint, ts bigint, dur bigint, type smallint, ph smallint")
