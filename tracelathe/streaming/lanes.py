"""State per lane, (pid, tid), that is given out some time after its process has ended.

A process's lanes are dealt by tid into parts, each with its own state and timer, so a process with many lanes is many tasks; its end mark goes to every part. What
a batch folds of a part is one element of a list in the state store, and elements are folded together when there are many, so calls to the store
follow batches and not lanes, and state follows lanes and not batches. An end mark sets a timer two flush intervals ahead in event time; until then late rows
are folded in. When the watermark passes the timer, the part's rows are given out and its state goes. Processes that fall silent without an end mark are given
out after `idle`, if that is set; a process is then one part, as it is silent only as a whole. The store is RocksDB, so state may exceed memory; timers and
entries are in the checkpoint, so a stream that stops goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLDED = "pid bigint, tid bigint, name string, dft_cnt bigint, dur_sum bigint, dur_min bigint, dur_max bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Parts of a process, and elements of a part's list that are folded into one.
PARTS = 8
ELEMENTS = 16
_KEYS = ["tid", "name"]
_FOLDS = {"n": "sum", "total": "sum", "low": "min", "high": "max"}


def _packed(sums: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(sums[[*_KEYS, *_FOLDS]], preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _folded(elements: list[bytes]) -> pd.DataFrame:
    rows = pd.concat([pa.ipc.open_stream(x).read_pandas() for x in elements])
    return rows.groupby(_KEYS, sort=True).agg(_FOLDS).reset_index()


class Lanes(StatefulProcessor):
    """Folds (tid, name, dur) of a part of a process; `at_ms` is a row's time in milliseconds."""

    def __init__(self, end: str, flush_ms: int, idle_ms: int | None, ttl_ms: int | None):
        self.end, self.flush_ms, self.idle_ms, self.ttl_ms = end, flush_ms, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getListState("folded", "data binary", self.ttl_ms)
        self.elements = handle.getValueState("elements", "n int", self.ttl_ms)
        self.ended = handle.getValueState("ended", "at_ms bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, mark, new = None, None, []
        for frame in rows:
            latest = max(int(frame["at_ms"].max()), latest if latest is not None else -(1 << 62))
            ends = frame[frame["name"] == self.end]
            if len(ends):
                mark = max(int(ends["at_ms"].max()), mark if mark is not None else -(1 << 62))
            sums = frame[frame["name"] != self.end].groupby(_KEYS)["dur"].agg(n="count", total="sum", low="min", high="max").reset_index()
            if len(sums):
                new.append(_packed(sums))
        if new:
            self._add(_packed(_folded(new)) if len(new) > 1 else new[0])
        if mark is not None:
            self._timer(mark + 2 * self.flush_ms)
            self.ended.update((mark,))
        elif self.idle_ms is not None and latest is not None and not self.ended.exists():
            self._timer(latest + self.idle_ms)
        return iter(())

    def _add(self, element: bytes) -> None:
        many = (self.elements.get()[0] if self.elements.exists() else 0) + 1
        if many < ELEMENTS:
            self.folded.appendValue((element,))
        else:
            self.folded.put([(_packed(_folded([*self._kept(), element])),)])
            many = 1
        self.elements.update((many,))

    def _kept(self) -> list[bytes]:
        return [bytes(x[0]) for x in self.folded.get()] if self.folded.exists() else []

    def _timer(self, at: int) -> None:
        for was in list(self.handle.listTimers()):
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        self.folded.clear()
        self.elements.clear()
        self.ended.clear()
        if kept:
            rows = _folded(kept)
            yield pd.DataFrame({"pid": int(key[0]), "tid": rows["tid"], "name": rows["name"], "dft_cnt": rows["n"], "dur_sum": rows["total"], "dur_min": rows["low"], "dur_max": rows["high"]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's store of streaming state, which timed state needs; call it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fold_lanes(events: DataFrame, flush_ms: int, late: str = "0 seconds", end: str = "end", idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Streaming: count, sum, least and greatest dur per (pid, tid, name), given out once the watermark is two flush intervals past the process's `end` record.

    events: pid, tid, name, dur and the timestamp `at`; rows without pid, name or time are left out, those without tid or dur have 0. Rows later than
    `late` behind the stream are dropped by Spark. Rows after a process was given out start anew, as second rows for `reaggregated`.
    """
    rows = events.withWatermark("at", late).filter("pid is not null and name is not null and at is not null").select("pid", F.coalesce("tid", F.lit(0)).alias("tid"), "name", F.coalesce("dur", F.lit(0)).alias("dur"), F.unix_millis("at").alias("at_ms"), "at")
    parts = 1 if idle_ms is not None else PARTS
    every, own = F.sequence(F.lit(0), F.lit(parts - 1)), F.array(F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int"))
    rows = rows.select("*", F.explode(F.when(F.col("name") == end, every).otherwise(own)).alias("part"))
    return rows.groupBy("pid", "part").transformWithStateInPandas(statefulProcessor=Lanes(end, flush_ms, idle_ms, ttl_ms), outputStructType=FOLDED, outputMode="Append", timeMode="EventTime")
