"""Process identity and exact checks on small cases."""

import json

from pyspark.sql import functions as F

from tracelathe.operators import rules, validate
from tracelathe.plans import analysis, metadata
from tracelathe.schema import layer_mask, layer_set, used_names
from tracelathe.sources import traces


def test_processes_of_two_hosts_stay_apart(spark):
    rows = [("PR", h, 5, 1, "rank", str(k)) for k, h in enumerate(("ha", "hb"))] + [("PR", "ha", 5, 1, "app", "sim"), ("start", "ha", 5, 2, None, None), ("end", "ha", 5, 9, "k", "old"), ("end", "ha", 5, 10, "k", "new"), ("start", "hb", 5, 3, None, None)]
    records = spark.createDataFrame(rows, "record string, hhash string, pid bigint, ts bigint, key string, value string")
    table = metadata.process_table(records)
    got = {(r.hhash, r.pid): (r["rank"], r.app, r.start, r.end, r.values) for r in table.collect()}
    assert got == {("ha", 5): (0, "sim", 2, 10, {"k": "new"}), ("hb", 5): (1, None, 3, None, None)}
    events = spark.createDataFrame([(1, "ha", 5), (2, "hb", 5), (3, "hc", 5)], "id bigint, hhash string, pid bigint")
    joined = metadata.with_process(events, table)
    assert {r.id: (r["rank"], r.app) for r in joined.collect()} == {1: (0, "sim"), 2: (1, None), 3: (None, None)}
    assert [r.id for r in joined.filter(rules.rule("rank == 1", {"rank": (F.col("rank"), "integer")}, guard=False)).collect()] == [2]
    small = traces.drop_small_traces(events.union(events.filter("id = 1")), 2, ("hhash", "pid"))
    assert {r.hhash for r in small.collect()} == {"ha"}
    timed = spark.createDataFrame([("ha", 5, "x", 3), ("hb", 5, "x", 4)], "hhash string, pid bigint, name string, dur bigint")
    assert analysis.duration_of(timed, "x", keys=("hhash", "pid")).first().seconds == 4e-6


def test_arguments_are_compared_by_type(spark):
    rows = [("a", {"i": -9007199254740993, "u": 2**64 - 1, "f": 2.5, "hhash": "x", "l": {"in": ["x"]}}), ("a", {"i": "1", "f": 2.5, "u": 2**64 - 1, "l": {"in": ["y"]}, "z": 1}), ("b", None), ("c", {"q": 1})]
    frame = spark.createDataFrame([(n, None if a is None else json.dumps(a)) for n, a in rows], "name string, args string")
    expected = spark.createDataFrame([("a", json.dumps({"i": -9007199254740993, "u": 2**64 - 1, "f": 2.5, "l": {"in": ["x"]}})), ("b", '{"k": 1}'), ("d", "{}")], "name string, args string")
    got = {(r.name, r.key, r.problem, r.n) for r in validate.args_differences(frame, expected).collect()}
    assert got == {("a", "i", "other", 1), ("a", "l", "other", 1), ("a", "z", "unknown", 1), ("b", "k", "missing", 1), ("d", None, "missing", 1)}


def test_layers_of_masks_and_end_records(spark):
    frame = spark.createDataFrame([(3,), (14,), (3,)], "code int").agg(F.bit_or(layer_mask(F.col("code"))).alias("mask"))
    row = frame.select(layer_set(F.col("mask")).alias("a"), used_names(F.lit('{"torch":1,"MPI":1,"none":0}')).alias("b"), used_names(F.lit("no json")).alias("c")).first()
    assert (row.a, row.b, row.c or []) == (["POSIX", "CUDA"], ["MPI", "torch"], [])


def test_totals_and_line_counts(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 4), ("c", None)], "k string, v bigint")
    right = spark.createDataFrame([("a", 3), ("b", 5), (None, 5)], "k string, v bigint")
    got = {r.k: (r.total_left, r.total_right, r.equal) for r in validate.compared_totals(left, right, ["k"], "v").collect()}
    assert got == {"a": (3, 3, True), "b": (0, 5, False), None: (4, 5, False), "c": (0, 0, True)}
    lines = spark.createDataFrame([("f", '{"id": 1}')] * 3 + [("f", "[")], "file string, value string")
    expected = spark.createDataFrame([("f", None, 3), ("g", 1, None), ("f", 4, None), ("f", None, None)], "file string, least int, exact int")
    assert sorted((r.file, r.events, r.problem or "") for r in validate.line_counts(lines, expected).collect()) == [("f", 3, ""), ("f", 3, ""), ("f", 3, "too few"), ("g", 0, "too few")]
