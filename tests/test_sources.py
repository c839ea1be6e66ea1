import gzip
import struct

import pytest
from pyspark.sql import functions as F

from tracelathe.operators.validate import line_check
from tracelathe.plans import utilities
from tracelathe.sources import adapters, telemetry, traces
from tracelathe.sources.members import member_lines
from tracelathe.streaming import tumbling


@pytest.fixture
def trace(tmp_path):
    plain = '[\n{"id":"1","name":"read","cat":"POSIX","type":3,"pid":7,"tid":8,"ts":"10","dur":"5","ph":"X","args":{"size":4096,"n":"x"}},\n\nbroken line here\n]\n'
    (tmp_path / "a.pfw").write_text(plain)
    member = lambda k: gzip.compress(f'{{"id":{k},"name":"write","cat":"POSIX","type":3,"pid":7,"tid":8,"ts":{k},"dur":1,"ph":1}}\n'.encode())
    (tmp_path / "b.pfw.gz").write_bytes(member(2) + member(3))
    return tmp_path


def test_reads_both_framings_and_all_members(spark, trace):
    rows = {r.id: r for r in traces.read_trace(spark, [str(trace / "a.pfw"), str(trace / "b.pfw.gz")]).withColumn("args", F.to_json("args")).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].ph == 1 and rows[1].dur == 5 and rows[1].args == '{"n":"x","size":4096}'
    numbers = traces.variant_numbers(traces.read_trace(spark, str(trace / "a.pfw"))).collect()
    assert [(r.id, r.key, r.number) for r in numbers] == [(1, "size", 4096.0)]


def test_members_are_inflated_in_tasks(spark, trace):
    lines = member_lines(spark, str(trace / "b.pfw.gz"), 40)
    assert len({r.offset for r in lines.collect()}) == 2
    assert traces.parse_events(lines).count() == 2


def test_line_numbers_follow_the_files(spark, trace):
    (trace / "n").mkdir()
    for k in range(3):
        (trace / "n" / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = traces.line_batches(traces.with_line_numbers(traces.read_lines(spark, str(trace / "n"))), 64).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1500 and all(r.line == int(r.value.split()[1]) and r.batch == r.line - r.line % 64 for r in rows)


def test_line_numbers_go_on_through_files(spark, trace):
    (trace / "m").mkdir()
    for k in range(3):
        (trace / "m" / f"{k}.txt").write_text("".join(f"{k * 500 + i}\n" for i in range(500)))
    rows = traces.with_line_numbers(traces.read_lines(spark, str(trace / "m")).repartition(1).sortWithinPartitions("file", F.col("value").cast("int")), through=True).collect()
    assert len(rows) == 1500 and all(r.line == int(r.value) for r in rows)


def test_benchmark_tables(spark, trace):
    (trace / "c.csv").write_text("# made\n mode , bw\nbase,1.5\ntrace,2\n")
    rows = traces.read_benchmarks(spark, str(trace / "c.csv"), {"mode": "mode", "bw": "bandwidth"})
    assert [(r.mode, r.bandwidth) for r in rows.orderBy("mode").collect()] == [("base", 1.5), ("trace", 2.0)]
    utilities.write_summary(rows, str(trace / "sum"), ["mode"])
    assert spark.read.option("header", True).csv(str(trace / "sum")).count() == 2


def test_writers_round_trip(spark, trace):
    events = traces.read_trace(spark, [str(trace / "a.pfw"), str(trace / "b.pfw.gz")]).drop("file")
    utilities.write_rolled(events.select(F.lit("f").alias("file"), F.col("id").alias("line"), traces.json_line(events).alias("value")), str(trace / "rolled"), 1)
    back = traces.parse_events(spark.read.text(str(trace / "rolled")))
    assert {tuple(r) for r in back.withColumn("args", F.to_json("args")).select("id", "name", "ts", "dur", "args").collect()} == {tuple(r) for r in events.withColumn("args", F.to_json("args")).select("id", "name", "ts", "dur", "args").collect()}
    arrays = utilities.viewer_arrays(events, 50).collect()
    import json

    shown = [e for r in arrays for e in json.loads(r.value)]
    assert len(shown) == 3 and {e["ph"] for e in shown} == {"X"} and len(arrays) > 1
    texts = ["é" * 20, "ab", "é" * 15, "x" + "é" * 20, "a" * 28 + "€uro", "a" * 27 + "😀😀", "z" * 31, None]
    cut = traces.capped(spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1), 30).collect()
    bytes_cut = [None if x is None else x.encode()[:30].decode(errors="ignore") for x in texts]
    assert [r.value for r in cut] == bytes_cut and [r.over_cap for r in cut] == [None if x is None else len(x.encode()) > 30 for x in texts]


def test_round_trip_and_checks(spark, trace):
    events = traces.read_trace(spark, str(trace / "b.pfw.gz")).drop("args", "file")
    traces.write_trace(events, str(trace / "out"))
    assert traces.read_trace(spark, str(trace / "out")).drop("args", "file").exceptAll(events).count() == 0
    found = line_check(traces.read_lines(spark, str(trace / "a.pfw"))).first()
    assert (found.events, found.good, found.bad) == (2, 1, 1)
    assert utilities.sanitize(traces.read_lines(spark, str(trace / "a.pfw"))).count() == 1
    assert traces.drop_small_traces(events, 3).count() == 0 and traces.viewer_events(events).first().ph == "X"


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, x) for x in text.splitlines()], "file string, value string")


def test_telemetry(spark):
    text = '# HELP x\ngpu_power{card="0",x="a b"} 12.5\ngpu_power{card="1"} 13\nup 1\nbad line here now\nnan_of{ 1\n'
    assert sorted((r.metric, r.value) for r in telemetry.exposition(lines(spark, text)).collect()) == [("gpu_power", 12.5), ("gpu_power", 13.0), ("up", 1.0)]
    stat = {r.name: r.idle_pct for r in telemetry.proc_stat(lines(spark, "cpu  1 0 1 2 0 0 0 0 0 0\ncpu0 1 0 0 3 0 0 0 0 0 0\nintr 5")).collect()}
    assert stat == {"cpu": 50.0, "cpu-0": 75.0}
    memory = {r.key: r.percent for r in telemetry.meminfo(lines(spark, "MemTotal: 200 kB\nMemAvailable: 50 kB")).collect()}
    assert memory == {"MemTotal": 400.0, "MemAvailable": 50.0}
    disk = telemetry.diskstats(lines(spark, " 8 0 sda 10 0 4 0 20 0 6 0 0 0 0\n 7 0 loop0 1 0 1 0 1 0 1 0 0 0 0")).collect()
    assert [(r.device, r.reads, r.read_bytes, r.write_bytes) for r in disk] == [("sda", 10, 2048, 3072)]
    net = telemetry.net_dev(lines(spark, "Inter-| x\n lo: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16\n eth0: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")).collect()
    assert [(r.interface, r.rx_bytes, r.tx_bytes) for r in net] == [("eth0", 1, 9)]
    power = spark.sql("""select parse_json('{"h":{"power_node_watts":1.5,"timestamp":9,"socket_0":{"power_gpu_watts":{"GPU_0":2,"s":"x"}}}}') as v""")
    assert {(r.path, r.value) for r in telemetry.power_leaves(power).collect()} == {("power_node_watts", 1.5), ("socket_0.power_gpu_watts.GPU_0", 2.0)}
    text = """{"h":{"a":[1,{"b":[2,[]]},"x",null,true],"e":{},"t":{"timestamp":3,"d":{"d":4}}},"timestamp":5,"n":6.5}"""
    nested = spark.createDataFrame([(text,), (None,), ("7",)], "x string").select(F.expr("parse_json(x)").alias("v"))
    assert sorted((r.path, r.value) for r in telemetry.power_leaves(nested).collect()) == [("", 6.5), ("", 7.0), ("a.0", 1.0), ("a.1.b.0", 2.0), ("t.d.d", 4.0)]
    assert sorted(r.path for r in telemetry.power_leaves(nested, 3).collect()) == ["", "", "a.0"]
    assert telemetry.power_leaves(nested)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # no copies of leaves at each level
    mount = telemetry.mountinfo(lines(spark, r"36 35 98:0 / /mnt\040a rw,noatime shared:1 master:2 - ext4 /dev/sda rw")).first()
    assert (mount.point, mount.device, mount.fstype, mount.source) == ("/mnt a", "98:0", "ext4", "/dev/sda")


def test_adapters(spark):
    marks = spark.createDataFrame([("l", "r", t, t, k) for t, k in ((1, "enter"), (4, "leave"), (5, "enter"), (6, "enter"), (9, "leave"))], "location string, region string, time bigint, seq bigint, kind string")
    assert sorted((r.ts, r.dur) for r in adapters.pair_enter_leave(marks).collect()) == [(1, 3), (5, 0), (6, 3)]
    segments = spark.createDataFrame([(1, "h", 2, "read", 10, 0.5, 0.75)], "id bigint, hostname string, rank int, op string, length bigint, start_time double, end_time double")
    row = adapters.segments_to_events(segments, spark.createDataFrame([(1, "/f")], "id bigint, file string")).first()
    assert (row.ts, row.dur, row.size, row.file) == (5_000_000, 2_500_000, 10, "/f") and (row.tid, row.phase) == (0, 2)
    records = spark.createDataFrame([(1, "read", 0, 0, 1, 3), (0, "x", 0, 0, 1, 2), (2, "MPI_Send", 0, 0, 1, 2)], "func_id int, name string, rank int, tid int, tstart bigint, tend bigint")
    assert adapters.recorder_to_events(records).count() == 1
    packed = spark.createDataFrame([(bytearray(struct.pack("<IIQQQBB", 1, 2, 3, 4, 5, 3, 1) * 2),)], "data binary")
    assert [tuple(r) for r in adapters.packed_records(packed).collect()] == [(1, 2, 3, 4, 5, 3, 1)] * 2


def test_late_rows_are_merged(spark, tmp_path):
    schema = "at timestamp, cat string, name string, dur bigint"
    for k, rows in enumerate([[(10, 1), (70, 2)], [(20, 3)]]):
        spark.createDataFrame([(t, "c", "n", d) for t, d in rows], "s bigint, cat string, name string, dur bigint").select(F.timestamp_seconds("s").alias("at"), "cat", "name", "dur").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tumbling.fold_batches(stream, 60_000_000, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.count() == 3
    assert {(r.interval // 60_000_000, r.dft_cnt, r.dur_sum) for r in tumbling.reaggregated(rows).collect()} == {(0, 2, 4), (1, 1, 2)}
