"""Selection, sketches, sweeps, member and indexed sources, streams, equivalence, packed blocks and nested checks."""

import glob
import gzip
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelathe.operators import equivalence, intervals, joins, selection, sketches
from tracelathe.operators.written import drop_written, new_path, shared_folder, written
from tracelathe.plans import filesystem, utilities
from tracelathe.sources import indexed, loaders, members, packed
from tracelathe.streaming import lanes, tumbling


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_selection_equals_sorting(spark):
    rng = random.Random(1)
    groups = {"one": [5], "two": [1, 2], "three": [3, 1, 2], "ties": [7] * 900 + list(range(50)), "wide": [int(10 ** rng.uniform(0, 18)) for _ in range(700)], "near": [2**60 + i for i in range(300)], None: [4, 4, 9]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("ties", None)]
    frame = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    for options in ({}, {"accuracy": 40, "limit": 30}):
        got = {r.k: (r.a, r.b, r.c) for r in selection.quantiles(frame, ["k"], "v", {"a": 0.5, "b": 0.25, "c": 1.0}, **options).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k] == pytest.approx([quantile(vs, q) for q in (0.5, 0.25, 1.0)], rel=1e-12)
        trimmed = {r.k: (r["mean"], r.sd, r.n) for r in selection.trimmed(frame, ["k"], "v", **options).collect()}
        for k, vs in groups.items():
            inner = sorted(vs)[(len(vs) - 1) // 4 : 3 * (len(vs) - 1) // 4 + 1]
            mean, sd, n = trimmed[k]
            assert n == len(inner) and mean == pytest.approx(statistics.mean(inner), rel=1e-12)
            assert sd is None if n == 1 else sd == pytest.approx(statistics.stdev(inner), rel=1e-6, abs=1e-6)


def test_full_sketches_are_counted(spark):
    """Of four groups one fills its sketch; nulls are no values, but a group."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.when(F.col("id") % 3 > 0, "large")).otherwise(F.when(F.col("id") < 3015, "small").otherwise("edge")).alias("k"), (F.col("id") % 3).alias("part"), F.when(F.col("id") % 7 > 0, F.col("id") % 1900).alias("v"))
    parts = sketches.sketched(rows, ["k", "part"], distinct="v", log2=9)
    got = sketches.exact_distinct(written(sketches.merged(parts, ["k"], log2=9)), rows, ["k"], "v", 9)
    assert {(r.k, r.exact) for r in got.collect()} == {(r.k, r.n) for r in rows.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}


def test_selection_of_a_large_group_is_bounded(spark, monkeypatch):
    """A million different values of one group: what is sorted at last, and every written table, holds a bounded number."""
    sizes = []

    def counted(rows):
        kept = written(rows)
        sizes.append(kept.filter("v is not null").count() if "v" in rows.columns else 0)
        return kept

    monkeypatch.setattr(selection, "written", counted)
    frame = spark.range(1_000_000).select(F.lit("g").alias("k"), ((F.col("id") * 7919) % 1_000_003).alias("v"))
    row = selection.quantiles(frame, ["k"], "v", {"a": 0.5, "b": 0.9}, accuracy=1000, limit=500).first()
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    assert (row.a, row.b) == pytest.approx((quantile(values, 0.5), quantile(values, 0.9)), rel=1e-12)
    assert 0 < max(sizes) <= 2 * 10_000 and sizes[-1] <= 2 * 500


def test_merged_sketches_stay_within_their_error(spark):
    frame = spark.range(200_000).select((F.col("id") % 7).alias("part"), ((F.col("id") * 7919) % 200_003).alias("v"), F.lit("g").alias("k"))
    parts = written(sketches.sketched(frame, ["k", "part"], "v", "v", k=400, log2=12))
    whole = sketches.merged(parts, ["k"], 400, 12)
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    for q in (0.1, 0.5, 0.99):
        low, high = whole.select(*sketches.quantile_bounds(q, 400)).first()
        assert low <= values[int(q * 199_999)] <= high
        assert high - low < 4 * sketches.quantile_error(400) * 200_003
    assert abs(whole.select(sketches.distinct_count()).first()[0] / 200_000 - 1) < sketches.distinct_error(12)


def test_asof_keeps_every_event(spark):
    events = spark.createDataFrame([(1, None, 5), (2, 0, None), (3, 0, 50), (4, 0, 1), (5, 9, 9)], "id bigint, pid bigint, ts bigint")
    samples = spark.createDataFrame([(None, 3, "n"), (0, 10, "a"), (0, 40, "b"), (0, None, "x")], "pid bigint, ts bigint, v string")
    for width in (None, 7):
        got = {r.id: r.v for r in joins.asof_last(events, samples, ["pid"], "v", width=width).collect()}
        assert got == {1: "n", 2: None, 3: "b", 4: None, 5: None}


def test_first_region_equals_pairs(spark):
    rng = random.Random(4)
    events = [(i, i % 2, s, s + rng.choice([0, 1, 5])) for i, s in ((i, rng.randrange(300)) for i in range(200))]
    regions = [(i, i % 2, s, s + rng.choice([0, 3, 20, 290])) for i, s in ((i, rng.randrange(300)) for i in range(120))]
    want = {i: min(((rs, r) for r, q, rs, re in regions if p == q and rs <= s and e <= re), default=(0, None))[1] for i, p, s, e in events}
    a, b = spark.createDataFrame(events, "id bigint, pid bigint, ts bigint, te bigint"), spark.createDataFrame(regions, "region bigint, pid bigint, rs bigint, re bigint")
    for width in (None, 11):
        assert {r.id: r.region for r in intervals.contained_in(a, b, ["pid"], width).collect()} == {k: v for k, v in want.items() if v is not None}


def test_one_file_is_split_in_many_tasks(spark):
    lines = spark.range(50_000).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = utilities.split(lines, 10_000, width=1000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in got}) > 4
    total, want = 0, {}
    for i in range(50_000):
        want[i], total = total // 10_000, total + i % 40 + 1
    assert {r.line: r.chunk for r in got} == want
    assert {(r.line, r.part) for r in utilities.compact(lines, 777, width=1000).select("line", "part").collect()} == {(i, i // 777) for i in range(50_000)}


def test_written_tables_are_dropped(spark):
    path = new_path(spark)
    spark.range(3).write.parquet(path)
    drop_written(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_ranges_are_dealt_to_many_tasks(spark, tmp_path):
    """Rows that name ranges have few bytes, so Spark would join their partitions and one task would read every file."""
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(f"{k} {'x' * 50}\n".encode()) for k in range(400)))
    (tmp_path / "b.txt").write_text("".join(f"{k} {'x' * 50}\n" for k in range(400)))
    for lines in (members.member_lines(spark, str(tmp_path / "a.gz"), 1000), indexed.lines_at(spark, str(tmp_path / "b.txt"), 1000)):
        got = lines.withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == 400 and len({r.task for r in got}) > 8


@pytest.mark.parametrize("size", [1 << 26, 900])
def test_members_of_damaged_files(spark, tmp_path, size):
    rng = random.Random(2)
    texts = [[json.dumps({"id": k * 100 + i, "x": rng.random()}) for i in range(40)] for k in range(5)]
    packs = [gzip.compress(("\n".join(t) + "\n").encode()) for t in texts]
    (tmp_path / "good.gz").write_bytes(b"".join(packs))
    torn = bytearray(packs[1])
    torn[60:90] = bytes(30)
    (tmp_path / "broken.gz").write_bytes(packs[0] + bytes(torn) + packs[2] + packs[3])
    (tmp_path / "cut.gz").write_bytes(packs[0] + packs[1][:-9])
    (tmp_path / "odd.gz").write_bytes(gzip.compress(b'{"id":1}\n{"id":2') + gzip.compress(b"[\nnot json\n"))
    (tmp_path / "none.gz").write_bytes(b"")
    found = members.member_checks(spark, str(tmp_path / "*.gz"), size).collect()
    got = {(r.file.rsplit("/", 1)[1], r.member): (r.state, r.lines, r.records, r.bad_lines, r.whole_last_line, r.splittable) for r in found}
    good = ("good", 40, 40, 0, True, True)
    assert got == {
        **{("good.gz", k): good for k in range(1, 6)}, ("broken.gz", 1): good, ("broken.gz", 2): ("broken", None, None, None, None, False), ("broken.gz", 3): good, ("broken.gz", 4): good,
        ("cut.gz", 1): good, ("cut.gz", 2): ("cut off", None, None, None, None, False), ("odd.gz", 1): ("good", 2, 1, 1, False, False), ("odd.gz", 2): ("good", 2, 0, 1, True, False),
    }
    lines = members.member_lines(spark, str(tmp_path / "good.gz"), size).orderBy("offset", "line").collect()
    assert [r.value for r in lines] == [x for t in texts for x in t]


def test_index_reads_fewer_bytes(spark, tmp_path):
    rows = [json.dumps({"id": i, "name": "né" * (i % 9), "ts": 1000 + i}) for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows[:2000]) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(rows[2000:]))  # no last line feed
    for size in (1 << 26, 5000):
        index = indexed.build_index(spark, str(tmp_path / "in"), block=4000, size=size)
        path = str(tmp_path / f"index{size}")
        index.write.parquet(path)
        got = [r.ts for r in indexed.indexed_events(spark, path, 1500, 1600).orderBy("ts").collect()]
        assert got == list(range(1500, 1600))
        every = indexed.read_indexed(spark, path).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in every) == sorted([("a.txt", i, rows[i]) for i in range(2000)] + [("b.txt", i - 2000, rows[i]) for i in range(2000, 3000)])
        reader = indexed.IndexedReader({"index": path})
        list(reader.pushFilters([indexed.GreaterThanOrEqual(("ts",), 1500), indexed.LessThan(("ts",), 1600)]))
        read = sum(b.bytes for b in reader.partitions())
        assert 0 < read < 0.1 * sum(b.bytes for b in indexed.IndexedReader({"index": path}).partitions())
        assert len(reader.partitions()) == 1  # neighbouring blocks are one stretch


def test_loader_columns_follow_the_types(spark):
    loaders.register_loader(spark, "load_test", lambda r: [r, r] if r.get("two") else r)
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "7", "two": 1},',), ("no json",), (None,), ("[1]",), ('{"a": "q"}',)], "value string")
    lines.createOrReplaceTempView("loader_lines")
    got = spark.sql("""SELECT r.* FROM loader_lines, LATERAL load_test(value, '{"a": "int64[pyarrow]", "b": "string[pyarrow]"}') r""")
    assert got.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x"), (7, None), (7, None), (None, None)], key=str)
    assert spark.sql("""SELECT r.* FROM loader_lines, LATERAL load_test(value, '{"b": "string"}') r""").columns == ["b"]


def test_packed_blocks_round_trip_and_faults(spark):
    none = dict.fromkeys("iudsj")
    rows = [{"id": i, "pid": 2**32 - 1, "tid": 2**40, "ts": i, "dur": 0, "type": 3, "ph": 1, "name": f"n{i % 3}", "cat": "é", "values": [none | {"key": "k", "i": -i}, none | {"key": f"s{i}", "s": "ü" * i}, none | {"key": "d", "d": 0.5}]} for i in range(50)]
    data = packed.pack(rows)
    assert list(packed.unpack(data)) == rows and len(data) < len(json.dumps(rows))
    frame = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-3]),), (bytearray(b""),), (None,), (bytearray(b"\x01" * 10),)], "data binary")
    got = packed.unpack_events(frame).collect()
    assert sum(r.error is None for r in got) == 50 + 49 and sum(r.error is not None for r in got) == 2
    back = packed.unpack_events(packed.pack_events(packed.unpack_events(frame).filter("error is null").drop("error"), records=7)).collect()
    assert len(back) == 99 and all(r.error is None for r in back)


def test_large_values_of_many_batches_are_unpacked(spark):
    """Values in flat lists fall to their records, over the rows of a batch and with records that have none."""
    rows = spark.range(10_000, numPartitions=1).select(
        F.expr("transform(sequence(1, cast(id % 4 as int)), k -> struct(concat('k', k) as key, if(k = 1, id, null) as i, if(k = 2, cast(18446744073709551615 - id as decimal(20,0)), null) as u, cast(null as double) as d, if(k = 3, concat('s', id), null) as s, cast(null as string) as j))").alias("values"),
        "id", F.lit(1).alias("pid"), F.lit(1).alias("tid"), F.lit(1).alias("ts"), F.lit(1).alias("dur"), F.lit(1).alias("type"), F.lit(1).alias("ph"), F.lit("n").alias("name"), F.lit("c").alias("cat"))
    rows = rows.withColumn("values", F.when(F.col("id") % 4 > 0, F.col("values")).otherwise(F.expr("slice(values, 1, 0)")))
    back = packed.unpack_events(packed.pack_events(rows, records=9000))
    assert back.count() == 10_000
    assert back.select("id", F.to_json("values").alias("v")).exceptAll(rows.select("id", F.to_json("values").alias("v"))).count() == 0

def lane_rows(spark, path, batches):
    schema = "pid bigint, tid bigint, name string, dur bigint, at timestamp"
    for k, rows in batches:
        spark.createDataFrame(rows, "pid bigint, tid bigint, name string, dur bigint, s bigint").select("pid", "tid", "name", "dur", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    lanes.fold_lanes(stream, flush_ms=10_000, late="100 seconds").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(lanes.FOLDED).parquet(f"{path}/rows").collect())


def test_lanes_take_late_rows_and_go_on_from_their_checkpoint(spark, tmp_path):
    lanes.use_rocksdb(spark)
    path = str(tmp_path)
    first = [(1, 10, "read", 5, 1000), (1, 11, "read", 7, 1001), (2, 20, "write", 1, 1002)]
    assert lane_rows(spark, path, [(0, first), (1, [(1, 10, "end", None, 1005), (1, 10, "read", 6, 1004)])]) == []
    late = [(1, 11, "read", 2, 1003), (1, 11, "open", 4, 1009)]  # after the mark, in a query started anew
    assert lane_rows(spark, path, [(2, late)]) == []
    got = lane_rows(spark, path, [(3, [(3, 1, "x", 1, 1140)])])
    assert got == [(1, 10, "read", 2, 11, 5, 6), (1, 11, "open", 1, 4, 4, 4), (1, 11, "read", 2, 9, 2, 7)]
    assert lane_rows(spark, path, [(4, [(3, 1, "x", 1, 1300)])]) == got  # process 2 hasn't ended


def test_a_process_with_many_lanes_is_many_parts(spark, tmp_path):
    """More batches than a part keeps apart; the lanes of one process are dealt to several states, the end mark to all."""
    lanes.use_rocksdb(spark)
    batches = [(k, [(1, 100 + tid, f"n{tid % 2}", tid + k, 1000 + k) for tid in range(40)]) for k in range(lanes.ELEMENTS + 2)]
    got = lane_rows(spark, str(tmp_path), [*batches, (98, [(1, 0, "end", None, 1020)]), (99, [(3, 1, "x", 1, 1300)])])
    many = len(batches)
    assert got == [(1, 100 + tid, f"n{tid % 2}", many, many * tid + sum(range(many)), tid, tid + many - 1) for tid in range(40)]


def test_windows_come_out_when_later_ones_open(spark, tmp_path):
    schema = "at timestamp, name string, dur bigint, closing boolean"

    def put(k, rows):
        frame = spark.createDataFrame([(*r, False) for r in rows], "s bigint, name string, dur bigint, closing boolean").select(F.timestamp_seconds("s").alias("at"), "name", "dur", "closing")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        return frame

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        tumbling.write_windows(stream, "10 seconds", f"{tmp_path}/rows", f"{tmp_path}/state", keys=("name",)).awaitTermination()
        return {(r.start.timestamp() % 1000, r.name, r.dft_cnt, r.dur_sum) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}

    put(0, [(1001, "a", 1), (1002, "a", 2), (1012, "a", 4)])
    assert run() == {(0.0, "a", 2, 3)}
    whole = put(1, [(1019, "b", 8), (1025, "a", 16)])
    assert run() == {(0.0, "a", 2, 3), (10.0, "a", 1, 4), (10.0, "b", 1, 8)}
    tumbling.closing_row(whole, "20 seconds").write.parquet(f"{tmp_path}/in/2")
    assert run() == {(0.0, "a", 2, 3), (10.0, "a", 1, 4), (10.0, "b", 1, 8), (20.0, "a", 1, 16)}


EVENT = "id bigint, name string, cat string, type int, ph int, pid bigint, tid bigint, ts bigint, dur bigint, args string"


def run_of(pid, tid, ts, value, path, **more):
    args = {"fhash": value, "size": more.get("size", 123456789), "n": more.get("n", 3), "flag": True, "o": {"ppid": pid, "t": f"job {tid}.log"}}
    rows = [(1, "open", "POSIX", 3, 1, pid, tid, ts, 5, json.dumps(args)), (2, "mkstemp", "POSIX", 3, 1, pid, tid, ts + 9, 1, json.dumps({"fhash": value[::-1]}))]
    rows += [(None, "FH", "m", 1, 4, pid, tid, ts, None, json.dumps({"name": path, "value": value})), (None, "FH", "m", 1, 4, pid, tid, ts, None, json.dumps({"name": f"/tmp/{value}", "value": value[::-1]}))]
    rows += [(3 + i, "aio_suspend", "POSIX", 3, 1, pid, tid, ts, 1, "{}") for i in range(more.get("polls", 0))]
    rows += [(9, "fork", "POSIX", 3, 1, pid, tid, ts, 1, json.dumps({"ret": more.get("ret", pid + 1)})), (10, "end", "m", 1, 4, pid, tid, ts + 9, None, json.dumps({"num_events": 5 + more.get("polls", 0), "date": str(ts)}))]
    return rows


def test_equivalence_by_the_traces_own_facts(spark):
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    one = run_of(4711, 4712, 10**12, "00aa00aa00aa00aa", "/d/4711.x")
    said = lambda rows: sorted((r.part, r.name, r.n_left, r.n_right) for r in equivalence.differences(frame(one), frame(rows)).collect())
    other = {"pid": 50005, "tid": 50006, "ts": 3 * 10**12, "value": "1111222233334444", "path": "/d/50005.x"}
    assert said(run_of(**other)) == []
    assert said(run_of(**other, size=987654321)) == [("event", "open", 0, 1), ("event", "open", 1, 0)]
    assert said(run_of(**other, n=4)) == [("event", "open", 0, 1), ("event", "open", 1, 0)]
    assert said(run_of(**other | {"path": "/e/50005.x"})) == [("event", "FH", 0, 1), ("event", "FH", 1, 0), ("event", "open", 0, 1), ("event", "open", 1, 0)]
    assert said(run_of(**other, ret=-1)) == [("event", "fork", 0, 1), ("event", "fork", 1, 0)]
    assert said(run_of(**other, polls=2)) == []  # polls are left out, and from num_events
    assert said(run_of(**other) + [(11, "open", "POSIX", 3, 3, 50005, 50007, 3 * 10**12, 1, '{"dft_cnt":1}')]) == [("calls", "open", 1, 2), ("thread", None, 1, 2)]
    assert said([(77, *r[1:]) if r[0] == 1 else r for r in run_of(**other)]) == [("id", None, 0, 1), ("id", None, 1, 0)]
    assert said([]) and equivalence.differences(frame([]), frame([])).count() == 0


def test_equivalence_makes_its_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    frame = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).mapInArrow(counted, EVENT)
    one, other = run_of(4711, 4712, 10**12, "00aa00aa00aa00aa", "/d/4711.x"), run_of(50005, 50006, 3 * 10**12, "1111222233334444", "/d/50005.x", n=4)
    assert equivalence.differences(frame(one), frame(other)).count() == 2
    assert made.value == len(one) + len(other)


def test_equivalence_in_slices_leaves_only_its_result(spark):
    frame = lambda rows: spark.createDataFrame(rows, EVENT)
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    exchanges = lambda: {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}
    tables = lambda: set(glob.glob(f"{shared_folder(spark)}/*"))
    one, other = run_of(4711, 4712, 10**12, "00aa00aa00aa00aa", "/d/4711.x"), run_of(50005, 50006, 3 * 10**12, "1111222233334444", "/d/50005.x", n=4)
    old_exchanges, old_tables = exchanges(), tables()
    found = equivalence.differences(frame(one), frame(other))
    assert not exchanges() - old_exchanges and len(tables() - old_tables) == 1
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == 2 and sorted(map(tuple, equivalence.differences(frame(one), frame(other), slice_bytes=1).collect())) == rows
    assert len(tables() - old_tables) == 2


def test_nested_records_without_faults_and_of_wrong_types(spark):
    cap = dict.fromkeys(filesystem.CAPACITY, 1)
    good = [
        {"level": "mount", "mhash": "m", "fs": "lustre", "bsize": 1, "namelen": 1, "read_only": 1, "rotational": 0, "capacity": cap, "lustre": {"liblustreapi": 1}},
        {"level": "dir", "dhash": "d", "mhash": "m", "lustre": {"mdt": 0}},
        {"level": "file", "fhash": "f", "dhash": "d", "size": 0, "blksize": 0, "lustre": {"stripe_count": -1, "stripe_size": 1, "osts": []}},
        {"level": "file", "fhash": "g", "dhash": "d", "size": 0, "blksize": 0, "lustre": {"osts": [1, 2], "components": [{"start": 0, "end": 5, "stripe_count": 1, "stripe_size": 1, "osts": [2]}, {"start": 5, "end": "EOF", "stripe_count": 1, "stripe_size": 1, "osts": [1]}]}},
    ]
    names = spark.createDataFrame([(x,) for x in "mdfg"], "value string")
    check = lambda records, keys=("pid",): {(r.level, r.id, r.problem) for r in filesystem.problems(filesystem.parse_records(spark.createDataFrame([(7, json.dumps(r)) for r in records], "pid bigint, args string")), names, keys).collect()}
    assert check(good) == set()
    assert check(good[1:]) == {("mount", None, "no record"), ("dir", "d", "no mount record"), ("dir", "d", "lustre on another mount"), ("file", "f", "lustre in another dir"), ("file", "g", "lustre in another dir")}
    odd = [good[0] | {"fs": "", "bsize": 0, "capacity": {**cap, "free_inodes": -1}, "rotational": 3}, good[1], good[2] | {"size": "x", "lustre": {"osts": [2, 2], "stripe_count": -2, "stripe_size": 4}}]
    assert check(odd) == {("mount", "m", p) for p in ("fs", "bsize", "capacity.free_inodes", "rotational", "lustre on another file system")} | {("file", "f", p) for p in ("size", "osts", "stripe_count")}
