from pyspark.sql import functions as F

from tracelathe.functions import scalars
from tracelathe.operators import aggregate, intervals, joins, stats, validate
from tracelathe.plans import utilities

GOLDEN = [(0, 10, 60), (1, 40, 10), (2, 120, 60), (3, 210, 40), (4, 230, 10), (5, 10, 50), (6, 40, 50), (7, 110, 80), (8, 140, 45), (9, 160, 20), (10, 189, 4), (11, 220, 5)]


def golden(spark):
    return spark.createDataFrame([(i, 1, s, d, s + d) for i, s, d in GOLDEN], "id bigint, pid int, ts bigint, dur bigint, te bigint")


def test_interval_golden(spark):
    union = intervals.interval_union(golden(spark), ["pid"]).orderBy("s").collect()
    assert [(r.s, r.e) for r in union] == [(10, 90), (110, 193), (210, 250)] and sum(r.e - r.s for r in union) == 203
    for width in (7, 50, 1000):
        edges = intervals.overlap_edges(golden(spark), width, ["pid"])
        assert edges.count() == 15
        assert {r.id: r.degree for r in intervals.degrees(edges).collect()} == {0: 3, 1: 3, 2: 3, 3: 2, 4: 1, 5: 3, 6: 3, 7: 4, 8: 3, 9: 3, 10: 1, 11: 1}


def events(spark, rows):
    return spark.createDataFrame([("posix", n, 3, 1, t, d, s, f) for n, t, d, s, f in rows], "cat string, name string, type smallint, tid bigint, ts bigint, dur bigint, size bigint, fhash string")


def test_keys_split_buckets(spark):
    rows = events(spark, [("read", 1, 5, 100, "111"), ("read", 2, 5, 300, "111"), ("read", 3, 5, 200, "222"), ("write", 4, 5, 5, None), ("write", 5, 5, 6, None)])
    got = {(r.name, r.fhash): (r.dft_cnt, r.size_sum, r.size_min) for r in aggregate.interval_aggregate(rows, 1000, ["fhash"], ["size"]).collect()}
    assert got == {("read", "111"): (2, 400, 100), ("read", "222"): (1, 200, 200), ("write", None): (2, 11, 5)}


def test_open_arguments(spark):
    rows = events(spark, [("read", 1, 5, 100, "a"), ("read", 2, 7, 300, "a")]).withColumn("args", F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("fhash"), F.col("fhash"), F.lit("f"), F.lit("0.5")))
    row = aggregate.aggregate_open_args(rows, 1000).first()
    assert row.dft_cnt == 2 and row["values"]["size"].sum == 400 and row["values"]["f"].max == 0.5 and row["values"]["dur"].min == 5 and '"fhash":"a"' in row["keys"]


def test_reaggregation_and_routing_keep_totals(spark):
    rows = events(spark, [("read", 100 * k, k, k, "x") for k in range(50)]).withColumn("ph", F.lit(1).cast("smallint"))
    whole = aggregate.interval_aggregate(rows, 700)
    parts = aggregate.interval_aggregate(rows.filter("dur % 2 = 0"), 700).union(aggregate.interval_aggregate(rows.filter("dur % 2 = 1"), 700))
    assert joins.multiset_difference(whole, aggregate.reaggregate(parts), whole.columns).count() == 0
    routed = aggregate.selective_route(rows, F.col("dur") < 30, 700)
    assert routed.agg(F.sum(aggregate.calls(F.col("ph"), F.col("dft_cnt")))).first()[0] == 50
    once = aggregate.shaped(aggregate.interval_aggregate(rows.limit(1), 700)).first()
    assert once.dur is not None and once.dur_sum is None


def test_scalars(spark):
    row = spark.createDataFrame([("/tmp/x", "a(b)\t'c'", 1536)], "p string, s string, n bigint").select(
        scalars.hash16(F.col("p")).alias("h"), scalars.fix_str(F.col("s")).alias("f"), scalars.human_size(F.col("n")).alias("n"), scalars.human_size(F.lit(0)).alias("z"),
        scalars.absolutize(F.lit("../b/./c"), F.lit("/x/a")).alias("a"), scalars.parent_dir(F.col("p")).alias("d"), scalars.exec_name(F.lit("/usr/bin/python3\0-m\0/opt/run.py\0x\0")).alias("e"),
        scalars.pid_of_file(F.lit("/t/app-123-host.pfw")).alias("pid"), F.to_json(scalars.event_families(F.lit("A:x, y;B:z"))).alias("fam"), scalars.rebase(F.lit(5_000_000), -10_000, "US").alias("r"), scalars.fs_name(F.lit(0xEF53)).alias("fs"),
    ).first()
    assert (row.h, row.f, row.n, row.z, row.a, row.d, row.e, row.pid) == ("7a97ae4523f74db9", "a b   c ", "2KB", "NA", "/x/b/c", "/tmp", "run.py", 123)
    assert row.fam == '[{"family":"A","events":["x","y"]},{"family":"B","events":["z"]}]' and row.r == 5000 and row.fs == "ext4"


def test_sizes_and_programs(spark):
    sizes = {512: "512", 1023: "1020", 1005: "1000", 1536: "2KB", 1024: "1020", 1030: "1KB", 2**20: "1MB", 5 * 2**30: "5GB", 7 * 2**40: "7TB", 3 * 2**50: "3080TB", -2048: "-2KB", 0: "NA", None: "NA", 999: "999"}
    rows = spark.createDataFrame([(k,) for k in sizes], "n bigint").select("n", scalars.human_size(F.col("n")).alias("x"))
    human = lambda n: "NA" if not n else _human(n)

    def _human(n):
        n, k = float(f"{n:.3g}"), 0
        while abs(n) >= 1024 and k < 4:
            n, k = n / 1024, k + 1
        return f"{n:.0f}" + ("", "KB", "MB", "GB", "TB")[k]

    assert {r.n: r.x for r in rows.collect()} == {n: human(n) for n in sizes}
    large = [10**18 + 1, 12355 * 10**15, 219_600_000_000_000_000_000, -(10**22), 7 * 10**30]
    rows = spark.createDataFrame([(str(k),) for k in large], "n string").select("n", scalars.human_size(F.col("n").cast("decimal(38,0)")).alias("x"))
    assert {int(r.n): r.x for r in rows.collect()} == {n: human(n) for n in large}
    commands = {"a/b\0": "b", "env\0python3\0": "DEFAULT", "python\0-c\0from multiprocessing.x\0": "DEFAULT-spawn", "no end": "DEFAULT", "x\0y": "x"}
    rows = spark.createDataFrame([(k,) for k in commands], "c string").select("c", scalars.exec_name(F.col("c")).alias("x"))
    assert {r.c: r.x for r in rows.collect()} == commands


def test_sweeps_by_bins_equal_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i % 2, s, s + rng.choice([0, 0, 1, 5, 40, 300])) for i, s in ((i, rng.randrange(400)) for i in range(300))]
    frame = spark.createDataFrame(rows, "id bigint, pid bigint, ts bigint, te bigint")
    want = {a: n for a, p, s, e in rows if (n := sum(p == q and a != b and s < f and t < e for b, q, t, f in rows))}
    for width in (7, 1000):
        assert {r.id: r.degree for r in intervals.overlap_degrees(frame, ["pid"], width=width).collect()} == want
        union = sorted((r.pid, r.s, r.e) for r in intervals.interval_union(frame, ["pid"], width=width).collect())
        found = []
        for p, s, e in sorted((p, s, e) for _, p, s, e in rows):
            if found and found[-1][0] == p and s <= found[-1][2]:
                found[-1] = (p, found[-1][1], max(e, found[-1][2]))
            else:
                found.append((p, s, e))
        assert union == found
    samples = spark.createDataFrame([(p, t, t * 10) for p in (0, 1) for t in range(5, 400, 37)], "pid bigint, ts bigint, v bigint")
    got = {r.id: r.v for r in joins.asof_last(frame, samples, ["pid"], "v", width=11).collect()}
    assert got == {i: max((t * 10 for t in range(5, 400, 37) if t <= s), default=None) for i, _, s, _ in rows}


def test_three_first_samples(spark):
    rows = spark.createDataFrame([("d", t, v) for t, v in ((1, 10), (2, 15), (3, 15))], "s string, ts bigint, v bigint")
    deltas = lambda first: [r.v_delta for r in stats.counter_delta(rows, ["s"], "v", first).orderBy("ts").collect()]
    assert deltas("omit") == [5, 0] and deltas("cumulative") == [10, 5, 0] == deltas("zero_base")


def test_longest_prefix_prefers_the_device(spark):
    paths = spark.createDataFrame([("/a/b/f", 1), ("/a/bc", 1), ("/z", 9)], "path string, dev int")
    mounts = spark.createDataFrame([("/", 0, 0), ("/a", 1, 1), ("/a/b", 2, 2), ("/a/b", 2, 3)], "point string, mount_dev int, ord int")
    assert {r.path: r.mount for r in joins.longest_prefix(paths, mounts).collect()} == {"/a/b/f": "/a", "/a/bc": "/a", "/z": "/"}


def test_split_and_compact_lose_nothing(spark):
    lines = spark.createDataFrame([("f", i, "x" * (i % 50)) for i in range(300)], "file string, line bigint, value string")
    chunks = utilities.split(lines, 1000)
    assert chunks.count() == 300 and chunks.groupBy("chunk").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).filter("b - a + 1 <> n").count() == 0
    assert utilities.compact(lines, 7).groupBy("part").count().filter("count > 7").count() == 0


def test_exact_arguments(spark):
    rows = spark.sql("""select 'n' as name, parse_json('{"i64":-9007199254740993,"u64":18446744073709551615,"f64":2.5,"flag":1}') as args""")
    row = validate.exact_args(rows).first()
    assert (row.i64, int(row.u64), row.f64, row.flag) == (-9007199254740993, 2**64 - 1, 2.5, 1)
