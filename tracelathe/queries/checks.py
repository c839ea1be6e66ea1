"""Process identity, exact checks, and sources, sinks and scalars that are read back after writing, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelathe.functions import scalars
from tracelathe.operators import aggregate, intervals, joins, rules, validate
from tracelathe.operators.written import new_path
from tracelathe.plans import analysis, metadata, utilities
from tracelathe.queries.events import HOUR
from tracelathe.queries.records import RECORDS, records
from tracelathe.queries.tables import spread, sql, table, trace
from tracelathe.schema import LAYERS, layer_mask, layer_set, to_unit, used_names
from tracelathe.sources import collectors, members, traces

QUERIES, ORACLES = {}, {}
DAY = 24 * HOUR


def query(name, oracle=None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


# Processes: pids repeat on two hosts.


@query("process_hosts", RECORDS.replace("SELECT record, pid, ts,", "SELECT 'h' || ts % 2 AS hhash, record, pid, ts,") + """
SELECT hhash, pid, CAST(max(pid % 64) FILTER (record = 'PR') AS BIGINT) AS rank, min(ts) FILTER (record = 'start') AS "start", max(ts) FILTER (record = 'end') AS "end", count(*) FILTER (record = 'end') > 0 AS ended FROM m GROUP BY hhash, pid""")
def process_hosts(spark, d):
    rows = records(spark, d).withColumn("hhash", F.concat(F.lit("h"), (F.col("ts") % 2).cast("string")))
    return metadata.process_table(rows).select("hhash", "pid", "rank", "start", "end", F.col("values").isNotNull().alias("ended"))


def _hosted(spark, d):
    """The trace on two hosts, and the metadata records of its processes; those with pid 7 have no records."""
    t = trace(spark, d).withColumn("hhash", F.concat(F.lit("h"), (F.col("tid") % 2).cast("string")))
    own = t.filter("pid < 7").select("hhash", "pid").distinct()
    host = F.substring("hhash", 2, 1).cast("int")
    said = F.explode(F.array(F.struct(F.lit("rank").alias("key"), (F.col("pid") * 2 + host).cast("string").alias("value")), F.struct(F.lit("app").alias("key"), F.concat(F.lit("a"), host.cast("string")).alias("value"))))
    marks = own.select("hhash", "pid", said.alias("x")).select(F.lit("PR").alias("record"), "hhash", "pid", F.lit(0).cast("bigint").alias("ts"), "x.*")
    return t, marks


@query("host_ranks", sql("SELECT id, CASE WHEN pid < 7 THEN 'a' || tid % 2 END AS app, CASE WHEN pid < 7 THEN pid * 2 + tid % 2 END AS rank FROM e"))
def host_ranks(spark, d):
    t, marks = _hosted(spark, d)
    return metadata.with_process(t, metadata.process_table(marks)).select("id", "app", "rank")


@query("rule_rank", sql("SELECT id FROM e WHERE pid < 7 AND pid * 2 + tid % 2 >= 4 AND tid % 2 = 1"))
def rule_rank(spark, d):
    """A rule on app and rank, which come from the process table."""
    t, marks = _hosted(spark, d)
    fields = {"rank": (F.col("rank"), "integer"), "app": (F.col("app"), "text")}
    return metadata.with_process(t, metadata.process_table(marks)).filter(rules.rule("rank >= 4 AND app == 'a1'", fields, guard=False)).select("id")


@query("host_durations", sql("SELECT max(s) / 1e6 AS seconds FROM (SELECT pid, tid % 2 AS h, CAST(sum(dur) AS BIGINT) AS s FROM e WHERE name = 'view' GROUP BY ALL)"))
def host_durations(spark, d):
    return analysis.duration_of(_hosted(spark, d)[0], "view", keys=("hhash", "pid"))


@query("asof_nulls", sql("""
SELECT x.id, (SELECT s.size FROM n s WHERE s.pid IS NOT DISTINCT FROM x.pid AND s.cat = 'COMPUTE' AND s.size IS NOT NULL AND s.ts <= x.ts ORDER BY s.ts DESC, s.id DESC LIMIT 1) AS sample FROM n x WHERE x.cat = 'POSIX'""", "n AS (SELECT id, cat, size, CASE WHEN id % 10 > 0 THEN pid END AS pid, CASE WHEN id % 17 > 0 THEN ts END AS ts FROM e)"))
def asof_nulls(spark, d):
    """Samples before events whose process or time may be missing: every event stays."""
    t = trace(spark, d).withColumn("pid", F.when(F.col("id") % 10 > 0, F.col("pid"))).withColumn("ts", F.when(F.col("id") % 17 > 0, F.col("ts")))
    samples = t.filter("cat = 'COMPUTE' and size is not null").groupBy("pid", "ts").agg(F.max_by("size", "id").alias("sample"))
    return joins.asof_last(t.filter("cat = 'POSIX'"), samples, ["pid"], "sample").select("id", "sample")


@query("device_calls", sql("SELECT r.id, c.id AS call_id, c.name AS call_name, r.ts - c.ts AS wait FROM e r LEFT JOIN e c ON r.pid = c.pid AND c.cat = 'POSIX' AND r.tid = c.tid AND r.id // 40 = c.id // 40 WHERE r.cat = 'COMPUTE'"))
def device_calls(spark, d):
    """Device records with the calls of their number (thread and stretch of ids); several calls may have one number."""
    t = trace(spark, d).withColumn("correlation_id", F.col("tid") * 1_000_000 + F.call_function("div", F.col("id"), F.lit(40)))
    return joins.correlated(t.filter("cat = 'COMPUTE'"), t.filter("cat = 'POSIX'"), ["pid"]).select("id", "call_id", "call_name", "wait")


@query("pruned_args", sql("""SELECT id, CASE WHEN id % 2 = 0 THEN '{"relations":{"used":["x' || tid || '"]}}' END AS args FROM e"""))
def pruned_args(spark, d):
    """Arguments of a trace without metadata: only relations stay."""
    text = F.expr("""concat('{"size":', id, if(id % 2 = 0, concat(',"relations":{"used":["x', tid, '"]}'), ''), '}')""")
    return traces.without_metadata(trace(spark, d).withColumn("text", text).withColumn("args", F.expr("try_parse_json(text)"))).select("id", "args")


_CODES = ", ".join(f"({c}, '{n}')" for c, n in LAYERS.items())


@query("used_mask", sql(f"SELECT tid, string_agg(layer, ',' ORDER BY code) AS layers, string_agg(layer, ',' ORDER BY layer) AS used FROM (SELECT DISTINCT tid, code, layer FROM e JOIN (VALUES {_CODES}) v(code, layer) ON code = id % 15) x GROUP BY tid"))
def used_mask(spark, d):
    """The layers that each thread has used, from a mask of bits, and from the JSON of an end record."""
    t = trace(spark, d).withColumn("code", (F.col("id") % 15).cast("int"))
    masks = t.groupBy("tid").agg(F.bit_or(layer_mask(F.col("code"))).alias("mask")).withColumn("names", layer_set(F.col("mask")))
    said = F.concat(F.lit("{"), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('":1'))), ","), F.lit(',"none":0}'))
    return masks.select("tid", F.array_join("names", ",").alias("layers"), F.array_join(used_names(said), ",").alias("used"))


@query("entities_by_phase", sql("SELECT DISTINCT cat AS phase, unnest(['name', 'pid', 'tid']) AS entity, unnest([name, CAST(pid AS VARCHAR), CAST(tid AS VARCHAR)]) AS value FROM e"))
def entities_by_phase(spark, d):
    return analysis.entities_by_phase(trace(spark, d).withColumnRenamed("cat", "phase"), ("name", "pid", "tid"))


@query("entity_counts", sql("SELECT cat AS phase, count(DISTINCT name) AS name, count(DISTINCT pid) AS pid, count(DISTINCT tid) AS tid FROM e GROUP BY cat"))
def entity_counts(spark, d):
    return analysis.entity_counts(trace(spark, d).withColumnRenamed("cat", "phase"), ("name", "pid", "tid"))


@query("compared_totals", sql("""
SELECT coalesce(l.tid, r.tid) AS tid, coalesce(a, 0) AS total_left, coalesce(b, 0) AS total_right, coalesce(a, 0) = coalesce(b, 0) AS equal
FROM (SELECT tid, CAST(sum(size) AS BIGINT) AS a FROM e WHERE name = 'click' AND tid % 3 > 0 GROUP BY tid) l FULL JOIN (SELECT tid, CAST(sum(size) AS BIGINT) AS b FROM e WHERE name = 'click' AND tid % 5 > 0 GROUP BY tid) r ON l.tid IS NOT DISTINCT FROM r.tid"""))
def compared_totals(spark, d):
    t = trace(spark, d).filter("name = 'click'")
    return validate.compared_totals(t.filter("tid % 3 > 0"), t.filter("tid % 5 > 0"), ["tid"], "size")


@query("ordered_intervals", sql(f"SELECT pid, ts // {DAY} * {DAY} AS \"interval\", count(*) AS dft_cnt, row_number() OVER (PARTITION BY pid ORDER BY ts // {DAY}) AS place, CAST(sum(count(*)) OVER (PARTITION BY pid ORDER BY ts // {DAY}) AS BIGINT) AS so_far FROM e GROUP BY pid, ts // {DAY}"))
def ordered_intervals(spark, d):
    """Each process's intervals in order, with their place and the calls so far."""
    rows = trace(spark, d).groupBy("pid", scalars.interval_floor(F.col("ts"), DAY).alias("interval")).agg(F.count(F.lit(1)).alias("dft_cnt")).withColumn("place", F.lit(1))
    found = intervals.running(rows, ["pid"], "interval", [], ["place", "dft_cnt"], 7 * DAY)
    return found.select("pid", "interval", "dft_cnt", F.col("place_so_far").cast("int").alias("place"), F.col("dft_cnt_so_far").alias("so_far")).orderBy("pid", "interval")


# Checks with expected facts.


@query("args_exact", sql("""
SELECT name, 'n' AS key, 'other' AS problem, count(*) AS n FROM e WHERE id % 7 = 0 GROUP BY name
UNION ALL SELECT name, 'list', 'missing', count(*) FROM e WHERE id % 11 = 0 GROUP BY name
UNION ALL SELECT name, 'more', 'unknown', count(*) FROM e WHERE id % 13 = 0 GROUP BY name UNION ALL SELECT 'never', NULL, 'missing', 1"""))
def args_exact(spark, d):
    """Arguments by value and type: a text for a number, a list that is missing, one too many, and a name that never occurs."""
    text = F.expr("""concat('{"hhash":"', tid, '","n":', if(id % 7 = 0, '"4"', '4'), if(id % 11 = 0, '', ',"list":[1,-2,"x"]'), ',"links":{"in":["x"],"out":["y"]}', if(id % 13 = 0, ',"more":0.5', ''), '}')""")
    names = spark.createDataFrame([("never",)], "name string").union(trace(spark, d).select("name").distinct())
    expected = names.withColumn("args", F.lit('{"n":4,"list":[1,-2,"x"],"links":{"in":["x"],"out":["y"]}}'))
    return validate.args_differences(trace(spark, d).select("name", text.alias("args")), expected)


@query("routing_checks", sql("""
SELECT tid AS file, problem FROM (SELECT tid, unnest([CASE WHEN clicks <> 10 THEN 'other number of full events' END, CASE WHEN odd > 0 THEN 'full event of another phase or layer' END, CASE WHEN views > 0 THEN 'folded operation written in full' END, CASE WHEN folded = 0 THEN 'operation not folded' END, CASE WHEN errors <> 1 OR meta <> 1 THEN 'record not written once' END]) AS problem
FROM (SELECT tid, count(*) FILTER (name = 'click') AS clicks, count(*) FILTER (name = 'click' AND id % 9 = 0) AS odd, count(*) FILTER (name = 'view' AND id % 2 = 0) AS views, count(*) FILTER (name = 'view' AND id % 2 = 1) AS folded, count(*) FILTER (name = 'error') AS errors, count(*) FILTER (name = 'error' AND id % 3 > 0) AS meta FROM e GROUP BY tid) c) p WHERE problem IS NOT NULL"""))
def routing_checks(spark, d):
    ph = F.when(F.col("name") == "view", F.when(F.col("id") % 2 == 0, 1).otherwise(3)).when(F.col("name") == "error", F.when(F.col("id") % 3 > 0, 4).otherwise(1)).otherwise(1)
    rows = trace(spark, d).withColumn("ph", ph).withColumn("type", F.when((F.col("name") == "click") & (F.col("id") % 9 == 0), 3).otherwise(130)).withColumnRenamed("tid", "file")
    return validate.routing_problems(rows, "click", "view", "error", 10, 130)


@query("stress_checks", sql("""
SELECT 'calls' AS problem, name AS id, count(*) AS n FROM e GROUP BY name HAVING count(*) <> (SELECT count(*) FROM e WHERE name = 'click')
UNION ALL SELECT 'calls', 'never', 0 UNION ALL SELECT 'recorded twice', '/p/3', 2 UNION ALL SELECT 'unknown hash', 'f' || tid, count(*) FROM e WHERE tid % 10 = 4 GROUP BY tid
UNION ALL SELECT 'length', name, count(*) FROM e WHERE id % 50 = 0 GROUP BY name
UNION ALL SELECT 'uses', '/p/' || tid, count(*) FROM e WHERE tid % 10 <> 4 GROUP BY tid HAVING count(*) <> 66"""))
def stress_checks(spark, d):
    t = trace(spark, d)
    text = F.repeat(F.lit("v"), (F.col("id") % 30).cast("int"))
    events = t.select("name", F.concat(F.lit("f"), F.col("tid").cast("string")).alias("fhash"), text.alias("text"), (F.col("id") % 30 + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("length"))
    files = t.filter("tid % 10 <> 4").select("tid").distinct()
    names = files.select(F.concat(F.lit("f"), F.col("tid").cast("string")).alias("value"), F.concat(F.lit("/p/"), F.col("tid").cast("string")).alias("name"))
    names = names.union(names.filter("name = '/p/3'"))
    calls = t.filter("name = 'click'").count()
    expected = t.select("name").distinct().union(spark.createDataFrame([("never",)], "name string")).withColumn("calls", F.when(F.col("name") == "never", 1).otherwise(calls))
    return validate.stress_problems(events, names, expected, uses=66)


@query("line_count_checks", sql("""
SELECT CAST(tid AS VARCHAR) AS file, count(*) AS events, CASE WHEN tid % 2 = 0 AND count(*) <> 66 THEN 'other count' WHEN tid % 2 = 1 AND count(*) < 66 THEN 'too few' END AS problem FROM e GROUP BY tid UNION ALL SELECT 'none', 0, 'too few'"""))
def line_count_checks(spark, d):
    """Files against an exact or a least number of events; one file has none."""
    t = trace(spark, d)
    lines = t.select(F.col("tid").cast("string").alias("file"), F.concat(F.lit('{"id":'), F.lpad(F.col("id").cast("string"), 9, " "), F.lit("}")).alias("value"))
    framed = lines.union(lines.select("file", F.lit("[").alias("value")).distinct())
    expected = t.select("tid").distinct().select(F.col("tid").cast("string").alias("file"), F.when(F.col("tid") % 2 == 1, 66).alias("least"), F.when(F.col("tid") % 2 == 0, 66).alias("exact"))
    return validate.line_counts(framed, expected.union(spark.createDataFrame([("none", 1, None)], "file string, least int, exact int")))


# Sources and sinks, read back after writing.


def _events(rows):
    return rows.select("id", "name", "cat", F.col("type").cast("int").alias("type"), F.col("ph").cast("int").alias("ph"), "pid", "tid", "ts", "dur")


_BACK = sql("SELECT id, name, cat, CAST(type AS INTEGER) AS type, CAST(ph AS INTEGER) AS ph, pid, tid, ts, dur FROM e")


@query("read_plain", _BACK)
def read_plain(spark, d):
    """Two plain files, one in the older array form, read by a pattern."""
    path, t = new_path(spark, "plain"), trace(spark, d)
    lines = t.select("id", traces.json_line(t.drop("te", "size")).alias("value"))
    lines.filter("id % 2 = 0").select("value").coalesce(1).write.text(f"{path}/a")
    framed = lines.filter("id % 2 = 1").select(F.concat(F.lit("  "), F.col("value"), F.lit(",")).alias("value"))
    framed.union(spark.createDataFrame([("[",), ("]",), ("",)], "value string")).coalesce(1).write.text(f"{path}/b")
    return _events(traces.read_trace(spark, f"{path}/*/*.txt"))


@query("read_gzip_members", _BACK)
def read_gzip_members(spark, d):
    """Gzip files of many members, read as text by the built-in reader."""
    path, t = new_path(spark, "members"), trace(spark, d)
    members.write_members(t.repartition(3).select(traces.json_line(t.drop("te", "size")).alias("value")), path, 500).count()
    return _events(traces.read_trace(spark, f"{path}/*.gz"))


@query("read_split_members", _BACK)
def read_split_members(spark, d):
    """The same by the reader that cuts files at members, with ranges of 32 KB."""
    path, t = new_path(spark, "members"), trace(spark, d)
    members.write_members(spread(t).select(traces.json_line(t.drop("te", "size")).alias("value")), path, 200).count()
    return _events(traces.parse_events(members.member_lines(spark, f"{path}/*.gz", 32 << 10)))


@query("line_ranges", sql("SELECT id // 1000 AS batch, min(id) AS low, max(id) AS high, count(*) AS n FROM e GROUP BY 1"))
def line_ranges(spark, d):
    """A written trace's lines, in files in order of ids, numbered through all of them and read by ranges of 1,000 lines."""
    path, t = new_path(spark, "lines"), trace(spark, d)
    t.repartitionByRange("id").sortWithinPartitions("id").select(traces.json_line(t.drop("te", "size")).alias("value")).write.text(path)
    rows = traces.line_batches(traces.with_line_numbers(traces.read_lines(spark, path), through=True), 1000)
    events = rows.withColumn("id", F.get_json_object("value", "$.id").cast("bigint"))
    return events.groupBy((F.col("batch") / 1000).cast("bigint").alias("batch")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))


@query("benchmark_csv", "SELECT c_custkey AS ranks, c_acctbal AS bandwidth, c_mktsegment AS mode FROM customer")
def benchmark_csv(spark, d):
    path = new_path(spark, "csv")
    table(spark, d, "customer").select(F.col("c_custkey").alias(" ranks "), F.col("c_acctbal").alias("bw MiB"), F.col("c_mktsegment").alias("mode"), "c_name").write.option("header", True).csv(path)
    return traces.read_benchmarks(spark, path, {"ranks": "ranks", "bw MiB": "bandwidth", "mode": "mode"}).withColumn("ranks", F.col("ranks").cast("bigint"))


@query("summary_csv", sql("SELECT name, count(*) AS n, CAST(sum(dur) AS BIGINT) AS total FROM e GROUP BY name"))
def summary_csv(spark, d):
    path = new_path(spark, "csv")
    utilities.write_summary(trace(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total")), path, ["name"])
    return spark.read.option("header", True).schema("name string, n bigint, total bigint").csv(path)


@query("small_traces", sql("SELECT id FROM e WHERE tid IN (SELECT tid FROM e GROUP BY tid HAVING count(*) >= 66)"))
def small_traces(spark, d):
    return traces.drop_small_traces(trace(spark, d), 66, ("tid",)).select("id")


@query("recompressed", sql("SELECT id, name FROM e"))
def recompressed(spark, d):
    path, t = new_path(spark, "gzip"), trace(spark, d)
    utilities.recompress(t.select(F.to_json(F.struct("id", "name")).alias("value")), path)
    return spark.read.text(f"{path}/*.gz").select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.get_json_object("value", "$.name").alias("name"))


@query("compact_pids", sql("SELECT pid, part, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT pid, id, (row_number() OVER (PARTITION BY pid ORDER BY id) - 1) // 100 AS part FROM e) x GROUP BY ALL"))
def compact_pids(spark, d):
    """Lines of files named by pid, compacted per pid, 100 lines a part; other files have no pid and are one group."""
    t = trace(spark, d).select("id", F.col("id").alias("line"), F.concat(F.lit("/t/app-"), F.col("pid").cast("string"), F.lit("-x.pfw")).alias("file"), F.lit("x").alias("value"))
    return utilities.compact_by_pid(t, 100).groupBy("pid", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("loaded_columns", sql("SELECT id, size, size * 2 AS twice FROM e"))
def loaded_columns(spark, d):
    """Columns of the user's own, made of whole records while a trace is read."""
    path, t = new_path(spark, "plain"), trace(spark, d)
    t.select(traces.json_line(t, ["size"]).alias("value")).write.text(path)
    size = F.try_variant_get("v", "$.args.size", "bigint")
    return traces.read_trace(spark, path, {"size": size, "twice": size * 2}).select("id", "size", "twice")


@query("condition_views", sql("SELECT id, name LIKE '%item%' AS app_io, name LIKE '%compute%' AS compute, cat IN ('POSIX', 'STDIO') AS io FROM (SELECT id, cat, CASE id % 3 WHEN 0 THEN name || '.compute' WHEN 1 THEN 'item.' || name ELSE name END AS name FROM e) x"))
def condition_views(spark, d):
    name = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(".compute"))).when(F.col("id") % 3 == 1, F.concat(F.lit("item."), F.col("name"))).otherwise(F.col("name"))
    return trace(spark, d).withColumn("name", name).select("id", *(c.alias(k) for k, c in analysis.conditions().items()))


_RULES = """
rules:
  inclusion:
    - cat == 'POSIX'
    - "name LIKE 'p*'"  # purchases
  exclusion:
    - dur < 100000000
"""


@query("rule_file", sql("SELECT id FROM e WHERE (cat = 'POSIX' OR name LIKE 'p%') AND NOT dur < 100000000"))
def rule_file(spark, d):
    """Rules from the text of a rule file."""
    fields = {"name": (F.col("name"), "text"), "cat": (F.col("cat"), "text"), "dur": (F.col("dur"), "integer")}
    include, exclude = rules.load_rules(_RULES)
    return trace(spark, d).filter(rules.should_aggregate(include, exclude, fields, guard=False)).select("id")


# Scalars over names and times that the tables make.


@query("unit_times", sql("SELECT id, ts // 1000 AS ms, ts * 1000 AS ns, ts // 1000000 AS seconds FROM e"))
def unit_times(spark, d):
    ts = F.col("ts")
    return trace(spark, d).select("id", to_unit(ts, "US", "MS").alias("ms"), to_unit(ts, "US", "NS").alias("ns"), to_unit(ts, "US", "SEC").alias("seconds"))


@query("width_intervals", sql("SELECT ts // 1500000 * 1500000 AS \"interval\", count(*) AS n FROM e GROUP BY 1"))
def width_intervals(spark, d):
    """Intervals of 1,500 ms of a trace in microseconds."""
    width = scalars.interval_width(1500, 1_000_000)
    return trace(spark, d).groupBy(scalars.interval_floor(F.col("ts"), width).alias("interval")).agg(F.count(F.lit(1)).alias("n"))


@query("clock_rebase", sql("SELECT id, CASE WHEN dur * 7 // 1000 - 1000000 > 0 THEN dur * 7 // 1000 - 1000000 ELSE dur * 7 // 1000 END AS ts FROM e"))
def clock_rebase(spark, d):
    return trace(spark, d).select("id", scalars.rebase(F.col("dur") * 7, -1_000_000, "US").alias("ts"))


_FILE = "c_name || CASE c_custkey % 4 WHEN 0 THEN '.pfw.gz' WHEN 1 THEN '.pfw' WHEN 2 THEN '.gz' ELSE '.log' END"


@query("log_names", f"SELECT c_custkey, '/l/' || c_name || CASE WHEN c_custkey % 4 = 3 THEN '.log' ELSE '' END AS base, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS pid FROM (SELECT *, {_FILE} AS f FROM customer) x")
def log_names(spark, d):
    """Base names of log files, and the pids in trace names."""
    c = table(spark, d, "customer")
    file = F.concat(F.lit("/l/"), F.col("c_name"), F.element_at(F.array(*(F.lit(x) for x in (".pfw.gz", ".pfw", ".gz", ".log"))), (F.col("c_custkey") % 4 + 1).cast("int")))
    named = F.concat(F.lit("/t/a-b-"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey").cast("string")).otherwise("x"), F.lit("-app.pfw"))
    return c.select("c_custkey", scalars.log_base(file).alias("base"), scalars.pid_of_file(named).alias("pid"))


@query("counter_families", "SELECT p_partkey, unnest(['CPU', 'L' || p_size]) AS family, unnest([[CAST(p_partkey AS VARCHAR), 'b'], ['x']]) AS events FROM part")
def counter_families(spark, d):
    text = F.expr("concat('CPU:', p_partkey, ', b,', p_partkey, ';nothing;L', p_size, ':x,')")
    return table(spark, d, "part").select("p_partkey", F.explode(scalars.event_families(text)).alias("f")).select("p_partkey", "f.family", "f.events")


@query("device_checks", sql("""
SELECT 'missing category' AS problem, 'memcpy' AS id UNION ALL SELECT 'time', CAST(id AS VARCHAR) FROM e WHERE cat = 'COMPUTE' AND id % 40 = 0
UNION ALL SELECT 'outside every region', CAST(x.id AS VARCHAR) FROM e x WHERE x.cat = 'COMPUTE' AND x.id % 40 > 0 AND NOT EXISTS (SELECT 1 FROM e r WHERE r.cat = 'POSIX' AND r.pid = x.pid AND r.ts <= x.ts AND r.ts + 3600000000 >= x.te)"""))
def device_checks(spark, d):
    """Device records in the regions of their process, each an hour from a call; one category never occurs."""
    t = trace(spark, d)
    records = t.filter("cat = 'COMPUTE'").withColumn("dur", F.when(F.col("id") % 40 == 0, -1).otherwise(F.col("dur")))
    regions = t.filter("cat = 'POSIX'").select("pid", F.col("id").alias("region"), F.col("ts").alias("rs"), (F.col("ts") + 3_600_000_000).alias("re"))
    return validate.device_problems(records.select("pid", "id", "cat", "ts", "dur"), regions, ["COMPUTE", "memcpy"], ["pid"])


def _load(lines):
    """A collector of the user's own: /proc/loadavg."""
    words = F.split("value", " ")
    return lines.select("file", F.lit("load").alias("name"), words[0].cast("double").alias("one"), words[1].cast("double").alias("five"))


@query("collected", """
SELECT collector, file, series, field, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'io' AS collector, CAST(p_partkey AS VARCHAR) AS file, 'sda' AS series, unnest(['reads', 'read_bytes', 'writes', 'write_bytes', 'ios_in_progress']) AS field, unnest([p_partkey, p_size * 512, p_partkey + 1, (p_partkey + 2) * 512, p_size]) AS value FROM part
  UNION ALL SELECT 'load', CAST(p_partkey AS VARCHAR), 'load', unnest(['one', 'five']), unnest([p_size + 0.5, p_partkey]) FROM part
  UNION ALL SELECT 'exposition', NULL, 'gpu_power.card="' || p_partkey || '"', 'value', p_size FROM part) x""")
def collected(spark, d):
    """Numbers of two built-in collectors and of a registered one, from lines of all."""
    collectors.register("load", _load, ("name",))
    texts = {"io": "concat('   8       0 sda ', p_partkey, ' 0 ', p_size, ' 0 ', p_partkey + 1, ' 0 ', p_partkey + 2, ' 0 ', p_size, ' 0 0')", "load": "concat(p_size, '.5 ', p_partkey, ' 1 2/3 4')", "exposition": "concat('gpu_power{card=\"', p_partkey, '\"} ', p_size)"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("collector"), F.expr(t).alias("value")) for k, t in texts.items()))).alias("x")
    lines = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), each).select("x.collector", "file", "x.value")
    return collectors.collect(lines, ["io", "load", "exposition"])
