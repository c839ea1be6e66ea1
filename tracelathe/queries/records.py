"""Sources, telemetry, writers and metadata, each over texts and records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelathe.functions import scalars
from tracelathe.operators import aggregate, stats
from tracelathe.plans import metadata, utilities
from tracelathe.plans.analysis import io_size
from tracelathe.queries.events import HOUR
from tracelathe.queries.tables import spread, sql, table, trace
from tracelathe.sources import adapters, telemetry, traces

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


_SIZE = "CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN l_orderkey * l_partkey ELSE l_orderkey * l_partkey * l_suppkey * l_linenumber * CAST(l_quantity AS BIGINT) END"


@query("human_size", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, {_SIZE} AS v FROM lineitem),
r AS (SELECT *, CAST(format('{{:.3g}}', CAST(v AS DOUBLE)) AS DOUBLE) AS x FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL OR v = 0 THEN 'NA' WHEN x >= 1099511627776 THEN format('{{:.0f}}', x / 1099511627776) || 'TB' WHEN x >= 1073741824 THEN format('{{:.0f}}', x / 1073741824) || 'GB'
  WHEN x >= 1048576 THEN format('{{:.0f}}', x / 1048576) || 'MB' WHEN x >= 1024 THEN format('{{:.0f}}', x / 1024) || 'KB' ELSE format('{{:.0f}}', x) END AS x FROM r""")
def human_size(spark, d):
    """The products are decimals: those of large tables' keys are beyond a bigint."""
    size = _SIZE.replace("l_orderkey *", "CAST(l_orderkey AS DECIMAL(38, 0)) *")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.human_size(F.expr(size)).alias("x"))


_COMMANDS = ("/usr/bin/python3.9|-m|/opt/app/run|x|", "env|/bin/sh|-c|", "python|-c|from multiprocessing.spawn import main|", "python3|-u|", "/a/b/ior|-a|POSIX|", "solver|", "/x/pyenv/bin/train|/y/work.py|", "")
_PICKED = ("run", "sh", "DEFAULT-spawn", "DEFAULT", "ior", "solver", "train", "DEFAULT")


def _choice(column, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def _choice_sql(column, values):
    return f"[{', '.join(repr(v) for v in values)}][{column} % {len(values)} + 1]"


@query("exec_name", f"SELECT p_partkey, {_choice_sql('p_partkey', _PICKED)} AS x, replace(p_name, ' ', '_') AS own FROM part")
def exec_name(spark, d):
    """Programs of fixed command lines, and of lines made of parts' names behind interpreters and options."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    behind = F.concat(_choice("p_partkey", ("", "env|", "/usr/bin/python3|-m|", "python|-u|-O|")), F.lit("/opt/x"), F.col("p_size").cast("string"), F.lit("/"), name, F.lit("|--size="), F.col("p_size").cast("string"), F.lit("|"))
    return table(spark, d, "part").select("p_partkey", scalars.exec_name(_choice("p_partkey", _COMMANDS), "|").alias("x"), scalars.exec_name(behind, "|").alias("own"))


_MAGICS = (0x0BD00BD0, 0x47504653, 0x19830326, 0x00C36400, 0x6969, 0xEF53, 0x58465342, 0x9123683E, 0x2FC12FC1, 0x01021994, 0x794C7630, 0x73717368, 0x65735546, 0x9FA0, 0x62656572, 0x6E667364, 0xFF534D42, 0xABC)
_FS = ("lustre", "gpfs", "beegfs", "ceph", "nfs", "ext4", "xfs", "btrfs", "zfs", "tmpfs", "overlayfs", "squashfs", "fuse", "proc", "sysfs", "nfsd", "cifs", "0xabc")


@query("fs_name", f"SELECT c_custkey, {_choice_sql('c_custkey', _FS)} AS x, '0x' || lower(to_hex(c_custkey * 1000003 + 1)) AS unknown FROM customer")
def fs_name(spark, d):
    """Names of known numbers, and of unknown ones that customers' keys make."""
    return table(spark, d, "customer").select("c_custkey", scalars.fs_name(_choice("c_custkey", _MAGICS)).alias("x"), scalars.fs_name(F.col("c_custkey") * 1_000_003 + 1).alias("unknown"))


_PATHS = ("power_node_watts", "socket_0.power_gpus_watts.GPU_0", "socket_1.power_mem_watts", "power_dram_watts.x", "num_gpus_per_socket", "net.rate", "fan.speed", "socket_0.power_cpu_watts", "a.power__watts")
_FAMILY = ("node", "gpu", "memory", "dram", "gpu", "network", "other", "cpu", "other")
_READING = ("total", "socket_0.GPU_0", "socket_1", "x", "num_gpus_per_socket", "net.rate", "fan.speed", "socket_0", "a.power__watts")


@query("power_family", f"SELECT p_partkey, {_choice_sql('p_partkey', _FAMILY)} AS family, {_choice_sql('p_partkey', _READING)} AS reading, 'own' || p_size AS own_family, 'socket_' || p_partkey || '.part_' || p_size AS own_reading FROM part")
def power_family(spark, d):
    """Families and readings of fixed paths, and of paths with families that parts' sizes make."""
    path = _choice("p_partkey", _PATHS)
    own = F.expr("concat('socket_', p_partkey, '.power_own', p_size, '_watts.part_', p_size)")
    return table(spark, d, "part").select("p_partkey", telemetry.power_family(path).alias("family"), telemetry.power_reading(path).alias("reading"), telemetry.power_family(own).alias("own_family"), telemetry.power_reading(own).alias("own_reading"))


@query("io_size", sql("SELECT id, CASE WHEN cat = 'POSIX' THEN CASE WHEN op = 'write' OR op = 'read' THEN size END ELSE size + 1 END AS bytes FROM (SELECT *, ['write', 'read', 'readdir', 'stat'][id % 4 + 1] AS op FROM e) x"))
def io_sizes(spark, d):
    op = _choice("id", ("write", "read", "readdir", "stat"))
    return trace(spark, d).select("id", io_size(F.col("cat"), op, F.col("size"), F.col("size") + 1).alias("bytes"))


@query("segments_to_events", "SELECT e.event_id AS id, event_type AS name, user_id % 8 AS pid, CAST(0 AS BIGINT) AS tid, 2 AS phase, CAST(trunc(value * 10e6) AS BIGINT) AS ts, CAST(trunc((value + user_id / 7.0) * 10e6) AS BIGINT) - CAST(trunc(value * 10e6) AS BIGINT) AS dur, c_name AS file FROM events e LEFT JOIN customer ON user_id = c_custkey")
def segments_to_events(spark, d):
    e = table(spark, d, "events")
    segments = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("hostname"), (F.col("user_id") % 8).alias("rank"), F.col("event_type").alias("op"), F.lit(1).alias("length"), F.col("value").alias("start_time"), F.expr("value + user_id / 7.0D").alias("end_time"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file"))
    return adapters.segments_to_events(segments, names).select(F.col("hostname").alias("id"), "name", "pid", "tid", "phase", "ts", "dur", "file")


@query("recorder_events", "SELECT event_id AS ts, event_type AS name FROM events WHERE event_id % 5 > 0 AND event_id % 7 <> 3")
def recorder_events(spark, d):
    e = table(spark, d, "events")
    records = e.select((F.col("event_id") % 5).alias("func_id"), F.when(F.col("event_id") % 7 == 3, "MPI_Send").otherwise(F.col("event_type")).alias("name"), F.lit(0).alias("rank"), F.lit(0).alias("tid"), F.col("event_id").alias("tstart"), (F.col("event_id") + 5).alias("tend"))
    return adapters.recorder_to_events(records).select("ts", "name")


def _lines(rows, key, *texts):
    """One line per text and row: file, value."""
    return rows.select(F.col(key).cast("string").alias("file"), F.explode(F.array(*(F.expr(t) for t in texts))).alias("value"))


@query("exposition", "SELECT 'gpu_power' AS metric, CAST(p_size AS DOUBLE) + 0.5 AS value, 'card=\"' || p_partkey || '\"' AS labels FROM part UNION ALL SELECT 'up', 1.0, '' FROM part")
def exposition(spark, d):
    return telemetry.exposition(_lines(table(spark, d, "part"), "p_partkey", "'# HELP gpu_power watts'", "concat('gpu_power{card=\"', p_partkey, '\"} ', p_size, '.5')", "concat('up 1', char(13))", "'bad line here now'", "'broken{ 1'"))


@query("proc_stat", "SELECT name, 100.0 * u / t AS user_pct, 100.0 * i / t AS idle_pct FROM (SELECT 'cpu-' || p_partkey AS name, p_size AS u, p_partkey AS i, p_size + p_partkey + 3 AS t FROM part UNION ALL SELECT 'cpu', 0, p_partkey, p_partkey + 1 FROM part) x")
def proc_stat(spark, d):
    return telemetry.proc_stat(_lines(table(spark, d, "part"), "p_partkey", "concat('cpu', p_partkey, ' ', p_size, ' 1 2 ', p_partkey, ' 0 0 0 0 0 0')", "concat('cpu  0 0 1 ', p_partkey, ' 0 0 0 0 0 0')", "'intr 5 6 7'")).select("name", "user_pct", "idle_pct")


@query("meminfo", "SELECT CAST(p_partkey AS VARCHAR) AS file, key, kb, CASE WHEN key = 'MemAvailable' THEN CAST(kb AS DOUBLE) WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 100.0 * kb / p_size END AS percent FROM (SELECT p_partkey, p_size, 'MemTotal' AS key, p_partkey AS kb FROM part UNION ALL SELECT p_partkey, p_size, 'MemAvailable', p_size FROM part WHERE p_partkey % 3 > 0) x")
def meminfo(spark, d):
    return telemetry.meminfo(_lines(table(spark, d, "part"), "p_partkey", "concat('MemTotal: ', p_partkey, ' kB')", "if(p_partkey % 3 > 0, concat('MemAvailable:   ', p_size, ' kB'), 'HugePages: none')"))


@query("diskstats", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'sda' AS device, p_partkey AS reads, CAST(p_size AS BIGINT) * 512 AS read_bytes, p_partkey + 1 AS writes, (p_partkey + 2) * 512 AS write_bytes, CAST(p_size AS BIGINT) AS ios_in_progress FROM part")
def diskstats(spark, d):
    return telemetry.diskstats(_lines(table(spark, d, "part"), "p_partkey", "concat('   8       0 sda ', p_partkey, ' 0 ', p_size, ' 0 ', p_partkey + 1, ' 0 ', p_partkey + 2, ' 0 ', p_size, ' 0 0')", "'   7 0 loop0 1 0 1 0 1 0 1 0 0 0 0'", "'   1 0 ram0 1 0 1 0 1 0 1 0 0 0 0'", "'   8 1 sdb 1'"))


@query("net_dev", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'eth0' AS interface, p_partkey AS rx_bytes, CAST(1 AS BIGINT) AS rx_packets, CAST(p_size AS BIGINT) AS tx_bytes, CAST(12 AS BIGINT) AS tx_dropped, p_partkey + 7 AS collisions FROM part")
def net_dev(spark, d):
    found = telemetry.net_dev(_lines(table(spark, d, "part"), "p_partkey", "'Inter-|   Receive'", "concat('  eth0: ', p_partkey, ' 1 2 3 4 5 6 7 ', p_size, ' 10 11 12 13 ', p_partkey + 7, ' 15 16')", "'    lo: 1 1 2 3 4 5 6 7 9 10 11 12 13 14 15 16'"))
    return found.select("file", "interface", "rx_bytes", "rx_packets", "tx_bytes", "tx_dropped", "collisions")


@query("power_leaves", "SELECT 'power_node_watts' AS path, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'socket_0.power_gpu_watts.GPU_0', p_partkey FROM part UNION ALL SELECT 'list.0', 1.5 FROM part UNION ALL SELECT 'list.2.a', p_size FROM part UNION ALL SELECT 'd.d.d.d.d.d.d.d.d', p_partkey FROM part")
def power_leaves(spark, d):
    deep = "concat('{\"d\":{\"d\":{\"d\":{\"d\":{\"d\":{\"d\":{\"d\":{\"d\":{\"d\":', p_partkey, '}}}}}}}}}')"
    text = f"concat('{{\"h', p_partkey, '\":{{\"timestamp\":1,\"power_node_watts\":', p_size, ',\"socket_0\":{{\"name\":\"x\",\"power_gpu_watts\":{{\"GPU_0\":', p_partkey, '}}}},\"list\":[1.5,\"x\",{{\"a\":', p_size, '}}],', substring({deep}, 2), '}}')"
    return telemetry.power_leaves(spread(table(spark, d, "part")).select(F.expr(f"try_parse_json({text})").alias("v")))


@query("mountinfo", r"SELECT '/p/my dir' || p_partkey AS point, '0:' || p_size AS device, 'nfs' AS fstype, 'srv:/x' AS source, CAST(p_partkey AS INTEGER) AS ord FROM part")
def mountinfo(spark, d):
    rows = _lines(table(spark, d, "part"), "p_partkey", r"concat(p_partkey, ' 1 0:', p_size, ' / /p/my\\040dir', p_partkey, ' rw shared:5 master:2 - nfs srv:/x rw')", "'too short'")
    return telemetry.mountinfo(rows)


# Writers: the lines themselves are compared.


def _head(ts="ts", more=""):
    return f"""'{{"id":' || id || ',"name":"' || name || '","cat":"' || cat || '","type":' || type || ',"pid":' || pid || ',"tid":' || tid || ',"ts":' || {ts} || ',"dur":' || dur || ',"ph":1{more}'"""


@query("event_writer", sql(f"""SELECT id, {_head()} || CASE WHEN size IS NULL THEN ',"args":{{}}' ELSE ',"args":{{"size":' || size || '}}' END || '}}' AS line FROM e"""))
def event_writer(spark, d):
    rows = trace(spark, d)
    return rows.select("id", traces.json_line(rows, ["size"]).alias("line"))


@query("counter_writer", sql("""SELECT id, '{"name":"' || name || '","cat":"' || cat || '","type":' || type || ',"ts":' || ts || ',"ph":2,"pid":' || pid || ',"tid":' || tid || ',"args":{"tid":' || tid || '}}' AS line FROM e"""))
def counter_writer(spark, d):
    rows = trace(spark, d).withColumn("ph", F.lit(2))
    return rows.select("id", traces.series_line(rows, ["tid"]).alias("line"))


@query("aggregate_writer", sql(f"""
SELECT '{{"name":"' || name || '","cat":"' || cat || '","type":' || type || ',"ts":' || i || ',"ph":3,"tid":' || tid || ',"args":{{"dft_cnt":' || n ||
  CASE WHEN n = 1 THEN ',"dur":' || s ELSE ',"dur_sum":' || s || ',"dur_min":' || lo || ',"dur_max":' || hi END || '}}}}' AS line
FROM (SELECT name, cat, type, tid, ts // {24 * HOUR} * {24 * HOUR} AS i, count(*) AS n, CAST(sum(dur) AS BIGINT) AS s, min(dur) AS lo, max(dur) AS hi FROM e GROUP BY ALL) x"""))
def aggregate_writer(spark, d):
    rows = aggregate.interval_aggregate(trace(spark, d), 24 * HOUR)
    return rows.select(traces.aggregated_line(rows).alias("line"))


_KINDS = ("FH", "SH", "HH", "CM", "PR", "end", "start")


def records(spark, d):
    """Orders as metadata records of processes (customers)."""
    o = table(spark, d, "orders")
    kind = _choice("o_orderkey", _KINDS)
    key = F.when(kind == "PR", "rank").when(kind == "end", F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    value = F.when(kind == "PR", (F.col("o_custkey") % 64).cast("string")).otherwise(F.concat(F.col("o_orderstatus"), (F.col("o_orderkey") % 10).cast("string")))
    return o.select(kind.alias("record"), F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("ts"), (F.col("o_orderkey") % 3).cast("int").alias("type"), F.lit(5).alias("tid"), F.lit("ab").alias("hhash"), key.alias("key"), value.alias("value"))


RECORDS = f"""WITH m AS (
  SELECT record, pid, ts, type, CASE record WHEN 'PR' THEN 'rank' WHEN 'end' THEN o_orderpriority ELSE o_orderstatus END AS key, CASE record WHEN 'PR' THEN CAST(pid % 64 AS VARCHAR) ELSE o_orderstatus || ts % 10 END AS value
  FROM (SELECT *, {_choice_sql('o_orderkey', _KINDS)} AS record, o_custkey AS pid, o_orderkey AS ts, CAST(o_orderkey % 3 AS INTEGER) AS type FROM orders) x)"""


@query("metadata_writer", RECORDS + """ SELECT ts, '{"name":"' || record || '","cat":"meta","type":' || type || ',"pid":' || pid || ',"tid":5,"ph":4,"args":{"hhash":"ab","name":"' || key || '","value":"' || value || '"}}' AS line FROM m""")
def metadata_writer(spark, d):
    rows = records(spark, d)
    return rows.select("ts", traces.metadata_line(rows, "meta").alias("line"))


@query("hash_names", RECORDS + " SELECT DISTINCT record AS kind, value, key AS name FROM m WHERE record IN ('FH', 'SH', 'HH')")
def hash_names(spark, d):
    return metadata.names_of(records(spark, d))


@query("custom_values", RECORDS + " SELECT pid, key, value, type, ts FROM m WHERE record = 'CM' AND type <> 1")
def custom_values(spark, d):
    return metadata.custom_values(records(spark, d))


@query("process_table", RECORDS + """, last AS (SELECT pid, key, arg_max(value, ts) AS value FROM m WHERE record = 'end' GROUP BY pid, key),
ends AS (SELECT pid, string_agg(key || '=' || value, ',' ORDER BY key) AS vals FROM last GROUP BY pid)
SELECT h.*, vals FROM (SELECT pid, CAST(max(pid % 64) FILTER (record = 'PR') AS BIGINT) AS rank, min(value) FILTER (record = 'HH') AS hhash, min(ts) FILTER (record = 'start') AS "start", max(ts) FILTER (record = 'end') AS "end" FROM m GROUP BY pid) h LEFT JOIN ends USING (pid)""")
def process_table(spark, d):
    rows = metadata.process_table(records(spark, d), ["pid"])
    pairs = F.array_join(F.transform(F.map_entries("values"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return rows.select("pid", "rank", "hhash", "start", "end", pairs.alias("vals"))


@query("world_size", RECORDS + " SELECT count(DISTINCT value) AS ranks FROM m WHERE record = 'PR'")
def world_size(spark, d):
    return metadata.world_size(records(spark, d))


def _fs_tables(spark, d):
    """Customers are files, nations directories and regions mounts of processes 0 and 1; some levels are missing."""
    pids = spark.range(2).select(F.col("id").alias("pid"))
    files = table(spark, d, "customer").select((F.col("c_custkey") % 2).alias("pid"), F.lit("file").alias("level"), F.col("c_custkey").cast("string").alias("fhash"), F.concat(F.lit("d"), "c_nationkey").alias("dhash"), F.lit(None).cast("string").alias("mhash"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("size"), F.lit(None).cast("string").alias("fs"))
    dirs = table(spark, d, "nation").crossJoin(F.broadcast(pids)).filter("n_nationkey % 7 <> pid * 3").select("pid", F.lit("dir").alias("level"), F.lit(None).cast("string").alias("fhash"), F.concat(F.lit("d"), "n_nationkey").alias("dhash"), F.concat(F.lit("m"), "n_regionkey").alias("mhash"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("fs"))
    mounts = table(spark, d, "region").crossJoin(F.broadcast(pids)).filter("r_regionkey <> pid").select("pid", F.lit("mount").alias("level"), F.lit(None).cast("string").alias("fhash"), F.lit(None).cast("string").alias("dhash"), F.concat(F.lit("m"), "r_regionkey").alias("mhash"), F.lit(None).cast("bigint").alias("size"), F.col("r_name").alias("fs"))
    return files, dirs, mounts


_FS_SQL = """f AS (SELECT c_custkey % 2 AS pid, CAST(c_custkey AS VARCHAR) AS fhash, 'd' || c_nationkey AS dhash, CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS size FROM customer),
d AS (SELECT pid, 'd' || n_nationkey AS dhash, 'm' || n_regionkey AS mhash FROM nation, (SELECT unnest([0, 1]) AS pid) p WHERE n_nationkey % 7 <> pid * 3),
m AS (SELECT pid, 'm' || r_regionkey AS mhash, r_name AS fs FROM region, (SELECT unnest([0, 1]) AS pid) p WHERE r_regionkey <> pid)"""


@query("fs_process_join", sql("SELECT x.id, f.size AS file_size, d.mhash, m.fs FROM (SELECT id, id % 2 AS p, CAST(tid AS VARCHAR) AS h FROM e) x LEFT JOIN f ON f.pid = p AND f.fhash = h LEFT JOIN d ON d.pid = p AND d.dhash = f.dhash LEFT JOIN m ON m.pid = p AND m.mhash = d.mhash", _FS_SQL))
def fs_process_join(spark, d):
    events = trace(spark, d).select("id", (F.col("id") % 2).alias("pid"), F.col("tid").cast("string").alias("fhash"))
    return metadata.fs_join(events, *_fs_tables(spark, d)).select("id", "file_size", "mhash", "fs")


@query("fs_record_check", f"""WITH {_FS_SQL}, k AS (SELECT pid, fhash AS id FROM f UNION ALL SELECT pid, dhash FROM d UNION ALL SELECT pid, mhash FROM m UNION ALL SELECT pid, mhash FROM m WHERE mhash = 'm3')
SELECT pid, problem, id, count(*) AS n FROM (
  SELECT pid, 'name' AS problem, id FROM k WHERE id IN ('17', 'd5')
  UNION ALL SELECT pid, 'doubled', id FROM (SELECT pid, id FROM k GROUP BY pid, id HAVING count(*) > 1) q
  UNION ALL SELECT pid, 'no dir', fhash FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pid = f.pid AND d.dhash = f.dhash)
  UNION ALL SELECT pid, 'no mount', dhash FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pid = d.pid AND m.mhash = d.mhash)
  UNION ALL SELECT pid, 'size', fhash FROM f WHERE size IS NULL
  UNION ALL SELECT 9, 'level', 'disk') x GROUP BY pid, problem, id""")
def fs_record_check(spark, d):
    files, dirs, mounts = _fs_tables(spark, d)
    odd = spark.range(1).select(F.lit(9).cast("bigint").alias("pid"), F.lit("disk").alias("level"), *(F.lit(None).cast(t).alias(c) for c, t in (("fhash", "string"), ("dhash", "string"), ("mhash", "string"), ("size", "bigint"), ("fs", "string"))))
    rows = files.unionByName(dirs).unionByName(mounts).unionByName(mounts.filter("mhash = 'm3'")).unionByName(odd)
    names = files.select(F.col("fhash").alias("value")).union(dirs.select("dhash")).union(mounts.select("mhash")).filter("value not in ('17', 'd5')")
    return metadata.fs_record_problems(rows, names)


@query("lineage_check", sql("SELECT 'entity twice' AS problem, CAST(tid AS VARCHAR) AS id FROM e WHERE cat = 'POSIX' GROUP BY tid HAVING count(*) > 1 UNION ALL SELECT 'type twice', name FROM e GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown ' || k, v FROM (SELECT 'subject' AS k, CAST(pid AS VARCHAR) AS v FROM e UNION ALL SELECT 'object', CAST(tid AS VARCHAR) FROM e) x WHERE v NOT IN (SELECT CAST(tid AS VARCHAR) FROM e WHERE cat = 'POSIX')"))
def lineage_check(spark, d):
    t = trace(spark, d)
    edges = t.select(F.col("pid").cast("string").alias("subject"), F.lit("used").alias("relation"), F.col("tid").cast("string").alias("object"))
    return metadata.lineage_problems(t.filter("cat = 'POSIX'").select(F.col("tid").cast("string").alias("id")), edges, t.select(F.col("name").alias("type")))


@query("capped_lines", """
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
cut AS (SELECT r, max(n) AS n FROM d, range(1024, 4097) x(n) WHERE strlen(text) > 4096 AND strlen(left(text, n)) <= 4096 GROUP BY r)
SELECT doc_id AS file, strlen(text) > 4096 AS over_cap, CASE WHEN text IS NOT NULL THEN md5(CASE WHEN n IS NULL THEN text ELSE left(text, n) END) END AS value FROM d LEFT JOIN cut USING (r)""")
def capped_lines(spark, d):
    return traces.capped(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value")), 4096).select("file", "over_cap", F.md5(F.col("value").cast("binary")).alias("value"))


@query("viewer_arrays", sql("""
SELECT pid, chunk, md5('[' || string_agg(line, ',' ORDER BY ts, id) || ']') AS value FROM (
  SELECT pid, ts, id, line, CAST((sum(size) OVER (PARTITION BY pid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) - size) // 20000 AS BIGINT) AS chunk FROM (SELECT *, strlen(line) + 1 AS size FROM j) a) b GROUP BY pid, chunk""",
  f"""j AS (SELECT pid, ts, id, {_head().replace('"ph":1', '"ph":"X"')} || '}}' AS line FROM e)"""))
def viewer_arrays(spark, d):
    return utilities.viewer_arrays(trace(spark, d), 20_000).select("pid", "chunk", F.md5(F.col("value").cast("binary")).alias("value"))


_RUNS = "SELECT pid, cat AS mode, name AS phase, CAST(type AS VARCHAR) AS layer, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total_ns FROM e GROUP BY ALL"


@query("phase_profile", sql(f"SELECT pid, mode, phase, layer, count, total_ns, CAST(total_ns AS DOUBLE) / count AS avg_ns, CAST(total_ns AS DOUBLE) / 1000 AS ns_per_event, CASE phase WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS place FROM r", f"r AS ({_RUNS})"))
def phase_profile(spark, d):
    t = trace(spark, d).select("pid", F.col("cat").alias("mode"), F.col("name").alias("phase"), F.col("type").cast("string").alias("layer"), F.lit(1).alias("count"), F.col("dur").alias("total_ns"), F.lit(1000).alias("events"))
    rows = stats.phase_profile(t).withColumn("place", stats.phase_rank(F.col("phase"), ("error", "click")))
    return rows.orderBy("place", "phase", "layer")


@query("partitioned_quantile", sql("SELECT name, quantile_cont(x, 0.9) AS quantile FROM (SELECT name, pid, quantile_cont(dur, 0.9) AS x FROM e GROUP BY name, pid) p GROUP BY name"))
def partitioned_quantile(spark, d):
    return stats.partitioned_quantile(trace(spark, d), ["name"], "pid", "dur", 0.9)


@query("approximate_distinct", sql("SELECT name, count(DISTINCT tid) AS exact, true AS near FROM e GROUP BY name"))
def approximate_distinct(spark, d):
    t = trace(spark, d)
    about, exact = stats.approximate_distinct(t, ["name"], "tid"), t.groupBy("name").agg(F.countDistinct("tid").alias("exact"))
    return about.join(exact, "name").select("name", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("near"))


@query("added_time", sql("SELECT pid, name AS mode, median, median - base AS added, median / base AS ratio FROM (SELECT pid, name, median(dur) AS median FROM e GROUP BY ALL) x LEFT JOIN (SELECT pid, median(dur) AS base FROM e WHERE name = 'click' GROUP BY pid) b USING (pid)"))
def added_time(spark, d):
    return stats.added_time(trace(spark, d), ["pid"], "name", "click", "dur").withColumnRenamed("name", "mode")


@query("head_events", sql("SELECT id, ts FROM e ORDER BY ts, id LIMIT 25"))
def head_events(spark, d):
    return utilities.preview(trace(spark, d), 25).select("id", "ts")


@query("tail_events", sql("SELECT id, ts FROM e ORDER BY ts DESC, id DESC LIMIT 25"))
def tail_events(spark, d):
    return utilities.preview(trace(spark, d), 25, last=True).select("id", "ts")


@query("sample_events", sql("SELECT id FROM e WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 6) AS BIGINT) % 10 = 0"))
def sample_events(spark, d):
    return utilities.sampled(trace(spark, d), 10).select("id")


_MIXED = """x AS (SELECT cat, name, tid, id, ts, ts // {w} * {w} AS i, CASE id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' ELSE 'text' END AS kind, CASE id % 3 WHEN 0 THEN CAST(size AS DOUBLE) WHEN 1 THEN size + 0.5 END AS v FROM e WHERE size IS NOT NULL),
k AS (SELECT cat, name, tid, i, arg_min(kind, (ts, id)) AS first FROM x GROUP BY ALL)""".format(w=24 * HOUR)


def _mixed(spark, d, mixed):
    value = F.when(F.col("id") % 3 == 0, F.col("size").cast("string")).when(F.col("id") % 3 == 1, F.concat(F.col("size").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("s"), F.col("size").cast("string")))
    rows = trace(spark, d).filter("size is not null").withColumn("args", F.create_map(F.lit("size"), value))
    return aggregate.aggregate_typed_args(rows, 24 * HOUR, mixed=mixed, order=("ts", "id")).select("cat", "name", "tid", "interval", "key", "kind", "count", "sum", "min", "max")


@query("mixed_args_first", sql("SELECT x.cat, x.name, x.tid, x.i AS \"interval\", 'size' AS key, first AS kind, count(*) AS count, sum(v) AS sum, min(v) AS min, max(v) AS max FROM x JOIN k USING (cat, name, tid, i) WHERE kind = first GROUP BY ALL", _MIXED))
def mixed_args_first(spark, d):
    return _mixed(spark, d, "first")


@query("mixed_args_cast", sql("SELECT x.cat, x.name, x.tid, x.i AS \"interval\", 'size' AS key, first AS kind, count(*) AS count, sum(CASE WHEN first = 'integer' THEN trunc(v) ELSE v END) AS sum, min(CASE WHEN first = 'integer' THEN trunc(v) ELSE v END) AS min, max(CASE WHEN first = 'integer' THEN trunc(v) ELSE v END) AS max FROM x JOIN k USING (cat, name, tid, i) WHERE kind = first OR (kind <> 'text' AND first <> 'text') GROUP BY ALL", _MIXED))
def mixed_args_cast(spark, d):
    return _mixed(spark, d, "cast")
