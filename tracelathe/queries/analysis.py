"""Interval algebra, joins and statistics over the events table as a trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelathe.operators import intervals, joins, stats, validate
from tracelathe.plans.analysis import Analyzer, duration_of, with_analysis_columns
from tracelathe.plans.analysis import slice_sql as viewer_sql
from tracelathe.queries.events import HOUR
from tracelathe.queries.tables import sql, table, trace

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


_ISLANDS = "m AS (SELECT *, max(te) OVER (PARTITION BY pid ORDER BY ts, te ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts > b THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ts, te ROWS UNBOUNDED PRECEDING) AS i FROM m)"


@query("interval_union", sql("SELECT pid, min(ts) AS s, max(te) AS e FROM g GROUP BY pid, i", _ISLANDS))
def interval_union(spark, d):
    return intervals.interval_union(trace(spark, d), ["pid"])


_SWEEP = """
marks AS (SELECT pid, ts AS moment, 1 AS step, cat FROM e UNION ALL SELECT pid, te, -1, cat FROM e),
steps AS (SELECT pid, moment, sum(step) FILTER (cat = 'POSIX') AS i, sum(step) FILTER (cat = 'COMPUTE') AS c FROM marks GROUP BY pid, moment),
opened AS (SELECT pid, sum(i) OVER w > 0 AS i, sum(c) OVER w > 0 AS c, lead(moment) OVER (PARTITION BY pid ORDER BY moment) - moment AS width FROM steps WINDOW w AS (PARTITION BY pid ORDER BY moment ROWS UNBOUNDED PRECEDING))
"""
_TOTALS = ", ".join(f"CAST(coalesce(sum(width) FILTER ({w}), 0) AS BIGINT) AS {n}" for n, w in {"io_time": "coalesce(i, false)", "compute_time": "coalesce(c, false)", "both_time": "coalesce(i, false) AND coalesce(c, false)", "only_io": "coalesce(i, false) AND NOT coalesce(c, false)", "only_compute": "coalesce(c, false) AND NOT coalesce(i, false)"}.items())


@query("overlap_times", sql(f"SELECT pid, {_TOTALS} FROM opened GROUP BY pid", _SWEEP))
def overlap_times(spark, d):
    return intervals.overlap_times(trace(spark, d), ["pid"], F.col("cat") == "POSIX", F.col("cat") == "COMPUTE")


@query("overlap_degree", sql("SELECT id, count(*) AS degree FROM (SELECT unnest([a.id, b.id]) AS id FROM e a JOIN e b ON a.pid = b.pid AND a.id < b.id AND a.ts < b.te AND b.ts < a.te) GROUP BY id"))
def overlap_degree(spark, d):
    return intervals.overlap_degrees(trace(spark, d), ["pid"]).select("id", "degree")


@query("region_containment", sql("SELECT id, region FROM (SELECT x.id, r.id AS region, row_number() OVER (PARTITION BY x.id ORDER BY r.ts, r.id) AS n FROM e x JOIN e r ON x.pid = r.pid AND x.ts >= r.ts AND x.te <= r.te AND x.cat = 'POSIX' AND r.cat = 'COMPUTE') WHERE n = 1"))
def region_containment(spark, d):
    t = trace(spark, d)
    regions = t.filter("cat = 'COMPUTE'").select("pid", F.col("id").alias("region"), F.col("ts").alias("rs"), F.col("te").alias("re"))
    return intervals.contained_in(t.filter("cat = 'POSIX'"), regions, ["pid"]).select("id", "region")


@query("int_ranges", sql("SELECT name, min(tid) AS low, max(tid) AS high, count(*) AS n FROM (SELECT name, tid, tid - row_number() OVER (PARTITION BY name ORDER BY tid) AS i FROM (SELECT DISTINCT name, tid FROM e)) GROUP BY name, i"))
def int_ranges(spark, d):
    return intervals.int_ranges(trace(spark, d), ["name"], "tid")


@query("duration_by_pid_max", sql("SELECT max(s) / 1e6 AS seconds FROM (SELECT pid, CAST(sum(dur) AS BIGINT) AS s FROM e WHERE name = 'view' GROUP BY pid)"))
def duration_by_pid_max(spark, d):
    return duration_of(trace(spark, d), "view")


@query("op_summary", sql("SELECT name, CAST(sum(dur) AS BIGINT) AS dur_sum, count(dur) AS dur_count, CAST(sum(size) AS BIGINT) AS size_sum, avg(size) AS size_mean, median(size) AS size_median, min(size) AS size_min, max(size) AS size_max, quantile_cont(size, 0.25) AS size_p25, quantile_cont(size, 0.75) AS size_p75 FROM e WHERE cat = 'POSIX' GROUP BY name"))
def op_summary(spark, d):
    return Analyzer(trace(spark, d)).summary()


@query("transfer_table", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS size_sum, avg(l_quantity) AS size_mean, median(l_quantity) AS size_median, min(l_quantity) AS size_min, max(l_quantity) AS size_max FROM lineitem GROUP BY ALL")
def transfer_table(spark, d):
    return stats.transfer_table(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("time_range_view", sql(f"SELECT CAST(floor(te / 2 / {HOUR}) AS BIGINT) AS trange, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time, CAST(coalesce(sum(size), 0) AS BIGINT) AS data_size FROM e GROUP BY ALL"))
def time_range_view(spark, d):
    return Analyzer(trace(spark, d), HOUR).flat_view("trange")


@query("size_bins", sql("SELECT pid, CAST(coalesce(sum(size), 0) AS BIGINT) AS data_size_sum, count(size) AS data_count_sum, max(dur) AS time_max, count(*) FILTER (size >= 0 AND size < 4096) AS bin_0_4kb, count(*) FILTER (size >= 4096 AND size < 65536) AS bin_4_64kb, count(*) FILTER (size >= 65536 AND size < 1048576) AS bin_64kb_1mb, count(*) FILTER (size >= 1048576) AS bin_1mb_, coalesce(sum(size) * 1.0 / nullif(count(size), 0), 0) AS avg_xfer FROM e WHERE cat = 'POSIX' GROUP BY pid"))
def size_bins(spark, d):
    return Analyzer(trace(spark, d)).layer_view("POSIX", "pid")


@query("distinct_entities", sql("SELECT count(DISTINCT pid) AS processes, count(DISTINCT tid) AS threads, count(DISTINCT name) AS operations, count(*) AS events, min(ts) AS first, max(te) AS last, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM e"))
def distinct_entities(spark, d):
    return Analyzer(trace(spark, d)).totals()


@query("phase_classes", sql("SELECT id, CASE WHEN cat LIKE '%POSIX%' THEN 2 WHEN name LIKE '%compute%' THEN 1 ELSE 0 END AS phase FROM e"))
def phase_classes(spark, d):
    return with_analysis_columns(trace(spark, d), HOUR).select("id", "phase")


@query("used_layers", sql("SELECT pid, list_aggregate(list_sort(list(DISTINCT cat)), 'string_agg', ',') AS used FROM e GROUP BY pid"))
def used_layers(spark, d):
    return trace(spark, d).groupBy("pid").agg(F.array_join(F.sort_array(F.collect_set("cat")), ",").alias("used"))


@query("asof_last_sample", sql("SELECT x.id, (SELECT s.size FROM e s WHERE s.pid = x.pid AND s.cat = 'COMPUTE' AND s.size IS NOT NULL AND s.ts <= x.ts ORDER BY s.ts DESC, s.id DESC LIMIT 1) AS sample FROM e x WHERE x.cat = 'POSIX'"))
def asof_last_sample(spark, d):
    t = trace(spark, d)
    order = F.struct("ts", "id")
    samples = t.filter("cat = 'COMPUTE' and size is not null").groupBy("pid", "ts").agg(F.max_by("size", order).alias("sample"))
    return joins.asof_last(t.filter("cat = 'POSIX'"), samples, ["pid"], "sample").select("id", "sample")


@query("dict_join", sql("SELECT id, name AS resolved FROM e"))
def dict_join(spark, d):
    t = trace(spark, d)
    hashed = t.select("id", joins.hash16(F.col("name")).alias("nhash"))
    return joins.dictionary_join(hashed, joins.dictionary(t, "name"), "nhash", "resolved").select("id", "resolved")


@query("rank_join", sql("SELECT e.id, c.c_nationkey AS rank FROM e LEFT JOIN customer c ON e.tid = c.c_custkey"))
def rank_join(spark, d):
    ranks = table(spark, d, "customer").select(F.col("c_custkey").alias("tid"), F.col("c_nationkey").alias("rank"))
    return trace(spark, d).join(ranks, "tid", "left").select("id", "rank")


@query("dangling_anti", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def dangling_anti(spark, d):
    return joins.dangling(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_nationkey < 12"), "c_custkey").select("o_orderkey")


@query("fs_hierarchy", "SELECT c_custkey AS file, n_name AS dir, r_name AS mount FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fs_hierarchy(spark, d):
    files = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return files.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("c_custkey").alias("file"), F.col("n_name").alias("dir"), F.col("r_name").alias("mount"))


@query("fs_integrity", "SELECT 'file' AS kind, CAST(0 AS BIGINT) AS pid, CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS link FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) UNION ALL SELECT 'dir', 0, CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey < 20 AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 4)")
def fs_integrity(spark, d):
    pid = F.lit(0).cast("bigint").alias("pid")
    text = lambda c, n: F.col(c).cast("string").alias(n)
    files = table(spark, d, "customer").select(pid, text("c_custkey", "fhash"), text("c_nationkey", "dhash"))
    dirs = table(spark, d, "nation").filter("n_nationkey < 20").select(pid, text("n_nationkey", "dhash"), text("n_regionkey", "mhash"))
    mounts = table(spark, d, "region").filter("r_regionkey < 4").select(pid, text("r_regionkey", "mhash"))
    return validate.fs_problems(files, dirs, mounts)


@query("correlation_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def correlation_join(spark, d):
    calls = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").join(calls, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("pair_enter_leave", "WITH m AS (SELECT event_id AS seq, user_id AS location, epoch_us(ts) AS time, CASE WHEN event_type IN ('click', 'view') THEN 'enter' ELSE 'leave' END AS kind FROM events), w AS (SELECT *, lead(kind) OVER o AS k, lead(time) OVER o AS t FROM m WINDOW o AS (PARTITION BY location ORDER BY time, seq)) SELECT location, time AS ts, CASE WHEN k = 'leave' THEN t - time ELSE 0 END AS dur FROM w WHERE kind = 'enter'")
def pair_enter_leave(spark, d):
    from tracelathe.sources.adapters import pair_enter_leave as pair

    kind = F.when(F.col("name").isin("click", "view"), "enter").otherwise("leave")
    marks = trace(spark, d).select(F.col("id").alias("seq"), F.col("tid").alias("location"), F.lit("r").alias("region"), F.col("ts").alias("time"), kind.alias("kind"))
    return pair(marks).select("location", "ts", "dur")


@query("multiset_diff", sql("SELECT coalesce(l.name, r.name) AS name, coalesce(l.size, r.size) AS size, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT name, size, count(*) AS n_left FROM e WHERE pid < 4 GROUP BY ALL) l FULL JOIN (SELECT name, size, count(*) AS n_right FROM e WHERE pid >= 4 GROUP BY ALL) r ON l.name IS NOT DISTINCT FROM r.name AND l.size IS NOT DISTINCT FROM r.size WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)"))
def multiset_diff(spark, d):
    t = trace(spark, d)
    return joins.multiset_difference(t.filter("pid < 4"), t.filter("pid >= 4"), ["name", "size"])


@query("set_missing", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_missing(spark, d):
    return validate.missing_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("set_intersect", sql("SELECT tid FROM e WHERE name = 'click' INTERSECT SELECT tid FROM e WHERE name = 'error'"))
def set_intersect(spark, d):
    t = trace(spark, d)
    return t.filter("name = 'click'").select("tid").intersect(t.filter("name = 'error'").select("tid"))


@query("multiset_except", sql("SELECT name, size FROM e WHERE pid < 4 EXCEPT ALL SELECT name, size FROM e WHERE pid >= 4"))
def multiset_except(spark, d):
    t = trace(spark, d).select("name", "size", "pid")
    return t.filter("pid < 4").drop("pid").exceptAll(t.filter("pid >= 4").drop("pid"))


@query("finalized_processes", sql("SELECT id FROM e WHERE tid IN (SELECT tid FROM e GROUP BY tid HAVING count(*) >= 60)"))
def finalized_processes(spark, d):
    t = trace(spark, d).drop("pid").withColumnRenamed("tid", "pid").withColumn("num_events", F.lit(None).cast("bigint"))
    ends = t.groupBy("pid").agg(F.count(F.lit(1)).alias("num_events")).withColumn("name", F.lit("end"))
    return validate.finalized(t.unionByName(ends, allowMissingColumns=True), 60).filter("id is not null").select("id")


@query("iqr_mean", sql("SELECT name, avg(dur) AS mean, stddev_samp(dur) AS sd, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dur, id) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM e) WHERE i >= (c - 1) // 4 AND i <= 3 * (c - 1) // 4 GROUP BY name"))
def iqr_mean(spark, d):
    return stats.trimmed_mean(trace(spark, d), ["name"], "dur")


@query("cv_median", sql("SELECT name, stddev_pop(dur) / median(dur) AS cv FROM e GROUP BY name"))
def cv_median(spark, d):
    return stats.variation(trace(spark, d), ["name"], "dur")


@query("weighted_avg", sql("SELECT name, CAST(sum(dur) AS DOUBLE) / sum(size) AS avg FROM e GROUP BY name"))
def weighted_avg(spark, d):
    return stats.weighted_average(trace(spark, d), ["name"], "dur", "size")


@query("rep_median", sql("SELECT name, pid, median(dur) AS median, min(dur) AS low, max(dur) AS high FROM e GROUP BY ALL"))
def rep_median(spark, d):
    return stats.repetitions(trace(spark, d), ["name", "pid"], "dur")


@query("per_event", sql("SELECT x.pid, x.name, CAST(x.total AS DOUBLE) / r.reps AS per_event FROM (SELECT pid, name, CAST(sum(dur) AS BIGINT) AS total FROM e GROUP BY ALL) x JOIN (SELECT pid, count(DISTINCT tid) AS reps FROM e GROUP BY pid) r ON x.pid = r.pid"))
def per_event(spark, d):
    return stats.per_event(trace(spark, d), ["pid", "name"], ["pid"], "dur", "tid")


@query("overhead_pct", sql("SELECT s.pid, s.name AS mode, s.mean, s.sd, b.base, (s.mean - b.base) / b.base * 100 AS overhead_percent FROM (SELECT pid, name, avg(dur) AS mean, stddev_samp(dur) AS sd FROM e GROUP BY ALL) s JOIN (SELECT pid, avg(dur) AS base FROM e WHERE name = 'view' GROUP BY pid) b ON s.pid = b.pid"))
def overhead_pct(spark, d):
    return joins.with_baseline(trace(spark, d).withColumnRenamed("name", "mode"), ["pid"], "dur", F.col("mode") == "view")


@query("lineage_edges", sql("SELECT CAST(id AS VARCHAR) AS subject, 'used' AS relation, CAST(unnest([tid, pid]) AS VARCHAR) AS object FROM e"))
def lineage_edges(spark, d):
    text = lambda c: F.col(c).cast("string")
    records = trace(spark, d).select(text("id").alias("id"), F.create_map(F.lit("used"), F.array(text("tid"), text("pid"))).alias("relations"))
    return joins.lineage_edges(records)


@query("last_write_wins", sql("SELECT tid, arg_max(name, (ts, id)) AS value FROM e GROUP BY tid"))
def last_write_wins(spark, d):
    return trace(spark, d).groupBy("tid").agg(F.max_by("name", F.struct("ts", "id")).alias("value"))


@query("slice_sql", sql("SELECT t.pid, count(*) AS n FROM e s JOIN (SELECT DISTINCT tid, pid FROM e) t ON s.tid = t.tid WHERE s.name LIKE '%ie%' GROUP BY t.pid"))
def slice_sql(spark, d):
    return viewer_sql(trace(spark, d), "SELECT t.pid, count(*) AS n FROM {slice} s JOIN {thread_track} k ON s.track_id = k.id JOIN {thread} t ON k.utid = t.utid WHERE s.name LIKE '%ie%' GROUP BY t.pid")
