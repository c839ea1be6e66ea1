"""Selection, aggregation and windows over the events table as a trace."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators import aggregate, rules
from tracelathe.queries.tables import sql, table, trace
from tracelathe.schema import layer_name, phase_letter

QUERIES, ORACLES = {}, {}
HOUR = 3_600_000_000


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


def fields():
    return {n: (F.col(n), k) for n, k in {"name": "text", "cat": "text", "ts": "integer", "dur": "integer"}.items()} | {"tags.size": (F.col("size"), "integer")}


def _selected(name: str, text: str, where: str, mode: str = "compat") -> None:
    """A query that keeps the ids for which a rule holds."""
    query(name, sql(f"SELECT id FROM e WHERE {where}"))(lambda spark, d: trace(spark, d).filter(rules.rule(text, fields(), mode, guard=False)).select("id"))


_selected("rule_filter_eq", "cat == 'POSIX'", "cat = 'POSIX'")
_selected("rule_filter_ne", "name != 'click'", "name <> 'click'")
_selected("rule_filter_in", "name IN {'click','view'}", "name IN ('click', 'view')")
_selected("rule_filter_like", "name LIKE '*ie*'", "name LIKE '%ie%'")
_selected("rule_like_prefix", "name LIKE 'p*'", "name LIKE 'p%'")
_selected("rule_and_or_precedence", "name == 'click' OR name == 'view' AND dur < 300000000", "(name = 'click' OR name = 'view') AND dur < 300000000")
_selected("rule_sql_precedence", "name == 'click' OR name == 'view' AND dur < 300000000", "name = 'click' OR (name = 'view' AND dur < 300000000)", "sql")
_selected("rule_not_remainder", "NOT cat == 'POSIX' AND dur < 300000000", "NOT (cat = 'POSIX' AND dur < 300000000)")
_selected("rule_type_mismatch", "dur > 1.5 OR cat == 'POSIX'", "cat = 'POSIX'")
_selected("rule_text_number", "name != 5 OR name == 'click'", "name = 'click'")
_selected("rule_tag_text", "tags.size == '7' OR name == 'view'", "name = 'view'")
_selected("rule_tag_like", "tags.size LIKE '1*'", "CAST(size AS VARCHAR) LIKE '1%'")
_selected("rule_missing_tag", "tags.other == '' AND name == 'click'", "name = 'click'")
_selected("rule_unparsed", "just words", "true")


@query("rule_incl_excl", sql("SELECT id FROM e WHERE (cat = 'POSIX' OR name LIKE 'p%') AND NOT dur < 100000000"))
def rule_incl_excl(spark, d):
    return trace(spark, d).filter(rules.should_aggregate(["cat == 'POSIX'", "name LIKE 'p*'"], ["dur < 100000000"], fields(), guard=False)).select("id")


@query("rule_excl_only", sql("SELECT id, false AS folded, dur < 100000000 AS excluded FROM e"))
def rule_excl_only(spark, d):
    return trace(spark, d).select("id", rules.should_aggregate([], ["dur < 100000000"], fields()).alias("folded"), rules.rule("dur < 100000000", fields()).alias("excluded"))


@query("min_duration", sql("SELECT id, dur FROM e WHERE dur >= 400000000 OR type = 1"))
def min_duration(spark, d):
    return aggregate.min_duration(trace(spark, d), 400_000_000_000).select("id", "dur")


@query("layer_gate", sql("SELECT id FROM (SELECT id, [1, 3, 7, 6, 12, 128, 130, 2][id % 8 + 1] AS kind FROM e) x WHERE kind NOT IN (1, 7, 11, 12, 13) AND (kind < 128 OR kind = 130)"))
def layer_gate(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in (1, 3, 7, 6, 12, 128, 130, 2))), (F.col("id") % 8 + 1).cast("int"))
    return trace(spark, d).filter(aggregate.aggregatable(F.col("cat"), kind, (130,))).select("id")


_FOLD = "count(*) AS dft_cnt, CAST(sum(dur) AS BIGINT) AS dur_sum, min(dur) AS dur_min, max(dur) AS dur_max"
_BUCKET = f"SELECT cat, name, type, tid, ts // {HOUR} * {HOUR} AS \"interval\", {_FOLD} FROM e"


@query("interval_agg", sql(f"{_BUCKET} GROUP BY ALL"))
def interval_agg(spark, d):
    return aggregate.interval_aggregate(trace(spark, d), HOUR)


@query("interval_agg_keys", sql(f"SELECT cat, name, type, tid, size, ts // {HOUR} * {HOUR} AS \"interval\", {_FOLD} FROM e GROUP BY ALL"))
def interval_agg_keys(spark, d):
    return aggregate.interval_aggregate(trace(spark, d), HOUR, ["size"])


@query("interval_agg_values", sql(f"SELECT cat, name, type, tid, ts // {24 * HOUR} * {24 * HOUR} AS \"interval\", {_FOLD}, CAST(sum(size) AS BIGINT) AS size_sum, min(size) AS size_min, max(size) AS size_max FROM e GROUP BY ALL"))
def interval_agg_values(spark, d):
    return aggregate.interval_aggregate(trace(spark, d), 24 * HOUR, values=["size"])


@query("interval_agg_long", sql(f"SELECT cat, name, tid, ts // {24 * HOUR} * {24 * HOUR} AS \"interval\", count(*) AS dft_cnt, CAST(sum(dur) AS DOUBLE) AS dur_sum, CAST(sum(size) AS DOUBLE) AS size_sum, count(size) AS size_count FROM e GROUP BY ALL"))
def interval_agg_long(spark, d):
    rows = trace(spark, d).withColumn("args", F.map_filter(F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("note"), F.lit("x")), lambda k, v: v.isNotNull()))
    from tracelathe.schema import ArgRoles

    found = aggregate.aggregate_open_args(rows.withColumn("args", F.map_filter("args", lambda k, v: k != "note")), 24 * HOUR, ArgRoles())
    at = lambda k, f: F.try_element_at("values", F.lit(k))[f]
    return found.select("cat", "name", "tid", "interval", "dft_cnt", at("dur", "sum").alias("dur_sum"), at("size", "sum").alias("size_sum"), F.coalesce(at("size", "count"), F.lit(0)).alias("size_count"))


@query("output_shaping", sql(f"SELECT cat, name, tid, \"interval\", dft_cnt, CASE WHEN dft_cnt = 1 THEN dur_sum ELSE -1 END AS dur, CASE WHEN dft_cnt > 1 THEN dur_sum ELSE -1 END AS dur_sum, CASE WHEN dft_cnt > 1 THEN dur_min ELSE -1 END AS dur_min, CASE WHEN dft_cnt > 1 THEN dur_max ELSE -1 END AS dur_max FROM ({_BUCKET} GROUP BY ALL)"))
def output_shaping(spark, d):
    return aggregate.shaped(aggregate.interval_aggregate(trace(spark, d), HOUR)).drop("type").fillna(-1)


@query("selective_route", sql(f"SELECT cat, name, tid, ts // {HOUR} * {HOUR} AS ts, CAST(3 AS SMALLINT) AS ph, count(*) AS dft_cnt, CAST(sum(dur) AS BIGINT) AS dur FROM e WHERE dur < 200000000 GROUP BY 1, 2, 3, 4 UNION ALL SELECT cat, name, tid, ts, ph, 1, dur FROM e WHERE NOT dur < 200000000"))
def selective_route(spark, d):
    return aggregate.selective_route(trace(spark, d), F.col("dur") < 200_000_000, HOUR).select("cat", "name", "tid", "ts", "ph", "dft_cnt", F.coalesce("dur", "dur_sum").alias("dur"))


@query("reaggregate", sql(f"{_BUCKET} GROUP BY ALL"))
def reaggregate(spark, d):
    parts = [aggregate.interval_aggregate(trace(spark, d).filter(F.col("id") % 3 == k), HOUR) for k in range(3)]
    return aggregate.reaggregate(parts[0].union(parts[1]).union(parts[2]))


@query("calls_folded", sql("SELECT name, count(*) AS calls FROM e GROUP BY name"))
def calls_folded(spark, d):
    rows = aggregate.selective_route(trace(spark, d), F.col("dur") < 200_000_000, HOUR)
    return rows.groupBy("name").agg(F.sum(aggregate.calls(F.col("ph"), F.col("dft_cnt"))).alias("calls"))


def _counts(name: str, *keys: str) -> None:
    query(name, sql(f"SELECT {', '.join(keys)}, count(*) AS n FROM e GROUP BY ALL"))(lambda spark, d: trace(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


_counts("count_by_name", "name")
_counts("count_by_cat", "cat")
_counts("count_by_pid_tid", "pid", "tid")


@query("ts_min_max", sql("SELECT min(ts) AS first, max(te) AS last FROM e"))
def ts_min_max(spark, d):
    return trace(spark, d).agg(F.min("ts").alias("first"), F.max("te").alias("last"))


@query("top_k_dur", sql("SELECT id, dur FROM e ORDER BY dur DESC, id LIMIT 100"))
def top_k_dur(spark, d):
    return trace(spark, d).orderBy(F.desc("dur"), "id").limit(100).select("id", "dur")


@query("field_projection", sql("SELECT id, name, size, CASE type WHEN 3 THEN 'POSIX' ELSE 'PYTHON' END AS layer, 'X' AS ph FROM e WHERE ph = 1 AND type = 3"))
def field_projection(spark, d):
    return trace(spark, d).filter("ph = 1 and type = 3").select("id", "name", "size", layer_name(F.col("type")).alias("layer"), phase_letter(F.col("ph")).alias("ph"))


@query("name_pattern", sql("SELECT name, count(*) AS calls FROM e WHERE regexp_full_match(name, 'v.*|c[a-z]+') GROUP BY name"))
def name_pattern(spark, d):
    from tracelathe.operators.validate import counts_by_pattern

    return counts_by_pattern(trace(spark, d).withColumn("dft_cnt", F.lit(1)), "v.*|c[a-z]+")


_SERIES = "WITH e2 AS (SELECT event_id AS id, user_id, epoch_us(ts) AS ts, CAST(round(value * 1e7) AS BIGINT) AS dur FROM events), w AS (SELECT *, lag(dur) OVER (PARTITION BY user_id ORDER BY ts, id) AS b FROM e2)"


def _delta(name: str, first: str, body: str) -> None:
    from tracelathe.operators.stats import counter_delta

    query(name, f"{_SERIES} {body}")(lambda spark, d: counter_delta(trace(spark, d), ["tid"], "dur", first, ("ts", "id")).select("id", "tid", "dur_delta"))


_delta("counter_delta_disk", "omit", "SELECT id, user_id AS tid, dur - b AS dur_delta FROM w WHERE b IS NOT NULL")
_delta("counter_delta_net", "cumulative", "SELECT id, user_id AS tid, coalesce(dur - b, dur) AS dur_delta FROM w")
_delta("counter_delta_papi", "zero_base", "SELECT id, user_id AS tid, dur - coalesce(b, 0) AS dur_delta FROM w")


@query("frozen_counters", sql("SELECT tid, name, count(v) AS samples FROM (SELECT *, CASE WHEN tid % 3 = 0 THEN 7 ELSE size END AS v FROM e) x GROUP BY tid, name HAVING count(v) > 1 AND min(v) = max(v)"))
def frozen_counters(spark, d):
    from tracelathe.operators.stats import frozen

    return frozen(trace(spark, d).withColumn("v", F.when(F.col("tid") % 3 == 0, 7).otherwise(F.col("size"))), ["tid", "name"], "v")


@query("series_presence", sql("SELECT tid, count(size) AS samples, count(DISTINCT size) AS distinct_values FROM e GROUP BY tid HAVING count(size) < 60 OR (count(size) > 1 AND count(DISTINCT size) = 1)"))
def series_presence(spark, d):
    from tracelathe.operators.validate import series_presence as check

    return check(trace(spark, d), ["tid"], "size", 60)


@query("cpu_pct", sql("SELECT pid, name, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY pid) AS pct FROM e GROUP BY pid, name"))
def cpu_pct(spark, d):
    from tracelathe.functions.scalars import percent_of

    counts = trace(spark, d).groupBy("pid", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("pid", "name", percent_of(F.col("n"), F.sum("n").over(Window.partitionBy("pid"))).alias("pct"))


@query("tumbling", sql(f"SELECT make_timestamp(ts // {HOUR} * {HOUR}) AS start, cat, name, {_FOLD} FROM e GROUP BY ALL"))
def tumbling(spark, d):
    from tracelathe.streaming.tumbling import tumbling as windows

    return windows(trace(spark, d).withColumn("at", F.timestamp_micros("ts")), "1 hour").select(F.col("window.start").alias("start"), "cat", "name", "dft_cnt", "dur_sum", "dur_min", "dur_max")


@query("sliding", sql(f"SELECT make_timestamp((ts // {HOUR} - k) * {HOUR}) AS start, count(*) AS n FROM e, range(0, 3) r(k) GROUP BY ALL"))
def sliding(spark, d):
    from tracelathe.streaming.tumbling import sliding as windows

    return windows(trace(spark, d).withColumn("at", F.timestamp_micros("ts")), "3 hours", "1 hour").select(F.col("window.start").alias("start"), "n")


@query("session", sql(f"SELECT tid, make_timestamp(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY ts, id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tid ORDER BY ts, id) < {24 * HOUR} THEN 0 ELSE 1 END AS new FROM e)) GROUP BY tid, s"))
def session(spark, d):
    from tracelathe.streaming.tumbling import sessions

    return sessions(trace(spark, d).withColumn("at", F.timestamp_micros("ts")), "24 hours", ("tid",)).select("tid", F.col("session_window.start").alias("start"), "n")


@query("stream_tumbling", sql(f"SELECT ts // {24 * HOUR} * {24 * HOUR} AS \"interval\", cat, name, {_FOLD} FROM e GROUP BY ALL"))
def stream_tumbling(spark, d):
    """The events as a stream of three files whose times overlap, folded batch by batch into the checkpoint folder, and merged: most rows of
    the later files are late, and become second rows of their intervals."""
    from tracelathe.operators.written import new_path
    from tracelathe.streaming.tumbling import fold_batches, reaggregated

    path = new_path(spark, "stream")
    io = F.col("event_type").isin("click", "view", "error")
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.when(io, "POSIX").otherwise("COMPUTE").alias("cat"), F.col("event_type").alias("name"), F.round(F.col("value") * 1e7).cast("bigint").alias("dur"), (F.col("event_id") % 3).alias("part"))
    events.repartition("part").write.partitionBy("part").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.drop("part").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    fold_batches(stream, 24 * HOUR, f"{path}/rows", f"{path}/state").awaitTermination()
    return reaggregated(spark.read.parquet(f"{path}/rows"))


@query("stream_end_marks", sql("SELECT pid, name, count(*) AS dft_cnt, CAST(sum(dur) AS BIGINT) AS dur_sum, min(dur) AS dur_min, max(dur) AS dur_max FROM e WHERE pid < 6 GROUP BY pid, name"))
def stream_end_marks(spark, d):
    """Processes 0 to 5 end in the last file but one of a stream; the others haven't ended, so nothing of them is given out."""
    from tracelathe.operators.written import new_path
    from tracelathe.streaming.lanes import FOLDED, fold_lanes, use_rocksdb

    use_rocksdb(spark)
    path = new_path(spark, "stream")
    events = trace(spark, d).select("pid", "tid", "name", "dur", F.timestamp_micros("ts").alias("at"), (F.col("id") % 2).alias("part"))
    last = events.agg(F.max("at").alias("at"))
    none = F.lit(0).cast("bigint")
    mark = lambda first, past, name, after: last.select("at", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(past).cast("bigint"))).alias("pid")).select("pid", none.alias("tid"), F.lit(name).alias("name"), none.alias("dur"), (F.col("at") + F.expr(f"interval {after}")).alias("at"))
    ends, later = mark(0, 5, "end", "0 days"), mark(-1, -1, "later", "40 days")
    for part, rows in enumerate((events.filter("part = 0").drop("part"), events.filter("part = 1").drop("part"), ends, later)):
        rows.repartition(1).write.parquet(f"{path}/in/{part}")
    stream = spark.readStream.schema(events.drop("part").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    fold_lanes(stream, 1000, "35 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(FOLDED).parquet(f"{path}/rows")
    return rows.groupBy("pid", "name").agg(F.sum("dft_cnt").alias("dft_cnt"), F.sum("dur_sum").alias("dur_sum"), F.min("dur_min").alias("dur_min"), F.max("dur_max").alias("dur_max"))


@query("cube_layers", sql("SELECT cat, name, count(*) AS n FROM e GROUP BY CUBE (cat, name)"))
def cube_layers(spark, d):
    return trace(spark, d).cube("cat", "name").agg(F.count(F.lit(1)).alias("n"))


@query("rollup_time", sql(f"SELECT ts // {24 * HOUR} AS day, name, count(*) AS n FROM e GROUP BY ROLLUP (day, name)"))
def rollup_time(spark, d):
    return trace(spark, d).withColumn("day", F.floor(F.col("ts") / (24 * HOUR))).rollup("day", "name").agg(F.count(F.lit(1)).alias("n"))


@query("ranking", sql("SELECT id, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER (PARTITION BY tid ORDER BY ts, id) AS INTEGER) AS q, lead(id) OVER (PARTITION BY tid ORDER BY ts, id) AS next_id FROM e WINDOW w AS (PARTITION BY tid ORDER BY size)"))
def ranking(spark, d):
    w, order = Window.partitionBy("tid").orderBy("size"), Window.partitionBy("tid").orderBy("ts", "id")
    rows = trace(spark, d)
    return rows.select("id", F.rank().over(w.orderBy(F.asc_nulls_last("size"))).alias("r"), F.dense_rank().over(w.orderBy(F.asc_nulls_last("size"))).alias("dr"), F.ntile(4).over(order).alias("q"), F.lead("id").over(order).alias("next_id"))
