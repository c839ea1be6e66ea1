"""Checks of traces as queries: each returns the rows that break a rule, or counts to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.operators.aggregate import calls
from tracelathe.operators.intervals import contained_in
from tracelathe.operators.written import written

def total_calls(rows: DataFrame) -> DataFrame:
    """Calls per operation, however they were recorded; equal for equivalent traces."""
    return rows.groupBy("cat", "name").agg(F.sum(calls(F.col("ph"), F.col("dft_cnt"))).alias("calls"))


def finalized(rows: DataFrame, least: int = 5, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Rows of processes that have ended with at least so many events; keys: what tells processes apart."""
    ends = rows.filter((F.col("name") == "end") & (F.col("num_events") >= least)).select(*keys).distinct()
    return rows.join(ends, list(keys), "left_semi")


def line_check(lines: DataFrame, by: str = "file") -> DataFrame:
    """Per file: lines that count as events (longer than 8), those that parse, and those that don't."""
    body = F.regexp_replace(F.trim("value"), ",$", "")
    event = (F.length(body) > 8) & ~body.isin("[", "]")
    good = event & F.expr("try_parse_json(regexp_replace(trim(value), ',$', ''))").isNotNull()
    return lines.groupBy(by).agg(F.count_if(event).alias("events"), F.count_if(good).alias("good"), F.count_if(event & ~good).alias("bad"))


def counts_by_pattern(rows: DataFrame, pattern: str) -> DataFrame:
    """Calls of operations whose whole name matches."""
    found = rows.filter(F.col("name").rlike(f"^({pattern})$"))
    return found.groupBy("name").agg(F.sum(calls(F.col("ph"), F.col("dft_cnt"))).alias("calls"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_keys(required: DataFrame, seen: DataFrame) -> DataFrame:
    return required.subtract(seen)


def fs_problems(files: DataFrame, dirs: DataFrame, mounts: DataFrame) -> DataFrame:
    """Files and directories whose links lead nowhere, by pid: kind, pid, id, link."""
    bad_files = files.alias("f").join(dirs.alias("d"), [F.col("f.pid") == F.col("d.pid"), F.col("f.dhash") == F.col("d.dhash")], "left_anti")
    bad_dirs = dirs.alias("d").join(mounts.alias("m"), [F.col("d.pid") == F.col("m.pid"), F.col("d.mhash") == F.col("m.mhash")], "left_anti")
    return bad_files.select(F.lit("file").alias("kind"), "pid", F.col("fhash").alias("id"), F.col("dhash").alias("link")).union(bad_dirs.select(F.lit("dir"), "pid", "dhash", "mhash"))


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def exact_args(rows: DataFrame) -> DataFrame:
    """The typed arguments of events (args is VARIANT), exactly: 64-bit integers of both kinds, doubles and flags."""
    get = lambda path, kind: F.try_variant_get("args", path, kind)
    return rows.select("name", get("$.i64", "bigint").alias("i64"), get("$.u64", "decimal(20,0)").alias("u64"), get("$.f64", "double").alias("f64"), get("$.flag", "int").alias("flag"))


def series_presence(rows: DataFrame, series: list[str], value: str, least: int) -> DataFrame:
    """Time series with too few samples or with one value only: series, samples, distinct_values."""
    found = rows.groupBy(*series).agg(F.count(value).alias("samples"), F.countDistinct(value).alias("distinct_values"))
    return found.filter((F.col("samples") < least) | (F.col("samples") > 1) & (F.col("distinct_values") == 1))


def compared_totals(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that either side has, with both totals (0 where a side lacks the key) and whether they are equal."""
    total = lambda rows, n: rows.groupBy(*keys).agg(F.sum(value).alias(n))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = total(left, "total_left").alias("l").join(total(right, "total_right").alias("r"), on, "full_outer")
    sides = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_left", "total_right")]
    found = both.select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), *sides)
    return found.withColumn("equal", F.col("total_left") == F.col("total_right"))


def line_counts(lines: DataFrame, expected: DataFrame, by: str = "file") -> DataFrame:
    """Expected counts (by, least, exact; either may be null) against the lines that count as events: by, events, problem (null: none); files without lines have 0."""
    counted = lines.groupBy(by).agg(F.count_if(F.length("value") > 8).alias("events"))
    met = expected.join(counted, by, "left").withColumn("events", F.coalesce("events", F.lit(0)))
    problem = F.when(F.col("exact").isNotNull() & (F.col("events") != F.col("exact")), "other count").when(F.col("least").isNotNull() & (F.col("events") < F.col("least")), "too few")
    return met.select(by, "events", problem.alias("problem"))


def args_differences(rows: DataFrame, expected: DataFrame, ignored: tuple[str, ...] = ("hhash",)) -> DataFrame:
    """(name, key, problem, n) where arguments aren't exactly as expected, by type too: rows: name, args (JSON); expected: name, args.

    Numbers keep their kind (1 isn't 1.0 or "1"), lists their order, records their fields. Keys are missing, other or unknown; names that are expected
    and never occur are missing too.
    """
    entries = lambda c: F.expr(f"explode_outer(map_entries(try_variant_get(try_parse_json({c}), '$', 'map<string, variant>')))")
    value = lambda v: F.concat(F.expr(f"schema_of_variant({v})"), F.lit(" "), F.to_json(F.col(v)))
    numbered = written(rows.select(F.monotonically_increasing_id().alias("row"), "name", "args"))
    wanted = expected.select("name", entries("args").alias("e")).select("name", F.col("e.key").alias("key"), value("e.value").alias("want")).filter("key is not null")
    got = numbered.select("row", "name", entries("args").alias("e")).select("row", "name", F.col("e.key").alias("key"), value("e.value").alias("got")).filter("key is not null").filter(~F.col("key").isin(*ignored))
    due = numbered.select("row", "name").join(wanted, "name")
    named = expected.select("name").distinct()
    met = due.join(got.join(named, "name", "left_semi"), ["row", "name", "key"], "full_outer")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("got"), "other")
    found = met.select("name", "key", problem.alias("problem")).filter("problem is not null").groupBy("name", "key", "problem").agg(F.count(F.lit(1)).alias("n"))
    absent = named.join(numbered.select("name").distinct(), "name", "left_anti").select("name", F.lit(None).cast("string").alias("key"), F.lit("missing").alias("problem"), F.lit(1).cast("bigint").alias("n"))
    return found.union(absent)


def routing_problems(rows: DataFrame, full: str, folded: str, record: str, times: int, kind: int, by: str = "file") -> DataFrame:
    """(by, problem): files where `full` isn't written `times` times as a complete event of one layer, `folded` isn't only folded, or `record` isn't one metadata record."""
    is_full, is_folded, is_record = (F.col("name") == x for x in (full, folded, record))
    found = rows.groupBy(by).agg(
        (F.count_if(is_full) != times).alias("full"), (F.count_if(is_full & ((F.col("ph") != 1) | (F.col("type") != kind))) > 0).alias("layer"),
        (F.count_if(is_folded & (F.col("ph") == 1)) > 0).alias("complete"), (F.count_if(is_folded & (F.col("ph") == 3)) == 0).alias("folded"),
        ((F.count_if(is_record) != 1) | (F.count_if(is_record & (F.col("ph") == 4)) != 1)).alias("record"),
    )
    names = {"full": "other number of full events", "layer": "full event of another phase or layer", "complete": "folded operation written in full", "folded": "operation not folded", "record": "record not written once"}
    return found.select(by, F.explode(F.filter(F.array(*(F.when(F.col(c), F.lit(text)) for c, text in names.items())), lambda x: x.isNotNull())).alias("problem"))


def stress_problems(events: DataFrame, names: DataFrame, expected: DataFrame, size: str = "size", uses: int | None = None) -> DataFrame:
    """(problem, id, n) of a stress run: operations that didn't occur as often as expected (name, calls), paths with more than one hash record,
    hashes without a record, texts whose length isn't the one they state, and files not used `uses` times.

    events: name, fhash, text, length; names: value, name (hash records).
    """
    counted = events.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    often = expected.join(counted, "name", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> calls").select(F.lit("calls").alias("problem"), F.col("name").alias("id"), "n")
    twice = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("recorded twice").alias("problem"), F.col("name").alias("id"), "n")
    known = names.groupBy(F.col("value").alias("fhash")).agg(F.min("name").alias("path"))
    used = events.filter("fhash is not null").groupBy("fhash").agg(F.count(F.lit(1)).alias("n")).join(known, "fhash", "left")
    lost = used.filter("path is null").select(F.lit("unknown hash").alias("problem"), F.col("fhash").alias("id"), "n")
    torn = events.filter("length(text) <> length").groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("length").alias("problem"), F.col("name").alias("id"), "n")
    found = often.union(twice).union(lost).union(torn)
    if uses is not None:
        found = found.union(used.filter("path is not null").groupBy("path").agg(F.sum("n").alias("n")).filter(F.col("n") != uses).select(F.lit("uses").alias("problem"), F.col("path").alias("id"), "n"))
    return found


def device_problems(records: DataFrame, regions: DataFrame, categories: list[str], keys: list[str]) -> DataFrame:
    """(problem, id) of device records (keys, id, cat, ts, dur): a category that never occurs, negative times, and records that no region (keys, region, rs, re) holds."""
    spark = records.sparkSession
    wanted = spark.createDataFrame([(c,) for c in categories], "cat string")
    absent = wanted.join(records.select("cat").distinct(), "cat", "left_anti").select(F.lit("missing category").alias("problem"), F.col("cat").alias("id"))
    wrong = records.filter("ts < 0 or dur < 0 or ts is null or dur is null").select(F.lit("time").alias("problem"), F.col("id").cast("string"))
    timed = records.filter("ts >= 0 and dur >= 0").withColumn("te", F.col("ts") + F.col("dur"))
    held = contained_in(timed, regions, keys).select("id")
    outside = timed.join(held, "id", "left_anti").select(F.lit("outside every region").alias("problem"), F.col("id").cast("string"))
    return absent.union(wrong).union(outside)
