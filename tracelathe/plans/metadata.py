"""Views of metadata records (ph 4) and of file-system records.

Records: pid, name (the record's), ts or another order, and args as columns or a map of strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells processes apart: pids repeat on other hosts and in other files.
PROCESS = ("hhash", "pid")
LEVELS = {"mount": "mhash", "dir": "dhash", "file": "fhash"}


def names_of(records: DataFrame, kinds: tuple[str, ...] = ("FH", "SH", "HH")) -> DataFrame:
    """(kind, value, name): what hashes of paths, strings and hosts stand for, each once."""
    return records.filter(F.col("record").isin(*kinds)).select(F.col("record").alias("kind"), "value", F.col("key").alias("name")).distinct()


def custom_values(records: DataFrame, internal: int = 1) -> DataFrame:
    """(pid, key, value, type, ts): what applications logged; a key logged twice has two rows. Rows of the tracer's own layer are left out."""
    return records.filter((F.col("record") == "CM") & (F.col("type") != internal)).select("pid", "key", "value", "type", "ts")


def process_keys(rows: DataFrame, keys: tuple[str, ...] | list[str] | None = None) -> list[str]:
    """The columns that tell processes apart: those given, else host and pid as far as the rows have them."""
    return list(keys) if keys else [k for k in PROCESS if k in rows.columns]


def process_table(records: DataFrame, keys: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """One row per process: rank, app, host (hash), start and end (times of those records), and the last value of every key of `end`, as a map.

    Without keys given, a process is a pid on a host; `file` and pid are another choice.
    """
    keys = process_keys(records, keys)
    at = lambda name, c: F.min(F.when(F.col("record") == name, F.col(c)))
    named = lambda key: F.max(F.when((F.col("record") == "PR") & (F.col("key") == key), F.col("value")))
    host = [] if "hhash" in keys else [at("HH", "value").alias("hhash")]
    heads = records.groupBy(*keys).agg(
        named("rank").try_cast("bigint").alias("rank"), named("app").alias("app"), *host, at("start", "ts").alias("start"), F.max(F.when(F.col("record") == "end", F.col("ts"))).alias("end"),
    )
    last = records.filter("record = 'end' and key is not null").groupBy(*keys, "key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    ends = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))
    return heads.join(ends, keys, "left")


def with_process(events: DataFrame, processes: DataFrame, keys: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Events with `app` and `rank` of their process, null where it is unknown; processes: as process_table gives them."""
    keys = process_keys(events, keys)
    return events.join(processes.select(*keys, "app", "rank"), keys, "left")


def world_size(records: DataFrame) -> DataFrame:
    """(ranks): the distinct ranks; the size of the world if every rank was traced."""
    return records.filter("record = 'PR' and key = 'rank'").agg(F.countDistinct("value").alias("ranks"))


def fs_levels(records: DataFrame) -> dict[str, DataFrame]:
    """The mount, dir and file records (columns pid, level, mhash, dhash, fhash, and facts)."""
    return {level: records.filter(F.col("level") == level) for level in LEVELS}


def fs_join(events: DataFrame, files: DataFrame, dirs: DataFrame, mounts: DataFrame, keys: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Events (a process's keys, fhash) with their file's, directory's and mount's facts, all of the same process; missing levels are null.

    The three tables join each other first: they have a row per file, where events are many.
    """
    keys = process_keys(events, keys)
    d = dirs.select(*keys, "dhash", "mhash").alias("d")
    m = mounts.select(*keys, "mhash", "fs").alias("m")
    placed = files.select(*keys, "fhash", "dhash", "size").alias("f").join(d, [*keys, "dhash"], "left").join(m, [*keys, "mhash"], "left")
    return events.join(placed.select(*keys, "fhash", "dhash", "mhash", F.col("size").alias("file_size"), "fs"), [*keys, "fhash"], "left")


def fs_record_problems(records: DataFrame, names: DataFrame, keys: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """(a process's keys, problem, id, n): bad levels, hashes without a name, doubled records, missing parents and bad sizes of file-system records."""
    keys = process_keys(records, keys)
    key = F.coalesce(*(F.when(F.col("level") == level, F.col(c)) for level, c in LEVELS.items()))
    rows = records.withColumn("id", key)
    bad = rows.filter(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False))).select(*keys, F.lit("level").alias("problem"), F.col("level").alias("id"))
    known = rows.filter(F.col("level").isin(*LEVELS))
    unnamed = known.join(names.select(F.col("value").alias("id")).distinct(), "id", "left_anti").select(*keys, F.lit("name").alias("problem"), "id")
    doubled = known.groupBy(*keys, "level", "id").count().filter("count > 1").select(*keys, F.lit("doubled").alias("problem"), "id")
    parts = fs_levels(known)
    orphans = [
        parts[child].join(parts[parent].select(*keys, link).distinct(), [*keys, link], "left_anti").select(*keys, F.lit(f"no {parent}").alias("problem"), "id")
        for child, parent, link in (("file", "dir", "dhash"), ("dir", "mount", "mhash"))
    ]
    sizes = parts["file"].filter("size is null or size < 0").select(*keys, F.lit("size").alias("problem"), "id")
    whole = bad
    for part in (unnamed, doubled, *orphans, sizes):
        whole = whole.union(part)
    return whole.groupBy(*keys, "problem", "id").agg(F.count(F.lit(1)).alias("n"))


def lineage_problems(entities: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """(problem, id): entity ids and type names that repeat, and edges (subject, relation, object) with an unknown end."""
    twice = entities.groupBy("id").count().filter("count > 1").select(F.lit("entity twice").alias("problem"), "id")
    doubled = types.groupBy(F.col("type").alias("id")).count().filter("count > 1").select(F.lit("type twice").alias("problem"), "id")
    ids = entities.select("id").distinct()
    lost = [edges.select(F.col(end).alias("id")).join(ids, "id", "left_anti").distinct().select(F.lit(f"unknown {end}").alias("problem"), "id") for end in ("subject", "object")]
    return twice.union(doubled).union(lost[0]).union(lost[1])
