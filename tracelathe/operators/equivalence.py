"""Equivalence of two traces of one program: what must differ between two runs is scrubbed by the trace's own facts, not by patterns.

Rows: id, name, cat, type, ph, pid, tid, ts, dur, args (JSON text of an object; null: none). Of each trace are taken the set of its pids and tids,
the table of its hash records, the names that calls made up at random, its time window, and its polls. Argument values meet these
tables in joins: texts repeat, so distinct ones are scrubbed, not events; numbers only meet the ids.

- Values that are one of the trace's ids, and runs of digits in texts that are, become ID.
- Texts that are a recorded hash become the kind of record and the (scrubbed) name that the hash stands for; names made up at random become TEMP in their directory.
- Whole numbers inside the trace's time window become TS.
- Arguments that hold addresses become ADDR; those that differ by their nature are left out; calls that return other processes' ids have ID.
- Polls are left out, and from the number of events of their process.
- Operations that either trace has folded are compared by their totals of calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.operators.written import DENSE, drop_paths, exchanges_dropped, written

#: Fixed values of the trace format: arguments that differ between any two runs, those that hold addresses, records of hashes,
#: calls that make up names, calls that return the id of another process, and the errno of an operation in progress.
VOLATILE_ARGS = ("date", "ppid", "log_file", "pc_mode", "capacity")
ADDRESS_ARGS = ("address", "addr", "result_address")
HASH_RECORDS = ("FH", "SH", "HH")
TEMP_CALLS = ("mkstemp", "mkstemp64", "mkostemp", "mkostemp64", "mkstemps", "mkstemps64", "mkostemps", "mkostemps64", "mkdtemp", "mktemp")
PROCESS_ARGS = (("fork", "ret"), ("vfork", "ret"), ("waitpid", "pid"), ("waitpid", "ret"), ("wait", "ret"))
EINPROGRESS = 115
MARGIN_US = 60_000_000
#: Levels of nested objects that are scrubbed value by value; deeper ones are compared as they are.
LEVELS = 4
#: Compressed bytes of input that are scrubbed at once, and rows that a file of it has at most.
SLICE_BYTES = 256 << 20
SLICE_ROWS = 1 << 20


def values_of(rows: DataFrame) -> DataFrame:
    """(side, row, name, pid, path, key, kind, text, json): the values in the rows' arguments, objects taken apart; json only of those that are no texts and no whole numbers."""
    own = ("side", "row", "name", "pid")
    parsed = rows.select(*own, F.try_parse_json("args").alias("object"))
    explode = rows.sparkSession.tvf
    # Elements of an array have no key.
    every = parsed.lateralJoin(explode.variant_explode(F.col("object").outer())).filter(F.col("key").isNotNull() & ~F.col("key").isin(*VOLATILE_ARGS))
    every = every.select(*own, F.col("key").alias("path"), "key", "value", F.schema_of_variant("value").alias("kind"))
    # By joins, level by level: functions on arrays take twice as long.
    for _ in range(LEVELS - 1):
        is_object = F.col("kind").startswith("OBJECT") & ~F.col("key").isin(*ADDRESS_ARGS)
        every = every.select(*own, "path", "kind", F.col("key").alias("of"), F.col("value").alias("whole"), is_object.alias("is_object"))
        every = every.lateralJoin(explode.variant_explode_outer(F.when(F.col("is_object"), F.col("whole")).outer()))
        every = every.filter(~F.col("is_object") | F.col("key").isNotNull() & ~F.col("key").isin(*VOLATILE_ARGS))
        either = lambda inner, same: F.when(F.col("is_object"), inner).otherwise(F.col(same))
        every = every.select(*own, either(F.concat("path", F.lit("."), "key"), "path").alias("path"), either(F.col("key"), "of").alias("key"), either(F.col("value"), "whole").alias("value"), either(F.schema_of_variant("value"), "kind").alias("kind"))
    # What a value looks like in JSON tells texts from numbers; `text` is the value itself.
    json = F.when(~F.col("kind").isin("STRING", "BIGINT"), F.to_json("value")).alias("json")
    return every.select(*own, "path", "key", "kind", F.expr("try_variant_get(value, '$', 'string')").alias("text"), json)


def is_poll(rows: DataFrame) -> Column:
    """Calls whose number depends on how soon the system finishes something."""
    return (F.col("name") == "aio_suspend") | (F.col("name") == "aio_error") & F.coalesce(F.get_json_object("args", "$.ret") == str(EINPROGRESS), F.lit(False))


def _marked(left: DataFrame, right: DataFrame) -> DataFrame:
    kinds = {"id": "bigint", "name": "string", "cat": "string", "type": "int", "ph": "int", "pid": "bigint", "tid": "bigint", "ts": "bigint", "dur": "bigint", "args": "string"}
    side = lambda rows, mark: rows.select(F.lit(mark).alias("side"), *(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    return side(left, "left").union(side(right, "right"))


def without_ids(texts: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """(side, text, plain): texts (side, text; distinct) with every run of digits that is one of the side's ids replaced."""
    runs = texts.select("side", text, F.posexplode(F.expr(f"regexp_extract_all(`{text}`, '[0-9]+|[^0-9]+', 0)")).alias("at", "run"))
    known = ids.select("side", F.col("text").alias("run"), F.lit(True).alias("known"))
    met = runs.join(known, ["side", "run"], "left").select("side", text, "at", F.when(F.col("known"), "ID").otherwise(F.col("run")).alias("run"))
    parts = F.array_sort(F.collect_list(F.struct("at", "run")))
    return met.groupBy("side", text).agg(F.array_join(F.transform(parts, lambda x: x["run"]), "").alias("plain"))


def _hash_table(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(side, text, name): what recorded hashes, and names made up at random, are compared as."""
    arg = lambda k: F.get_json_object("args", f"$.{k}")
    records = rows.filter(F.col("name").isin(*HASH_RECORDS)).select("side", F.col("name").alias("record"), arg("value").alias("value"), F.coalesce(arg("name"), F.lit("")).alias("text")).filter("value is not null")
    temps = rows.filter(F.col("name").isin(*TEMP_CALLS)).select("side", arg("fhash").alias("value"), F.lit(True).alias("temp")).filter("value is not null").distinct()
    plain = without_ids(records.select("side", "text").distinct(), ids)
    named = records.join(plain, ["side", "text"], "left").join(temps, ["side", "value"], "left").withColumn("plain", F.coalesce("plain", F.lit("")))
    directory = F.regexp_replace("plain", "/?[^/]*$", "")
    made_up = F.when(directory == "", "TEMP").otherwise(F.concat(directory, F.lit("/TEMP")))
    named = named.withColumn("plain", F.when(F.col("temp"), made_up).otherwise(F.col("plain")))
    hashes = named.select("side", F.col("value").alias("text"), F.concat("record", F.lit(":"), "plain").alias("name"))
    names = named.filter("temp").select("side", "text", F.col("plain").alias("name"))
    return hashes.union(names).groupBy("side", "text").agg(F.max("name").alias("name"))


def _facts(rows: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of the traces: (side, kind, text, known) of values that are compared as something else, (side, first, last), (side, pid, polls)."""
    ids = rows.select("side", F.explode(F.array(F.col("pid").cast("string"), F.col("tid").cast("string"))).alias("text")).filter("text is not null").distinct()
    ids = written(ids, paths)
    window = rows.filter("ts is not null").groupBy("side").agg((F.min("ts") - MARGIN_US).alias("first"), (F.max(F.col("ts") + F.coalesce("dur", F.lit(0))) + MARGIN_US).alias("last"))
    window = F.broadcast(written(window, paths))  # a row for each side
    polls = written(rows.filter(is_poll(rows)).groupBy("side", "pid").agg(F.count(F.lit(1)).alias("polls")), paths)
    values = values_of(rows.filter(~is_poll(rows)))
    texts = written(values.filter((F.col("kind") == "STRING") & ~F.col("key").isin(*ADDRESS_ARGS)).select("side", "text").distinct(), paths)
    whole = ids.select("side", "text", F.lit(True).alias("is_id"))
    facts = texts.join(whole, ["side", "text"], "left").join(_hash_table(rows, ids), ["side", "text"], "left").join(without_ids(texts, ids), ["side", "text"], "left").join(window, "side", "left")
    number = F.expr("case when text rlike '^-?[0-9]+$' then try_cast(text as bigint) end")
    is_time = F.coalesce(number.between(F.col("first"), F.col("last")), F.lit(False))
    shown = F.when(F.col("is_id"), F.lit('"ID"')).when(F.col("name").isNotNull(), _quoted("name")).when(is_time & ~F.col("text").startswith("-"), F.lit('"TS"')).otherwise(_quoted("plain"))
    facts = facts.withColumn("known", shown).filter(F.col("known") != _quoted("text")).select("side", F.lit("STRING").alias("kind"), "text", "known")
    # Written, so that their size is known and values need not be moved to meet few.
    return written(facts.union(whole.select("side", F.lit("BIGINT"), "text", F.lit('"ID"'))), paths), window, polls


def scrubbed(rows: DataFrame, facts: DataFrame, window: DataFrame, polls: DataFrame) -> DataFrame:
    """(side, id, name, cat, ph, calls, args) of marked rows (side, row: a number of its own, and the columns above), without polls; args starts with type and phase."""
    kept = rows.filter(~is_poll(rows))
    values = values_of(kept).join(window, "side", "left").join(polls, ["side", "pid"], "left")
    is_time = F.coalesce((F.col("kind") == "BIGINT") & F.expr("try_cast(text as bigint)").between(F.col("first"), F.col("last")), F.lit(False))
    of_process = reduce(lambda a, b: a | b, ((F.col("name") == n) & (F.col("path") == k) for n, k in PROCESS_ARGS))
    less = (F.col("text").cast("bigint") - F.coalesce("polls", F.lit(0))).cast("string")
    fixed = F.when(F.col("key").isin(*ADDRESS_ARGS), F.lit('"ADDR"')).when(of_process & (F.col("text") != "-1"), F.lit('"ID"'))
    own = (
        F.when(is_time, F.lit('"TS"'))
        .when((F.col("name") == "end") & (F.col("path") == "num_events") & (F.col("kind") == "BIGINT"), less)
        .when(F.col("kind") == "STRING", _quoted("text"))
        .otherwise(F.coalesce("json", "text"))
    )
    path = F.when(F.col("path").rlike("^[A-Za-z0-9_.-]*$"), F.concat(F.lit('{"p":"'), "path", F.lit('"}'))).otherwise(F.to_json(F.struct(F.col("path").alias("p"))))
    # Few columns, as they are moved; what is fixed meets no facts.
    values = values.select("side", "row", F.when(fixed.isNull(), F.col("kind")).otherwise("").alias("kind"), "text", path.alias("path"), F.coalesce(fixed, own).alias("own"))
    said = values.join(facts, ["side", "kind", "text"], "left").select("row", F.concat("path", F.lit(":"), F.coalesce("known", "own")).alias("value"))
    # Moved as they are: lists of one value each would be larger.
    made = said.repartition("row").groupBy("row").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"))
    calls = F.when(F.col("ph") == 3, F.coalesce(F.get_json_object("args", "$.dft_cnt").cast("bigint"), F.lit(0))).otherwise(1).cast("bigint")
    head = kept.select("side", "row", "id", "name", "cat", "ph", calls.alias("calls"), *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"_{c}") for c in ("type", "ph")))
    return head.join(made, "row", "left").select("side", "id", "name", "cat", "ph", "calls", F.concat_ws(" ", "_type", "_ph", F.coalesce("values", F.lit(""))).alias("args"))


def _quoted(column: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("x"))), r'^\{"x":(.*)\}$', 1)


def _slices(rows: DataFrame, size: int) -> list[DataFrame]:
    """A written table in parts of about so many bytes (one file at least)."""
    files = sorted(rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n")).distinct().collect())
    parts, room = [], 0
    for file, n in files:
        if n > room:
            parts.append([])
            room = size
        parts[-1].append(file)
        room -= n
    return [rows.filter(F.col("_metadata.file_path").isin(part)) for part in parts] if len(parts) > 1 else [rows]


def _digest(columns: tuple[str, ...]) -> Column:
    """128 bits of a SHA-256 of the columns."""
    said = F.concat_ws(",", *(F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns))
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def differences(left: DataFrame, right: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(part, name, cat, args, n_left, n_right): what doesn't occur equally often; no rows for equivalent traces.

    Parts: event (scrubbed; args starts with type and phase), calls (totals of operations that either trace folds), id (only if neither
    folds or polls unequally), process and thread (how many).

    Values are scrubbed in slices of the written input, so that what is on disk between steps is bounded by `slice_bytes`. Scrubbed
    texts are counted by a digest; only those of digests that don't occur equally often are moved whole.
    """
    spark, paths = left.sparkSession, []
    with exchanges_dropped(spark):
        try:
            return _differences(_marked(left, right), paths, slice_bytes)
        finally:
            drop_paths(spark, paths)


def _differences(rows: DataFrame, paths: list[str], slice_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    # Made once and numbered; dealt to all cores if it has few bytes, as a few small files hold much work.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), paths, maxRecordsPerFile=str(SLICE_ROWS), **DENSE)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        first, paths[:] = paths[:], []
        rows = written(rows.repartition(2 * cores), paths, **DENSE)
        drop_paths(spark, first)
    facts = _facts(rows, paths)
    ready_paths = []
    parts = [written(scrubbed(part, *facts), ready_paths, **DENSE) for part in _slices(rows, slice_bytes)]
    paths += ready_paths
    ready = spark.read.schema(parts[0].schema).parquet(*ready_paths)
    folded = ready.filter("ph = 3").select(F.col("name").alias("f_name"), F.col("cat").alias("f_cat")).distinct().withColumn("folded", F.lit(True))
    folded = written(folded, paths)
    same = F.col("name").eqNullSafe(F.col("f_name")) & F.col("cat").eqNullSafe(F.col("f_cat"))
    marked = ready.join(folded, same, "left")
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string")
    events = marked.select("side", F.when(F.col("folded"), "calls").otherwise("event").alias("part"), "name", "cat", F.when(F.col("folded"), "").otherwise(F.col("args")).alias("args"), F.when(F.col("folded"), F.col("calls")).otherwise(one).alias("n"))
    polls = rows.agg(*(F.count_if(is_poll(rows) & (F.col("side") == s)).alias(s) for s in ("left", "right"))).first()
    # Ids number the events that were written out, so they follow what was folded, and they number the polls.
    numbers = ready.filter("id is not null").select("side", F.lit("id").alias("part"), none.alias("name"), none.alias("cat"), F.col("id").cast("string").alias("args"), one.alias("n"))
    numbers = [numbers] if polls[0] == polls[1] and folded.isEmpty() else []
    many = [
        rows.select("side", *c).distinct().groupBy("side").agg(F.count(F.lit(1)).alias("n")).select("side", F.lit(part).alias("part"), none.alias("name"), none.alias("cat"), F.lit("").alias("args"), "n")
        for part, c in (("process", ["pid"]), ("thread", ["pid", "tid"]))
    ]
    what = ("part", "name", "cat", "args")
    every = reduce(DataFrame.union, [events, *numbers, *many]).withColumn("digest", _digest(what))
    unequal = every.groupBy("digest").agg(F.sum(F.when(F.col("side") == "left", F.col("n")).otherwise(-F.col("n"))).alias("more")).filter("more <> 0").select("digest")
    found = every.join(written(unequal, paths), "digest", "left_semi")
    counted = found.groupBy(*what).agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("left", "right")))
    return written(counted.filter("n_left <> n_right"))
