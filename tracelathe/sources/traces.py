"""Readers and writers of traces: newline-delimited JSON, plain or in gzip members, also in the older array form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators.written import written
from tracelathe.schema import phase_code, phase_letter


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): every line of plain and gzip files; globs and lists of paths are fine."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def event_lines(lines: DataFrame) -> DataFrame:
    """Lines without array framing: trimmed, no trailing comma, no brackets or blanks."""
    body = F.regexp_replace(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")), ",$", "")
    return lines.withColumn("value", body).filter(~F.col("value").isin("", "[", "]"))


def parse_events(lines: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Head columns and `args` (VARIANT) of event lines; lines that aren't JSON objects are left out.

    Numbers may be strings and phases letters, as in older traces. `extra` adds columns made of `v`, the whole record.
    """
    parsed = event_lines(lines).withColumn("v", F.expr("try_parse_json(value)")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    long = lambda name: text(name).try_cast("bigint").alias(name)
    return parsed.select(
        *(["file"] if "file" in lines.columns else []), long("id"), text("name").alias("name"), text("cat").alias("cat"), text("type").try_cast("smallint").alias("type"),
        phase_code(text("ph")).alias("ph"), long("pid"), long("tid"), long("ts"), long("dur"), F.try_variant_get("v", "$.args", "variant").alias("args"), *((c.alias(k)) for k, c in (extra or {}).items()),
    )


def read_trace(spark: SparkSession, path: str | list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    return parse_events(read_lines(spark, path), extra)


def variant_numbers(events: DataFrame) -> DataFrame:
    """One row per event and numeric argument: id, key, number (open argument sets in long form)."""
    entries = F.expr("case when schema_of_variant(args) like 'OBJECT%' then map_entries(cast(args as map<string, variant>)) end")
    rows = events.select("id", F.explode(entries).alias("a"))
    return rows.select("id", "a.key", F.expr("try_variant_get(a.value, '$', 'double')").alias("number")).filter("number is not null")


def with_line_numbers(lines: DataFrame, through: bool = False) -> DataFrame:
    """Adds `line`, from 0 in each file in the order of reading: partitions are counted first, so no file is sorted in one task.

    through: from 0 in the first file, through all files in the order of their names.

    The lines are written once with their places, so counts and lines agree whatever is read or computed again.
    """
    rows = written(lines.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.expr("shiftright(_id, 33)"))
    counts = rows.groupBy(F.col("file").alias("_file"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_file", "_of") if through else Window.partitionBy("_file").orderBy("_of")  # a row for each split of a file
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    found = rows.join(F.broadcast(counts), (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_of")))
    return found.select(*lines.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"))


def line_batches(lines: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Adds `batch`, the first line of the range of `size` lines that a line is in; lines: with `line`."""
    return lines.withColumn("batch", (F.col("line") - F.pmod(F.col("line"), F.lit(size))).cast("bigint"))


HEAD_ORDER = ("id", "name", "cat", "type", "pid", "tid", "ts", "dur", "ph")
SERIES_ORDER = ("name", "cat", "type", "ts", "ph", "pid", "tid")


def _line(rows: DataFrame, head: tuple[str, ...], args: list[str]) -> Column:
    """A record: its head columns in order, then `args` (a column, or made of the columns named); nulls are left out."""
    own = [F.col("args")] if "args" in rows.columns and not args else [F.struct(*(F.col(f"`{c}`") for c in args)).alias("args")] if args else []
    return F.to_json(F.struct(*(c for c in head if c in rows.columns), *own))


def json_line(events: DataFrame, args: list[str] = ()) -> Column:
    """Complete events as JSON; columns beyond the head are written if `args` names them."""
    return _line(events, HEAD_ORDER, list(args))


def series_line(rows: DataFrame, args: list[str] = ()) -> Column:
    """Counters (ph 2) and folded rows (ph 3) as JSON: no id and no dur in the head."""
    return _line(rows, SERIES_ORDER, list(args))


def aggregated_line(rows: DataFrame, keys: list[str] = (), values: list[str] = ()) -> Column:
    """Rows of interval_aggregate as JSON: keys, dft_cnt, and each field by its name if folded once, else with _sum, _min and _max."""
    once = F.col("dft_cnt") == 1
    args = [F.col(k) for k in keys] + [F.col("dft_cnt")]
    for field in ("dur", *values):
        args.append(F.when(once, F.col(f"{field}_sum")).alias(field))
        args += [F.when(~once, F.col(f"{field}_{n}")).alias(f"{field}_{n}") for n in ("sum", "min", "max")]
    head = [F.col("name"), F.col("cat"), F.col("type"), F.col("interval").alias("ts"), F.lit(3).alias("ph"), *([F.col("pid")] if "pid" in rows.columns else []), F.col("tid")]
    return F.to_json(F.struct(*head, F.struct(*args).alias("args")))


def metadata_line(rows: DataFrame, cat: str, fields: list[str] = ("key", "value")) -> Column:
    """Metadata (ph 4) as JSON: (record, type, pid, tid, hhash, key, value) as name and value, or a record of other fields."""
    own = [F.col("key").alias("name"), F.col("value")] if list(fields) == ["key", "value"] else [F.col(f) for f in fields]
    return F.to_json(F.struct(F.col("record").alias("name"), F.lit(cat).alias("cat"), "type", "pid", "tid", F.lit(4).alias("ph"), F.struct("hhash", *own).alias("args")))


def write_lines(lines: DataFrame, path: str, compress: bool = True) -> None:
    writer = lines.select("value").write
    (writer.option("compression", "gzip") if compress else writer).text(path)


def write_trace(events: DataFrame, path: str, compress: bool = True, lines_per_file: int = 0) -> None:
    """One JSON object a line; whole files are rolled over after so many lines."""
    writer = events.select(json_line(events).alias("value")).write.option("maxRecordsPerFile", lines_per_file)
    (writer.option("compression", "gzip") if compress else writer).text(path)


def drop_small_traces(events: DataFrame, least: int = 5, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Without the processes that have fewer events; keys: what tells processes apart."""
    enough = events.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys)
    return events.join(enough, list(keys), "left_semi")


def capped(lines: DataFrame, cap: int = 16384) -> DataFrame:
    """Cuts lines of more bytes than the format's cap to it, back to the start of a character that would be torn, and flags them."""
    over = F.octet_length("value") > cap
    data = F.col("value").cast("binary")
    goes_on = lambda i: F.hex(F.substring(data, i, 1)).between("80", "BF")  # noqa: E731  the byte goes on a character
    keep = F.when(~goes_on(cap + 1), cap).when(~goes_on(cap), cap - 1).when(~goes_on(cap - 1), cap - 2).otherwise(cap - 3)
    cut = F.decode(F.substring(data, F.lit(1), keep), "utf-8")
    return lines.withColumn("over_cap", over).withColumn("value", F.when(F.col("over_cap"), cut).otherwise(F.col("value")))


def without_metadata(events: DataFrame) -> DataFrame:
    """Events as a trace without metadata holds them: of their arguments (args: VARIANT) only `relations` stay, as JSON text; null without."""
    relations = F.expr("variant_get(args, '$.relations', 'variant')")
    kept = F.concat(F.lit('{"relations":'), F.to_json(relations), F.lit("}"))
    return events.withColumn("args", F.when(relations.isNotNull(), kept))


def viewer_events(events: DataFrame) -> DataFrame:
    """Events in the viewer's format: phase letters in place of codes."""
    return events.withColumn("ph", phase_letter(F.col("ph")))


def read_benchmarks(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Benchmark results as CSV with a header: the columns named (was: new name), numbers where every value is one; `#` lines are comments."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("comment", "#").csv(path)
    trimmed = {c.strip(): c for c in rows.columns}
    return rows.select(*(F.col(f"`{trimmed[was]}`").alias(new) for was, new in columns.items()))
