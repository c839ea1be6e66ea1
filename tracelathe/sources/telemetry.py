"""Parsers of telemetry texts: metrics exposition, /proc snapshots, nested power readings and mount tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.functions.scalars import percent_of


def exposition(lines: DataFrame) -> DataFrame:
    """(metric, value, labels) of `name{labels} value` lines; comments and malformed lines are left out."""
    line = F.regexp_replace(F.trim("value"), r"\r$", "")
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{([^}]*)\})?\s+(\S+)(\s+\S+)?$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return lines.filter(~line.startswith("#")).select(part(1).alias("metric"), part(4).try_cast("double").alias("value"), part(3).alias("labels")).filter("metric <> '' and value is not null")


def proc_stat(lines: DataFrame) -> DataFrame:
    """(name, user_pct, ... ) of /proc/stat: percent of all jiffies since boot; `cpu` and one `cpu-N` per core."""
    fields = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("value").rlike(r"^cpu[0-9]*\s")).withColumn("w", words)
    number = [F.coalesce(F.try_element_at("w", F.lit(i + 2)).try_cast("bigint"), F.lit(0)) for i in range(10)]
    total = sum(number[1:], number[0])
    core = F.regexp_extract(F.element_at("w", 1), "([0-9]+)", 1)
    name = F.when(core == "", "cpu").otherwise(F.concat(F.lit("cpu-"), core))
    return rows.select(name.alias("name"), *(percent_of(n, total).alias(f"{f}_pct") for f, n in zip(fields, number, strict=True)))


def meminfo(lines: DataFrame) -> DataFrame:
    """(key, kb, percent): every value as percent of MemAvailable (0.0 if there is none); MemAvailable itself raw."""
    rows = lines.select("file", F.trim(F.element_at(F.split("value", ":"), 1)).alias("key"), F.regexp_extract("value", r":\s*([0-9]+)", 1).try_cast("bigint").alias("kb")).filter("kb is not null")
    base = rows.filter("key = 'MemAvailable'").select("file", F.col("kb").alias("base"))
    share = F.when(F.coalesce("base", F.lit(0)) == 0, 0.0).otherwise(100.0 * F.col("kb") / F.col("base"))
    return rows.join(base, "file", "left").select("file", "key", "kb", F.when(F.col("key") == "MemAvailable", F.col("kb").cast("double")).otherwise(share).alias("percent"))


def diskstats(lines: DataFrame) -> DataFrame:
    """(file, device, reads, read_bytes, writes, write_bytes, ios_in_progress); loop and ram devices are left out."""
    w = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.try_element_at("w", F.lit(i)).try_cast("bigint")
    rows = lines.select("file", w.alias("w")).filter("size(w) >= 14")
    device = F.element_at("w", 3)
    return rows.filter(~device.contains("loop") & ~device.contains("ram")).select("file", device.alias("device"), n(4).alias("reads"), (n(6) * 512).alias("read_bytes"), n(8).alias("writes"), (n(10) * 512).alias("write_bytes"), n(12).alias("ios_in_progress"))


def net_dev(lines: DataFrame) -> DataFrame:
    """(file, interface, rx_bytes, rx_packets, rx_errors, rx_dropped, tx_bytes, tx_packets, tx_errors, tx_dropped, collisions) without lo."""
    rows = lines.select("file", F.trim(F.element_at(F.split("value", ":"), 1)).alias("interface"), F.split(F.trim(F.try_element_at(F.split("value", ":"), F.lit(2))), r"\s+").alias("w")).filter("size(w) >= 16 and interface <> 'lo'")
    names = {"rx_bytes": 1, "rx_packets": 2, "rx_errors": 3, "rx_dropped": 4, "tx_bytes": 9, "tx_packets": 10, "tx_errors": 11, "tx_dropped": 12, "collisions": 14}
    return rows.select("file", "interface", *(F.element_at("w", i).try_cast("bigint").alias(k) for k, i in names.items())).filter("rx_bytes is not null")


def power_leaves(readings: DataFrame, depth: int = 32) -> DataFrame:
    """(path, value) of the finite numbers in nested power readings (column v: VARIANT); keys named `timestamp` are left out.

    A path joins the keys, and places in arrays, by dots, without the first level, the host. Each level is one pass over a reading's open
    nodes, as many as it has levels; numbers deeper than `depth` levels are not readings.
    """
    node = lambda keys, v, closed="false": f"named_struct('keys', {keys}, 'v', {v}, 'closed', {closed})"
    step = f"""
      coalesce(case when n.closed then array(n) end,
        transform(filter(map_entries(try_variant_get(n.v, '$', 'map<string, variant>')), e -> e.key <> 'timestamp'), e -> {node("array_append(n.keys, e.key)", "e.value")}),
        transform(try_variant_get(n.v, '$', 'array<variant>'), (x, i) -> {node("array_append(n.keys, cast(i as string))", "x")}),
        array({node("n.keys", "n.v", "true")}))"""
    nodes = f"""
      aggregate(sequence(1, {depth + 1}), array({node("cast(array() as array<string>)", "v")}),
        (nodes, level) -> case when exists(nodes, n -> not n.closed) then flatten(transform(nodes, n -> {step})) else nodes end)"""
    level = readings.select(F.explode(F.expr(nodes)).alias("x")).select("x.*").filter("closed")
    leaves = level.filter("schema_of_variant(v) not in ('STRING', 'BOOLEAN', 'VOID')")
    leaves = leaves.select(F.array_join(F.slice("keys", 2, 1000), ".").alias("path"), F.expr("try_variant_get(v, '$', 'double')").alias("value"))
    return leaves.filter("value is not null and not isnan(value) and abs(value) < double('infinity')")


#: Spellings of the families of power readings.
FAMILIES = {"cpu": "cpu", "cpus": "cpu", "gpu": "gpu", "gpus": "gpu", "mem": "memory", "memory": "memory", "net": "network", "network": "network", "node": "node"}
_WATTS = "^power_(.+)_watts$"


def _family(word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair)), word)


def power_family(path: Column) -> Column:
    """The family of a reading: that of its first power_<family>_watts segment (any name counts), else the first word that names a device, else `other`."""
    segments = F.filter(F.split(path, r"\."), lambda s: s.rlike(_WATTS))
    named = F.regexp_extract(F.try_element_at(segments, F.lit(1)), _WATTS, 1)
    words = F.filter(F.split(path, "[._]"), lambda w: _family(w).isNotNull())
    return F.coalesce(_family(named), named, _family(F.try_element_at(words, F.lit(1))), F.lit("other"))


def power_reading(path: Column) -> Column:
    """A reading's name in its family: its path without the first power_<family>_watts segment; `total` if nothing is left."""
    segments = F.split(path, r"\.")
    at = F.array_position(F.transform(segments, lambda s: s.rlike(_WATTS)), True).cast("int")
    rest = F.when(at > 0, F.concat(F.slice(segments, 1, F.greatest(at - 1, F.lit(0))), F.slice(segments, at + 1, F.size(segments)))).otherwise(segments)
    return F.coalesce(F.nullif(F.array_join(rest, "."), F.lit("")), F.lit("total"))


def mountinfo(lines: DataFrame) -> DataFrame:
    """(point, device, fstype, source, ord) of mount tables: octal escapes are resolved, optional fields end at a dash."""
    w = F.split("value", " ")
    dash = F.array_position("w", "-").cast("int")
    text = F.element_at("w", 5)
    for octal, sign in (("040", " "), ("011", "\t"), ("012", "\n"), ("134", "\\")):
        text = F.replace(text, F.lit("\\" + octal), F.lit(sign))
    return lines.select(w.alias("w")).filter("size(w) >= 10 and array_position(w, '-') > 0").select(text.alias("point"), F.element_at("w", 3).alias("device"), F.element_at("w", dash + 1).alias("fstype"), F.element_at("w", dash + 2).alias("source"), F.element_at("w", 1).cast("int").alias("ord"))
