"""Scalar functions, utilities and path operators over the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelathe.functions import scalars
from tracelathe.operators import joins, rules, validate
from tracelathe.plans import utilities
from tracelathe.queries.tables import table
from tracelathe.schema import phase_letter
from tracelathe.sources import telemetry

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


def _column(name, source, key, column, make, oracle) -> None:
    """A query of one scalar function of a column."""
    query(name, f"SELECT {key}, {oracle} AS x FROM {source}")(lambda spark, d: table(spark, d, source).select(key, make(F.col(column)).alias("x")))


_HASH = " || ".join(f"substr(md5(c_name), {4 * k + 1}, 2)" for k in range(8))
_column("hash16", "customer", "c_custkey", "c_name", scalars.hash16, _HASH)
_column("fix_str", "pages", "page_id", "html", lambda c: F.md5(scalars.fix_str(c).cast("binary")), r"""md5(regexp_replace(html, '[\x00-\x1f\x7f()\\"''|]', ' ', 'g'))""")
_column("sanitize", "documents", "doc_id", "text", lambda c: F.md5(scalars.strip_unprintable(c).cast("binary")), r"md5(regexp_replace(text, '[^\x20-\x7E\r\t]', '', 'g'))")
_column("digits_to_x", "customer", "c_custkey", "c_name", scalars.digits_to_x, "regexp_replace(c_name, '[0-9]', 'X', 'g')")
_column("anonymize", "documents", "doc_id", "text", lambda c: F.md5(scalars.anonymize(c, "the").cast("binary")), "md5(replace(text, 'the', 'USER'))")
_column("first_number", "customer", "c_custkey", "c_name", scalars.first_number, "CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT)")
_column("hex_id", "orders", "o_orderkey", "o_custkey", scalars.hex_id, "lpad(lower(to_hex(o_custkey)), 16, '0')")
_column("perfetto_ph", "events", "event_id", "event_id", lambda c: phase_letter(c % 4 + 1), "['X', 'C', 'C', 'M'][event_id % 4 + 1]")
_column("parent_dir", "pages", "page_id", "url", scalars.parent_dir, "CASE WHEN contains(url, '/') THEN CASE WHEN regexp_replace(url, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(url, '/[^/]*$', '') END END")
_column("interval_floor", "orders", "o_orderkey", "o_orderkey", lambda c: scalars.interval_floor(c, 96), "o_orderkey // 96 * 96")


@query("split_list", "SELECT doc_id, list_aggregate(list_distinct_keep, 'string_agg', '+') AS x FROM (SELECT doc_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda y: y IS NOT NULL) AS list_distinct_keep FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda y: trim(y, ' ')), lambda y: y <> '') AS l FROM documents))")
def split_list(spark, d):
    made = F.array_join(scalars.split_list(F.col("text")), "+")
    return table(spark, d, "documents").select("doc_id", F.when(made != "", made).alias("x"))


@query("path_trie", "SELECT page_id FROM pages WHERE (url LIKE 'https://%' AND NOT (substr(url, 9, 1) = 'w')) OR url LIKE 'https://www%'")
def path_trie(spark, d):
    return table(spark, d, "pages").filter(rules.path_traced(F.col("url"), ["https://", "https://www"])).select("page_id")


_RELATIVE = ("/a/b", "c/./d", "../x//y", "./..", "/../z/", "", "p/q/../../../r")
_ABSOLUTE = ("/a/b", "/w/c/d", "/x/y", "/", "/z", "/w", "/r")


@query("absolutize", f"SELECT page_id, {list(_ABSOLUTE)}[page_id % {len(_ABSOLUTE)} + 1] || '' AS x, '/w' || page_id % 3 || '/y/' || page_id || '.log' AS own FROM pages")
def absolutize(spark, d):
    """Fixed paths, and paths made of pages' numbers."""
    path = F.element_at(F.array(*(F.lit(p) for p in _RELATIVE)), (F.col("page_id") % len(_RELATIVE) + 1).cast("int"))
    own, cwd = F.expr("concat('a', page_id, '/../y//./', page_id, '.log')"), F.concat(F.lit("/w"), (F.col("page_id") % 3).cast("string"))
    return table(spark, d, "pages").select("page_id", scalars.absolutize(path, F.lit("/w")).alias("x"), scalars.absolutize(own, cwd).alias("own"))


@query("prefix_mount", "WITH p AS (SELECT DISTINCT url AS path, length(url) % 2 AS dev FROM pages), m AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+', 0) AS point, length(url) % 2 AS mount_dev FROM pages UNION SELECT 'https:', 0 UNION SELECT 'https:', 1 UNION SELECT '/', 0) SELECT path, point AS mount FROM (SELECT path, point, row_number() OVER (PARTITION BY path ORDER BY CAST(dev = mount_dev AS INTEGER) DESC, length(point) DESC) AS n FROM p JOIN m ON point = path OR starts_with(path, point || '/') OR (point = '/' AND starts_with(path, '/'))) WHERE n = 1")
def prefix_mount(spark, d):
    dev = (F.length("path") % 2).cast("int")
    urls = table(spark, d, "pages").select(F.col("url").alias("path")).distinct().select("path", dev.alias("dev"))
    own = urls.select(F.regexp_extract("path", "^https?://[^/]+", 0).alias("point"), F.col("dev").alias("mount_dev")).distinct()
    points = own.union(spark.createDataFrame([("https:", 0), ("https:", 1), ("/", 0)], "point string, mount_dev int"))
    return joins.longest_prefix(urls, points.withColumn("ord", F.lit(0)))


def _lines(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.coalesce("text", F.lit("")).alias("value"))


@query("split_chunks", "SELECT file, line, CAST((sum(size) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) - size) // 512 AS BIGINT) AS chunk FROM (SELECT conv_id AS file, turn AS line, strlen(coalesce(text, '')) + 1 AS size FROM conversations)")
def split_chunks(spark, d):
    return utilities.split(_lines(spark, d), 512).select("file", "line", "chunk")


@query("compact_files", "SELECT conv_id AS file, turn AS line, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS part FROM conversations")
def compact_files(spark, d):
    return utilities.compact(_lines(spark, d), 2).select("file", "line", "part")


@query("event_count", "SELECT conv_id AS file, count(*) FILTER (length(coalesce(text, '')) > 8) AS events FROM conversations GROUP BY conv_id")
def event_count(spark, d):
    return utilities.event_count(_lines(spark, d))


@query("validate_lines", "SELECT event_type AS file, count(*) FILTER (length(props) > 8) AS events, count(*) FILTER (length(props) > 8 AND event_id % 5 > 0) AS good, count(*) FILTER (length(props) > 8 AND event_id % 5 = 0) AS bad FROM events GROUP BY event_type")
def validate_lines(spark, d):
    return validate.line_check(table(spark, d, "events").select(F.col("event_type").alias("file"), F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", "[}]", "]")).otherwise(F.col("props")).alias("value")))


@query("duplicates", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark, d):
    return validate.repeated(table(spark, d, "documents"), ["text"])


@query("merge_lines", "SELECT conv_id AS file, turn AS line FROM conversations WHERE regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+$', ''), ' '), ',$', '') NOT IN ('', '[', ']')")
def merge_lines(spark, d):
    lines = _lines(spark, d)
    return utilities.merge(lines.filter("line % 2 = 0"), lines.filter("line % 2 = 1")).select("file", "line")


@query("trace_index", "SELECT user_id % 8 AS file, count(*) AS events, min(event_id) AS min_id, max(event_id) AS max_id, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts FROM events GROUP BY 1")
def trace_index(spark, d):
    from tracelathe.queries.tables import trace

    return utilities.index(trace(spark, d).withColumnRenamed("pid", "file"))
