"""Sharding by jump consistent hashing.

A row's stable key and the number of shards decide its shard; there is no ring or table of shards. With one more shard, about
one row in n + 1 moves, and only into the new shard (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm").
Integral keys are used as they are, modulo 2**64; others by their xxhash64. Rows with a null key go where key 0 goes.

Slots number a shard's rows without gaps, in the order of key, checksum and size. Rows are sorted once, by ranges of (shard,
key, checksum, size, row), so rows that repeat a key, even a third of all, are spread over tasks; a table of what each task has of each
shard (tasks + shards rows at most, as the rows are in the order of shards) gives the slot at which each task begins. Rows equal in
all three columns have slots in any order, so their results are the same.

Null and empty texts have size 1 and checksum 0. Empty tables give empty results. Other columns are ignored by `assign` and kept by
`write_shards`; their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from tracelathe.llm.columns import only
from tracelathe.llm.graph import cut

#: Fixed value: the multiplier of the published generator.
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key: each step draws the next number of shards at which the key would move."""
    key, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    alive, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(alive):
        shard[alive] = at
        key = key * np.uint64(STEP) + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        stay = at < shards
        alive, key, at = alive[stay], key[stay], at[stay]
    return shard


def stable_key(rows: DataFrame, key: str) -> Column:
    """A column's 64 bits that decide the shard."""
    own = F.col(f"`{key}`")
    bits = own.cast("bigint") if isinstance(rows.schema[key].dataType, IntegralType) else F.xxhash64(own.cast("string"))
    return F.when(own.isNotNull(), bits).otherwise(F.lit(0))


def _dealt(rows: DataFrame, key: Column, counts: dict[str, int]) -> DataFrame:
    """Adds for each name the shard among so many shards."""
    names = list(counts)

    def run(batches):
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            found = [pa.array(jump(keys, n).astype(np.int32)) for n in counts.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], *names])

    slim = rows.withColumn("_stable_key", key)
    return slim.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{x}` int" for x in names)]))


def assign(docs: DataFrame, shards: int, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    whole = F.coalesce("text", F.lit(""))
    slim = only(docs, doc_id=doc_id, text=text).select("doc_id", (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    dealt = _dealt(slim, stable_key(slim, "doc_id"), {"shard": shards, "grown_shard": shards + 1}).transform(cut)
    order = ("shard", "doc_id", "text_crc32", "size", "row")
    placed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).transform(cut)
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("shard", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    found = placed.withColumn("part", part).join(F.broadcast(starts), ["shard", "part"])  # at most tasks + shards rows
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")


def moved(docs: DataFrame, before: int, after: int, doc_id="doc_id") -> DataFrame:
    """(doc_id, shard_before, shard_after) of the rows that a change of the number of shards moves."""
    keys = only(docs, doc_id=doc_id)
    return _dealt(keys, stable_key(keys, "doc_id"), {"shard_before": before, "shard_after": after}).filter("shard_before <> shard_after")


def write_shards(docs: DataFrame, path: str, shards: int, doc_id="doc_id", text="text", column: str = "shard") -> None:
    """Writes whole rows as Parquet, a folder `<column>=k` per shard, in files sorted by id; many tasks write one shard's files.

    A column of the rows that has the folder column's name, in any case, is replaced.
    """
    rest = docs.drop(*(c for c in docs.columns if c.lower() == column.lower()))
    of = _shard_column(stable_key(rest, doc_id), shards)
    order = (F.col(column), F.col(f"`{doc_id}`"), F.xxhash64(f"`{text}`"), F.rand(1))
    rest.withColumn(column, of).repartitionByRange(*order).sortWithinPartitions(column, f"`{doc_id}`").write.partitionBy(column).parquet(path)


def _shard_column(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(keys):
        return keys.__class__(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return of(key)


#: The same result in DuckDB; `tab` holds the checksum's 256 steps, made from its polynomial.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT n, n AS c, 0 AS k FROM range(256) r(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
walk AS (
  SELECT doc_id, ((CAST(coalesce(doc_id, 0) AS HUGEINT) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS key, 0::BIGINT AS b
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, key, b FROM (
    SELECT doc_id, key, CAST(floor((b + 1) * (2147483648.0::DOUBLE / CAST(key // 8589934592 + 1 AS DOUBLE))) AS BIGINT) AS b
    FROM (SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, b FROM walk)
  ) WHERE b < 9
), dealt AS (
  SELECT doc_id, max(b) FILTER (b < 8) AS shard, max(b) AS grown_shard FROM walk GROUP BY doc_id
), rows AS (
  SELECT d.doc_id, strlen(coalesce(text, '')) + 1 AS size, shard, grown_shard,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM tab, documents d JOIN dealt e ON d.doc_id IS NOT DISTINCT FROM e.doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM rows
"""
