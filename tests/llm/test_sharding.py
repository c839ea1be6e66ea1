import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelathe.llm import sharding
from tracelathe.llm.graph import cut

M = 1 << 64


def shard(key, n):
    key, b, j = (key or 0) % M, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % M
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(500), *(x * 7919**3 for x in range(500))]
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(np.array(keys, np.int64), n).tolist() == [shard(k, n) for k in keys]


def test_only_the_necessary_fraction_moves():
    keys = np.arange(40_000)
    for n in (1, 8, 30):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert set(after[before != after]) == {n}
        assert abs(np.mean(before != after) - 1 / (n + 1)) < 0.02
        assert np.bincount(before).max() < 1.1 * len(keys) / n


def test_assign_equals_brute_force(spark):
    rows = [(i, f"text {i} é" * (i % 7), "c", "d") for i in range(-50, 400)]
    rows += [(None, "no id", "c", "d"), (None, None, "c", "d"), (7, "other", "c", "d"), (500, None, "c", "d"), (501, "", "c", "d"), (502, "long " * 200_000, "c", "d")]
    rows += [(9, "same", "c", "d")] * 300 + [(9, f"v{i}", "c", "d") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, `slot` string").repartition(7)
    got = sharding.assign(docs, 8).collect()
    facts = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard(i, 8), shard(i, 9)) for i, t, *_ in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == Counter(facts)
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in own]
        assert keys == sorted(keys)


def test_a_repeated_key_is_spread_over_tasks(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sharding, "cut", lambda rows: written.append(cut(rows)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(5)).alias("doc_id"), F.col("id").cast("string").alias("text"))
        got = sharding.assign(docs, 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r.n for r in written[1].filter("doc_id = 5").groupBy(F.shiftright("at", 33)).agg(F.count("at").alias("n")).collect()]
    assert sum(parts) == 6668 and max(parts) < 5000
    assert got.groupBy("shard").agg(F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"), F.count("slot").alias("n")).filter("last <> n - 1 or slots <> n").count() == 0


def test_empty_table_and_text_keys(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string"), 8).count() == 0
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "name string, text string")
    got = {r.doc_id: r.shard for r in sharding.assign(docs, 8, doc_id="name").collect()}
    hashes = {r.name: r.h for r in docs.select("name", F.xxhash64("name").alias("h")).collect() if r.name}
    assert got == {k: shard(h, 8) for k, h in hashes.items()} | {None: shard(0, 8)}


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("t%d", "id").alias("text"), F.lit("old").alias("SHARD"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard) for r in got.collect()) == [(i, f"t{i}", shard(i, 4)) for i in range(3000)]
    moves = {r.doc_id: (r.shard_before, r.shard_after) for r in sharding.moved(docs, 4, 6).collect()}
    assert moves == {i: (shard(i, 4), shard(i, 6)) for i in range(3000) if shard(i, 4) != shard(i, 6)} and all(b >= 4 for _, b in moves.values())
