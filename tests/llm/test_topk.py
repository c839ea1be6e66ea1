import math

import numpy as np

from tracelathe.llm import topk


def expected(rows, k, every):
    rows = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(v) == len(w))[:k]
            out |= {(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.12, (900, 24)).astype(np.float32)
    base[300:500] = base[5]
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(1000 + i, rng.normal(0, 1, 5).tolist()) for i in range(15)]
    rows += [(2000, None), (2020, []), (2040, [None] * 24), (2060, [float("nan")] * 24), (2080, [float("inf")] + [0.0] * 23), (None, [0.1] * 24), (2100, [1.0] * 3)]
    frame = spark.createDataFrame([(*x, "c") for x in rows], "vec_id bigint, embedding array<float>, score string").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = expected(rows, 20, 20)
    for block, queries in ((8192, 512), (64, 7)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", queries)
        got = topk.top_k(frame, 20, 20).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), 20, 20).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=3, every=20).collect()
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(rows) if c != q and len(v) == len(w))[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    got = topk.top_k(spark.createDataFrame([(0, [2.0]), (0, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<float>"), 20, 20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, 8192), (0, 1, 0, 8192), (0, 2, 1, 4096), (0, 2, 1, 8192)]
