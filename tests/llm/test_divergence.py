import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelathe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(docs, least=10):
    docs = [(t or "", la or "", s or "") for t, la, s in docs]
    words = [(la, s, TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, la, s in docs]
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {la for la, _, _ in words}:
        df = Counter(t for la, _, w in words if la == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        by = {s: Counter() for la, s, _ in words if la == lang}
        for la, s, w in words:
            if la == lang:
                by[s].update(t for t in w if t in kept)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        whole = shares(sum(by.values(), Counter()))
        p = {s: shares(c) for s, c in by.items()}
        for s in by:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in by if o != s)
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pair, 1)}
            term = sorted((-f(p[s][t], whole[t]), t.encode(), t) for t in kept if by[s][t] and p[s][t] > whole[t])[:10]
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(term, 1)}
    return out


def rows(n=600, sources=9):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["ÀB", "Zeta", "zeta"]
    some = lambda k: " 7".join(rng.choice(vocabulary[: 10 + k % 50]) for _ in range(k))
    docs = [(some(rng.randint(0, 40)), rng.choice(["en", "de", None]), f"s{rng.choice([0, rng.randrange(sources)])}") for _ in range(n)]
    docs += [(docs[0][0], "en", f"s{i % 3}") for i in range(250)] + [(docs[1][0], "de", "s1")] * 40
    docs += [(None, "en", "quiet"), ("", "en", None), ("123 !?", "xx", "a"), ("123", "xx", "b"), ("solo", "yy", "only"), ("Long words " * 20_000, "en", "s1"), (None, None, None)]
    return docs


def collected(frame):
    return {tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize(("held", "step"), [(1 << 20, 1 << 22), (50, 40)])
def test_equals_brute_force(spark, monkeypatch, held, step):
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "STEP_ROWS", step)
    docs = rows()
    frame = spark.createDataFrame([(*x, "c", 1) for x in docs], "text string, lang string, source string, term string, value int").repartition(6)
    got = divergence.audit(frame).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == expected(docs) and len(got) == len(expected(docs))


def test_each_text_is_read_once(spark):
    docs = rows(100)
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    texts = divergence.collapsed(frame).collect()
    assert len(texts) == len({(t or "", la or "") for t, la, _ in docs})
    assert Counter({(r.text, r.lang, h.source): h.n for r in texts for h in r.held}) == Counter((t or "", la or "", s or "") for t, la, s in docs)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(10**14, 3 * 10**14, 10**6), (0, 0, 1), (5, 5, 1), (10**15, 10**15, 1), (3, 10, 0)]
    frame = spark.createDataFrame(cases, "c bigint, n bigint, v bigint").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r.p for r in frame.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else 0 for c, n, v in cases]


def test_portions_cover_everything():
    sizes = np.array([0, 5, 100, 1, 1, 0, 7])
    assert [x for a, b in divergence._portions(sizes, 6) for x in range(a, b)] == list(range(7))
    assert divergence._portions(np.zeros(0, np.int64), 6) == []
