import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelathe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            if d is not None and c:
                m = 10 + 90 * sum(c.values()) * N // L
                score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
                if score > 0:
                    scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice(["", "É", "x9", "-Z"]) * rng.randint(0, 2) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 10, 40]))) for i in range(40)] + [(100, None), (101, ""), (102, "?!"), (103, "unheard"), (None, "a b"), (5, "c d e"), (5, "a")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(400, None), (401, ""), (402, "..."), (None, "a b c"), (403, "a " * 30_000), (7, "a É b"), (7, "a É b")]
    return docs, items


def collected(frame):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize(("block", "terms_", "items_"), [(4 << 20, 1024, 1024), (150, 5, 7)])
def test_equals_brute_force(spark, rows, monkeypatch, block, terms_, items_):
    docs, items = rows
    monkeypatch.setattr(lexical, "TERMS", terms_)
    monkeypatch.setattr(lexical, "ITEMS", items_)
    frame = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id bigint, text string, item_id string, rank int").repartition(5)
    asked = spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, doc_id string")
    assert collected(lexical.search(frame, asked, 10, block_bytes=block)) == expected(docs, items)


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], docs.schema), items)):
        got = lexical.search(d, i, 10)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_lengths_beyond_64_bits():
    lengths = np.array([10**12, 5])
    assert lexical.stretched(lengths, 10**10, 10**15).tolist() == [10 + 90 * n * 10**10 // 10**15 for n in (10**12, 5)]
    assert 2**16 * 10**6 * lexical.TERMS < 2**53
