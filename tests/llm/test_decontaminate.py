import hashlib
import random
import re

import pytest

from tracelathe.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    out = {}
    windows = []
    for i, text in items:
        w = words(text)
        windows += [(i, tuple(w))] if 0 < len(w) < 13 else [(i, tuple(w[j : j + 13])) for j in range(len(w) - 12)]
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i, x in windows:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(i)
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = lambda n, k=40: " ".join(rng.choice("abcdefghij") + rng.choice("klmné") * (rng.random() < k / 50) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 60]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "?!"), (103, items[3][1]), (104, "x " * 30)]
    docs = []
    for d in range(250):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, 5)
            parts += [", ".join(w[a : a + rng.randint(5, 40)]).upper(), some(rng.randint(0, 20))]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "..."), (903, "X x-" * 40), (904, "x " * 12), (905, docs[3][1]), (906, docs[3][1] * 50)]
    return docs, items


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_equals_brute_force(spark, rows, held):
    docs, items = rows
    frame = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string").repartition(3)
    got = find_contamination(frame, spark.createDataFrame(items, "item_id bigint, text string"), held_bytes=held).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected(docs, items)
    assert len(got) == len(docs)


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_empty_tables(spark, rows, held):
    docs = spark.createDataFrame(rows[0][:5], "doc_id bigint, text string")
    items = spark.createDataFrame(rows[1], "item_id bigint, text string")
    assert find_contamination(docs.limit(0), items, held_bytes=held).count() == 0
    assert {r.n_hit for r in find_contamination(docs, items.limit(0), held_bytes=-1 if not held else held).collect()} == {0}
