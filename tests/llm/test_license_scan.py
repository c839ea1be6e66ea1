import random

import pyarrow as pa

from tracelathe.llm.license_scan import COVER, DENSE, TEMPLATES, Templates, _hashes, best, patience, scan_licenses


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def every_window(text):
    """The same matches without choosing words or documents: a window for every place of every template word."""
    own = Templates(TEMPLATES, COVER, DENSE)
    words = _hashes(pa.array([text]))[0].tolist()
    found = []
    for t, template in enumerate(own.words):
        spare = len(template) // 4 + 3
        windows = {(max(0, p - i - spare), min(len(words), p - i + len(template) + spare)) for i, w in enumerate(template) for p, x in enumerate(words) if w == x}
        found += own.matches(t, windows, words)
    return best(found)


def some_docs():
    rng = random.Random(2)
    vocabulary = "the of under work free copy any this license software be to".split()
    some = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.3 else rng.choice("abcdefgh") + rng.choice("ijk") for _ in range(n))
    docs = [(0, None, []), (1, "", []), (2, "?!", []), (3, "All rights reserved. " * 3, ["all-rights-reserved"] * 3)]
    for d in range(4, 160):
        parts, names = [some(rng.randint(0, 40))], []
        for _ in range(rng.choice([0, 0, 1, 2])):
            name = rng.choice(list(TEMPLATES))
            words = TEMPLATES[name].split()
            for _ in range(len(words) // 12):
                words[rng.randrange(len(words))] = rng.choice(["zzz", "zzz yyy"])
            parts += [" ".join(words).upper() if rng.random() < 0.3 else "\n".join(words), "qq " * 30 + some(rng.randint(0, 40))]
            names.append(name)
        docs.append((d, " ".join(parts), names))
    docs.append((500, "qq " * 60_000 + TEMPLATES["mit-text"] + " qq" * 10, ["mit-text"]))
    return docs


def test_finds_what_was_planted_and_equals_every_window(spark):
    docs = some_docs()
    rows = scan_licenses(spark.createDataFrame([(d, t, "c") for d, t, _ in docs], "doc_id bigint, text string, license string").repartition(3)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.first_word)):
        found.setdefault(r.doc_id, []).append((r.n_matched, r.coverage, r.first_word, r.last_word, r.license))
    planted = sum(len(names) for _, _, names in docs)
    caught = sum(min(len(names), sum(m[4] in names for m in found.get(d, ()))) for d, _, names in docs)
    assert caught >= 0.97 * planted
    for d, text, _ in docs:
        if d < 100:
            assert found.get(d, []) == every_window(text), d


def test_patience_matches_in_order_and_nearly_as_much_as_possible():
    got = most = 0
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randrange(60))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        got, most = got + len(pairs), most + longest_common(a, b)
    assert got >= 0.9 * most
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and patience([], [1]) == []


def test_empty_table_and_templates(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id bigint, text string")
    assert scan_licenses(docs.limit(0)).count() == 0
    assert scan_licenses(docs, {"none": " . "}).count() == 0
    row = scan_licenses(docs).first()
    assert (row.license, row.first_word, row.last_word, row.coverage) == ("mit", 0, 4, 1.0)


def test_foreign_words_inside_a_template(spark):
    """As many as the density allows in one place, wherever that is, and a few more than that."""
    words = [f"w{i}x" for i in range(100)]
    docs, k = [], 0
    for n, found in ((30, True), (50, True), (66, True), (67, False)):
        for at in (10, 50, 90):
            docs.append((k, " ".join(["qq"] * 40 + words[:at] + ["zz"] * n + words[at:] + ["qq"] * 40), found, n, at))
            k += 1
    rows = scan_licenses(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string"), {"long": " ".join(words)}).collect()
    got = {r.doc_id: (r.first_word, r.last_word, r.n_matched) for r in rows}
    for d, _, found, n, at in docs:
        if found:
            assert got[d] == (40, 139 + n, 100), (n, at)
        elif at == 50:
            assert got[d][2] < 100 if d in got else True
        else:
            assert got[d][2] == 90, (n, at)
