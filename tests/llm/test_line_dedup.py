import random
import re

from tracelathe.llm import line_dedup
from tracelathe.llm.line_dedup import dedup_lines


def expected(docs):
    lines = []
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            lines.append((d, i, line, tuple(x for x in re.split("[\t-\r ]+", line.lower()) if x)))

    def apart(x, y):
        if x == y:
            return True
        if min(len(x), len(y)) < 10 or abs(len(x) - len(y)) > 1:
            return False
        short, long = sorted((x, y), key=len)
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {}
    for d, text in docs:
        kept = [w for (e, i, w, x) in lines if e == d and (len(x) < 5 or not any((f, j) < (d, i) and apart(x, y) for f, j, _, y in lines if len(y) >= 5))]
        out[d] = ("\n".join(kept) if text is not None else None, len(kept) if text is not None else 0)
    return out


def corpus():
    rng = random.Random(4)
    some = lambda n: [rng.choice("abcdefgh") + rng.choice("ijklmn") for _ in range(n)]
    bases = [some(rng.choice([0, 1, 4, 5, 9, 10, 11, 12, 20, 45])) for _ in range(40)]
    docs = []
    for _ in range(90):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(bases)) if rng.random() < 0.7 else some(12)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randint(0, len(w))
                kind = rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 1 else some(1)
            line = rng.choice([" ", "  ", "\t"]).join(w)
            lines.append(line.upper() if rng.random() < 0.1 else line)
        docs.append("\n".join(lines))
    docs += [None, "", "\n\n", " ".join(["long", "line"] * 4000), " ".join(["long", "line"] * 4000 + ["more"]), docs[0], docs[0]]
    return [(2 * i, t) for i, t in enumerate(docs)]


def test_equals_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id bigint, text string, pos string, n_kept int").repartition(4)
    rows = dedup_lines(frame).collect()
    assert {r.doc_id: (r.text, r.n_kept) for r in rows} == expected(docs)
    assert len(rows) == len(docs) and rows[0].pos == "x"


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_plan_has_no_python(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_ids_null_ids_and_clashing_columns(spark):
    long = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(5)]
    docs = [(1, long[0] + "\nshort", 0), (1, long[0] + "\nshort", 1), (1, long[0] + "\n" + long[1], 2), (2, long[1], 3), (None, long[0], 4), (3, long[2] + " more", 5), (4, long[2], 6)]
    names = ("rest", "kept", "lines", "long", "places", "stay", "mark", "_kept", "_of", "of_doc_id", "n_long", "of_mark", "pos")
    frame = spark.createDataFrame([(*x, *range(len(names))) for x in docs], "doc_id bigint, text string, k int, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    rows = {r.k: r for r in dedup_lines(frame).collect()}
    # Documents of one id stand in an order by their texts' hashes; of equal lines in them one stays.
    assert rows[0].text == rows[1].text and {rows[0].text, rows[2].text} in ({docs[0][1], long[1]}, {"short", docs[2][1]})
    assert [rows[k].text for k in range(3, 7)] == ["", long[0], docs[5][1], ""]
    assert rows[0].rest == 0 and rows[0].n_long == 1 and rows[0].pos == len(names) - 1
    left = line_dedup.drop_repeated(frame)
    assert left.columns == frame.columns and {r.k for r in left.collect()} in ({0, 1, 2, 4, 5}, {2, 4, 5}) and {r.n_long for r in left.collect()} == {10}


def test_documents_of_many_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD_BYTES", 0)
    many = "\n".join(f"line {k % 3000} of a long text" if k % 5 else "-" for k in range(20_000))
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(1, many), (2, many)], "doc_id bigint, text string")).collect()}
    assert rows[1].n_lines == rows[2].n_lines == 20_000 and (rows[1].n_kept, rows[1].n_long_kept) == (4000 + 2400, 2400) and rows[2].n_kept == 4000


def test_bounds_of_one_and_two_words(spark):
    docs = [(1, "one two three\none two four\n\nalone"), (2, "alone\none three\nother words here\nTwo three")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), 1, 2).collect()}
    assert got == {1: "one two three\n\nalone", 2: "other words here"}
