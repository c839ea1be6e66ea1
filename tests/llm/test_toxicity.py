import random

import numpy as np

from tracelathe.llm import toxicity
from tracelathe.llm.toxicity import fit, rate_toxicity, score, text_features, train
from tracelathe.llm.columns import U64
import pyarrow as pa


def graded(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(3000)]
    rude = [[f"mild{i}" for i in range(5)], [f"bad{i}" for i in range(5)], [f"vile{i}" for i in range(5)]]
    rows = []
    for d in range(n):
        grade = rng.choice([0, 0, 0, 0, 0, 1, 2, 3])
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        for _ in range(3 if grade else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(rude[grade - 1]).upper())
        rows.append((d, " ".join(words), grade))
    return rows


def test_severity_follows_the_grades(spark):
    rows = graded(3000, 1)
    docs = spark.createDataFrame([(d, t, 0.0) for d, t, _ in rows], "doc_id bigint, text string, severity double").repartition(4)
    labels = spark.createDataFrame([(d, g) for d, _, g in rows if d < 2000] + [(1, None), (None, 3)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in rate_toxicity(docs, labels).collect()}
    assert len(got) == 3000
    held = [(g, got[d].severity, got[d].rejected) for d, _, g in rows if d >= 2000]
    means = [np.mean([s for g, s, _ in held if g == k]) for k in range(4)]
    assert means[0] < 0.25 and means[1] > 0.6 and means[1] < means[2] < means[3]
    assert np.mean([r for g, _, r in held if g == 0]) < 0.01
    assert np.mean([r for g, _, r in held if g > 0]) > 0.95


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    rows = [np.array([10 + k, 100 + rng.integers(0, 5)], U64) for k in y]
    model = fit(y, rows, least_docs=1)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert len(model.weights) == len(model.words) and (np.diff(model.words.astype(float)) > 0).all()


def test_nulls_one_grade_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "a"), (2, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.severity for r in rate_toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    rows = rate_toxicity(docs, one).collect()
    assert {r.severity for r in rows} == {1.0} and len(rows) == 5 and not any(r.rejected for r in rows)
    assert score(docs.limit(0), train(docs, none)).count() == 0


def test_features_are_distinct_words():
    doc, words = text_features(pa.array(["A a b", None, "b-c b"]))
    assert doc.tolist() == [0, 0, 2, 2] and len(set(words.tolist())) == 3


def test_severity_is_the_sum_over_thresholds(spark):
    """Every severity recomputed word by word from the model's weights and thresholds."""
    import math
    import random
    import re

    import pyarrow as pa

    rng = random.Random(8)
    mild, bad = ["meh", "boo", "hmm"], ["vile", "awful", "Ünschön"]
    plain = [f"w{i}" for i in range(40)]
    docs = []
    for d in range(400):
        grade = d % 3
        words = [rng.choice(plain) for _ in range(20)] + [rng.choice(mild) for _ in range(2 * (grade == 1))] + [rng.choice(bad) for _ in range(2 * (grade == 2))]
        rng.shuffle(words)
        docs.append((d, ", ".join(words).upper() if d % 7 == 0 else " ".join(words), grade))
    docs += [(900, None, None), (901, "", None), (902, "vile " * 5000, None), (None, "awful", None)]
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(d, g) for d, _, g in docs if g is not None], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    assert len(model.thresholds) == 2 and list(model.grades) == [0, 1, 2]
    weight = {h: w for h, w in zip(model.words.tolist(), model.weights.tolist())}
    hashes = {}

    def severity(text):
        words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")}
        for w in words:
            hashes.setdefault(w, toxicity.text_features(pa.array([w]))[1].tolist()[0])
        score = sum(weight.get(hashes[w], 0.0) for w in words)
        return sum(1 / (1 + math.exp(theta - score)) for theta in model.thresholds)

    got = toxicity.score(frame, model).collect()
    texts = {d: t for d, t, _ in docs}
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.severity - severity(texts[r.doc_id])) < 1e-9 and r.rejected == (r.severity >= 0.5)
