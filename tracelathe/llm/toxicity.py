"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (runs of letters, digits and signs outside ASCII, A-Z lower-cased), by
64-bit hash. One weight per word is shared by all thresholds: P(grade >= k) = 1 / (1 + exp(theta_k - w.x)), with
theta_1 < theta_2 < ... over the grades that occur. Weights have an L1 penalty that falls with the sample's root, so that few words count, and are
fitted again with little of it on the words that it has left; words
that fewer than `least_docs` training texts hold have none. A text's severity is its expected grade, the sum of
P(grade >= k) times the steps between grades; a severity of half the first grade step or more is a rejection.

The model is fitted on at most `sample_rows` labelled documents, those with the smallest hash of their id; each
row of the table is then scored. Labels hold grades in ascending severity (0: none); of several labels of one
document the largest counts, null labels are left out. With no labels, or one grade, every severity is that
grade's (0 if there is none). Null and empty texts have no features; texts may be of any length. Rows that repeat and rows
without id are scored each; an empty table has an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.columns import ALNUM, LOWER, U64, by_batch, only, run_hashes, text_bytes, word_runs

SAMPLE_ROWS = 20_000
LEAST_DOCS = 4
PENALTY = 0.09
ROUNDS = 400


def text_features(texts, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text (of those in `keep`, sorted, if given): text numbers and hashes, by text."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    begin, end = word_runs(data, at, ALNUM)
    words = run_hashes(data, begin, end)
    doc = np.searchsorted(at, begin, "right") - 1
    if keep is not None:
        place = np.minimum(np.searchsorted(keep, words), max(0, len(keep) - 1))
        known = keep[place] == words if len(keep) else np.zeros(len(words), bool)
        words, doc = words[known], doc[known]
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], words[new]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """A fitted model: sorted word hashes, their weights, the thresholds, and the grades in ascending order."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        steps = np.diff(self.grades).astype(float)
        return (self.grades[0] if len(self.grades) else 0) + (_sigmoid(score[:, None] - self.thresholds[None, :]) * steps).sum(axis=1)

    def scores(self, texts) -> np.ndarray:
        doc, words = text_features(texts, self.words)
        return np.bincount(doc, self.weights[np.searchsorted(self.words, words)], len(texts)) if len(self.words) else np.zeros(len(texts))


def fit(grades: np.ndarray, rows: list[np.ndarray], penalty: float = PENALTY, least_docs: int = LEAST_DOCS, rounds: int = ROUNDS) -> Ordinal:
    """grades: one per text; rows: the distinct word hashes of each text."""
    levels, y = np.unique(grades, return_inverse=True)
    none = np.zeros(0)
    if len(levels) < 2:
        return Ordinal(np.zeros(0, U64), none, none, levels)
    words, column, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    often = counts >= least_docs
    place = np.cumsum(often) - 1
    used = often[column]
    row, column, words = row[used], place[column[used]], words[often]
    share = np.bincount(y) / len(y)
    importance = (1 / (len(levels) * share))[y] ** 0.5
    importance /= importance.sum()
    penalty = penalty / len(y) ** 0.5  # as the noise of mean gradients
    # theta = theta_1, then positive steps; they start where the grades' shares put them.
    above = 1 - np.cumsum(share)[:-1]
    theta = np.log((1 - above) / above)
    free = np.concatenate(([theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))))
    w, g2, f2 = np.zeros(len(words)), np.full(len(words), 1e-12), np.full(len(free), 1e-12)
    for step in range(2 * rounds):
        if step == rounds:  # the words are chosen; their weights are now fitted with little shrinkage
            chosen = w != 0
            kept, number = chosen[column], np.cumsum(chosen) - 1
            row, column, words, w, g2 = row[kept], number[column[kept]], words[chosen], w[chosen], g2[chosen]
            penalty *= 0.05
        theta = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
        s = np.bincount(row, w[column], len(y))
        upper = np.where(y > 0, _sigmoid(s - theta[np.maximum(y - 1, 0)]), 1.0)
        lower = np.where(y < len(theta), _sigmoid(s - theta[np.minimum(y, len(theta) - 1)]), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        slope = -(1 - upper - lower) * importance
        gradient = np.bincount(column, slope[row], len(words))
        at_theta = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, upper * (1 - upper) / p, 0) * importance, len(theta))
        at_theta -= np.bincount(np.minimum(y, len(theta) - 1), np.where(y < len(theta), lower * (1 - lower) / p, 0) * importance, len(theta))
        at_free = np.cumsum(at_theta[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
        g2 += gradient**2
        f2 += at_free**2
        rate = 0.5 / np.sqrt(g2)
        w -= rate * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        free -= 0.3 * at_free / np.sqrt(f2)
    theta = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
    used = w != 0
    return Ordinal(words[used], w[used], theta, levels)


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", doc_id="doc_id", text="text", sample_rows: int = SAMPLE_ROWS, **options) -> Ordinal:
    """A model from at most `sample_rows` labelled documents."""
    marks = only(labels, of=doc_id, grade=grade).filter("of is not null and grade is not null").groupBy("of").agg(F.max("grade").cast("int").alias("grade"))
    sample = marks.orderBy(F.xxhash64("of"), "of").limit(sample_rows)
    chosen = only(docs, doc_id=doc_id, text=text).join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("grade", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, words = text_features(batch.column(1))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([words[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["grade", "words"])

    rows = chosen.mapInArrow(by_batch(work), "grade int, words binary").toArrow()  # at most sample_rows texts' hashes
    found = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("words")]
    model = fit(rows.column("grade").to_numpy(), found, **options)
    del rows, found
    pa.default_memory_pool().release_unused()  # the driver goes on with other work
    return model


def score(docs: DataFrame, model: Ordinal, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade), and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    edge = float(model.grades[0] + model.grades[1]) / 2 if len(model.grades) > 1 else float("inf")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.severity(own.scores(batch.column(1))), pa.float64())], names=["doc_id", "severity"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(by_batch(work), "doc_id bigint, severity double").withColumn("rejected", F.col("severity") >= edge)


def drop_toxic(docs: DataFrame, model: Ordinal, text="text") -> DataFrame:
    """The rows, with all their columns, that aren't rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    edge = float(model.grades[0] + model.grades[1]) / 2 if len(model.grades) > 1 else float("inf")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        return batch.filter(pa.array(own.severity(own.scores(batch.column(batch.schema.get_field_index(text)))) < edge))

    return docs.mapInArrow(by_batch(work, text), docs.schema)


def rate_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on the labelled documents and scores all."""
    return score(docs, train(docs, labels, **options))
