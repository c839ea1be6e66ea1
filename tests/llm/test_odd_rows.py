"""Null ids, repeated ids and repeated rows: every row has its own, right result; the pipeline's stages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from test_decontaminate import expected as contaminated_by
from tracelathe.llm import bpe, license_scan, lm_score, token_counts, token_files, toxicity
from tracelathe.llm.columns import U64

TEXTS = ["the red dog", "", None, "naïve ideas — 12.5", "the red dog", "MIT License " * 40]
ROWS = [(k, t) for t in TEXTS for k in (7, None, 7)] + [(3, "the red dog")]


def frame(spark):
    return spark.createDataFrame([(*x, 1, "c") for x in ROWS], "doc_id bigint, text string, n_tokens int, ids_sha256 string").repartition(3)


def test_op4_gives_each_row_its_ids(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(frame(spark), path).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = lambda t: library.encode_ordinary(t or "")
    assert got == Counter((d, len(ids(t)), sha(b"".join(i.to_bytes(4, "little") for i in ids(t))), sha((t or "").encode())) for d, t in ROWS)


def test_op6_places_rows_of_one_id_side_by_side(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    rows = token_files.token_file_report(frame(spark), path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(ids(t)), crc(ids(t))) for d, t in ROWS)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    named = [r.doc_id for r in ordered if r.doc_id is not None]
    assert named == sorted(named)


def test_op10_counts_each_row(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark), path, limit=4).collect())
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((d, len((t or "").encode()), size(t), size(t) > 4) for d, t in ROWS)


def test_op1_reports_each_row(spark):
    text = " ".join(f"w{i}" for i in range(80))
    templates = {"own": text}
    rows = [(5, text), (5, text), (None, text), (None, None), (6, ""), (None, "nothing here")]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, template string")
    found = license_scan.scan_licenses(docs, templates).collect()
    assert Counter(r.doc_id for r in found) == {5: 2, None: 1}


def test_op5_counts_by_hand_for_rows_of_one_id(spark):
    rows = [(d, "a b " * (k + 1)) for k, d in enumerate((1, 1, None, None, 2, 9, 9, 30, 31, 32))]
    docs = spark.createDataFrame([(*x, 0.0) for x in rows], "doc_id bigint, text string, score double")
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_score.score_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), train_share=1.0, start_steps=5).collect()
    want = Counter((d, held(d), len(t.split()) + 1, sum(counts[w] > 0 for w in [*t.split(), None]), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*t.split(), None]), 6)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_op3_fits_better_than_any_shift_of_its_thresholds():
    """The likelihood of the fitted grades, computed here, is above that of no weights and of moved thresholds."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 900)
    rows = [np.unique(np.array([10 + k if rng.random() < 0.8 else 99, *(100 + rng.integers(0, 40, 6))], U64)) for k in y]
    model = toxicity.fit(y, rows, least_docs=2)

    def loss(weights, thresholds):
        place = {int(w): x for w, x in zip(model.words, weights, strict=True)}
        s = np.array([sum(place.get(int(w), 0.0) for w in r) for r in rows])
        above = np.column_stack([np.ones(len(y)), *(1 / (1 + np.exp(t - s)) for t in thresholds), np.zeros(len(y))])
        p = above[np.arange(len(y)), y] - above[np.arange(len(y)), y + 1]
        share = np.bincount(y) / len(y)
        return -np.sum(np.log(p) * (1 / share[y]) ** 0.5)

    best = loss(model.weights, model.thresholds)
    share = 1 - np.cumsum(np.bincount(y) / len(y))[:-1]
    assert best < 0.8 * loss(model.weights * 0, np.log((1 - share) / share))
    for move in (-0.5, 0.5):
        for k in range(2):
            moved = model.thresholds.copy()
            moved[k] += move
            if moved[0] < moved[1]:
                assert best < loss(model.weights, moved)
        assert best < loss(model.weights * (1 + move), model.thresholds)


def test_near_dedup_stage_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"{rng.randrange(10**6):x}" for _ in range(400)]
    docs = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 30, 120]))]
        docs.append((3 * k, " ".join(base)))
        for c in range(rng.randint(0, 2)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((3 * k + 1 + c, (" " if c else "\n").join(copy).upper()))
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), "").collect()}
    assert left == {d for d in sets if find(d) == d}


def test_decontamination_stage_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("klmn") for _ in range(n))
    items = [(i, some(rng.choice([2, 6, 12, 13, 30]))) for i in range(30)]
    docs = []
    for d in range(150):
        piece = rng.choice(items)[1].split()
        docs.append((d, " ".join([some(rng.randint(0, 300)), *piece[: rng.randint(0, len(piece))], some(rng.randint(0, 30))])))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path)).collect()}
    verdicts = contaminated_by(docs, items)
    assert left == {d for d in verdicts if not verdicts[d][-1]} and 0 < len(left) < 150
