import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tracelathe.llm import lm_score
from tracelathe.llm.attention import Attention

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("symbol_of", [None, np.array([0, 1, 2, 2, 2, 3, 3, 3])])
def test_gradients_are_right(symbol_of):
    size, items = (7, 7) if symbol_of is None else (4, 8)
    net = Attention(size, width=4, window=5, symbol_of=symbol_of, shares=np.log(np.full(items, 0.2)), apart=int(symbol_of is not None), tails=3)
    rng = np.random.default_rng(0)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64) + 0.2 * rng.standard_normal(getattr(net, k).shape))
    seen, tails, wanted = rng.integers(0, items + 1, (3, 5)), rng.integers(0, 4, (3, 5)), rng.integers(0, items, (3, 5))
    _, g, rows = net.gradients(seen, tails, wanted)
    for k, (at, x) in rows.items():
        g[k] = np.zeros(getattr(net, k).shape)
        g[k][at] = x
    for k in net.NAMES:
        array = getattr(net, k)
        for at in np.ndindex(array.shape):
            was, step = array[at], 1e-3
            array[at] = was + step
            up = net.gradients(seen, tails, wanted)[0]
            array[at] = was - step
            down = net.gradients(seen, tails, wanted)[0]
            array[at] = was
            assert abs((up - down) / (2 * step) - g.get(k, np.zeros(array.shape))[at]) < 1e-4, k


def place_of(n, i, window, overlap):
    """First place and last of the window that scores place i of a sequence."""
    if n <= window or i < window:
        return 0, min(n, window)
    k = -(-(i + 1 - window) // (window - overlap))
    return min(k * (window - overlap), n - window), 0


def test_windows_score_every_place_once_and_sum_to_one():
    net = Attention(6, window=8, overlap=3)
    rng = np.random.default_rng(1)
    sizes = [0, 1, 7, 8, 9, 13, 14, 50, 0]
    at = np.cumsum([0, *sizes])
    wanted = rng.integers(0, 6, at[-1])
    seen = np.append(6, wanted[:-1])
    seen[at[:-1][np.diff(at) > 0]] = 6
    found = net.score(seen, None, wanted, at, chunk=17)
    for a, b in zip(at, at[1:]):
        for i in range(b - a):
            first, _ = place_of(b - a, i, 8, 3)
            own = seen[a + first : a + i + 1].copy()[None]
            logits = net._forward(own, None)["logits"][-1]
            p = np.exp(logits) / np.exp(logits).sum()
            assert abs(p.sum() - 1) < 1e-5 and abs(np.log(p[wanted[a + i]]) - found[a + i]) < 1e-4


def corpus():
    rng = random.Random(7)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    made = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    languages = [[made() for _ in range(80)] for _ in range(4)]
    docs = []
    for d in range(1000):
        own = languages[d % 4]
        words = ["the" if rng.random() < 0.2 else own[int(80 * rng.random() ** 2)] if rng.random() < 0.98 else made() for _ in range(rng.randint(0, 250))]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(words).capitalize()))
    return [*docs, (2000, None), (2001, ""), (2002, " \t"), (2003, "x" * 20_000), (2004, "The the " * 3000), (2005, docs[3][1]), (2006, docs[3][1])]


def by_hand(model, c, words):
    """The score of a text, token by token."""
    own = lm_score.speller(PATH)
    spelled = [[own.end] if w is None else np.frombuffer(own.spell(w.encode()), "<u4").tolist() for w in words]
    total = 0.0

    def log_p(net, items, seen, tails, wanted):
        n, out = len(wanted), 0.0
        for i in range(n):
            first, _ = place_of(n, i, net.window, net.overlap)
            s = net._forward(np.array([seen[first : i + 1]]), None if tails is None else np.array([tails[first : i + 1]]))
            logits, z, number = s["logits"][-1].astype(float), s["z"][-1].astype(float), items.number[wanted[i]]
            symbol = net.symbol_of[number]
            p = logits[symbol] - np.log(np.exp(logits).sum())
            if net.chosen[number]:
                a, b = net.first[symbol], net.first[symbol + 1]
                inner = net.inner[a:b].astype(float) @ z + net.shares[a:b]
                p += inner[number - a] - np.log(np.exp(inner).sum())
            yield p + items.inside[wanted[i]]

    firsts = [x[0] for x in spelled]
    seen = [model.context.items, *(model.first.number[x] for x in firsts[:-1])]
    tails = [len(model.context.tail) - 1, *(model.tail[x[-1]] for x in spelled[:-1])]
    for i, p in enumerate(log_p(model.context, model.first, seen, tails, firsts)):
        items = spelled[i]
        if len(items) > 1:
            rest = sum(log_p(model.spelling, model.rest, [model.rest.number[x] for x in items[:-1]], None, items[1:]))
            whole = model.firsts[items[0]]
            e = model.escape if whole else 1.0
            p += np.log((1 - e) * c[words[i]] / max(whole, 1) + e * np.exp(rest))
        mine = lm_score.OWN * i / (i + lm_score.OWN_AFTER)
        total += np.log10((1 - mine) * np.exp(p) + mine * words[:i].count(words[i]) / max(i, 1))
    return total


def test_counts_scores_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SLICE", 400_000)
    docs = corpus()
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, score int").repartition(3)
    frame = frame.select("doc_id", "text").withColumn("held", lm_score.is_held_out(F.col("doc_id")))
    learned = lm_score.learn_corpus(frame, PATH, train_share=1.0)
    model = learned[-1]
    rows = lm_score.score_slices(*learned).collect()
    assert len(rows) == len(docs) and len(learned[3]) > 3 and model.context.items > 60
    base = score = 0
    told: dict[str, float] = {}
    for k, r in enumerate(rows):
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert math.isfinite(r.score) and r.score < 0
        assert told.setdefault(str(own), r.score) == pytest.approx(r.score, rel=1e-4)
        if k % 40 == 0 or r.doc_id in (2000, 2003):
            assert by_hand(model, c, own) == pytest.approx(r.score, rel=1e-3)
        base, score = base + r.held_out * r.base_score, score + r.held_out * r.score
    assert score > base


def test_nothing_learned_and_empty_table(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    row = lm_score.score_texts(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string"), PATH).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and math.isfinite(row.score) and row.base_score == 0
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_rare_items_are_predicted_by_context():
    """600 items in the same order: what follows an item is told by it, though most items share symbols."""
    rng = np.random.default_rng(5)
    follows = rng.permutation(600)
    lists = []
    for _ in range(600):
        own = [int(rng.integers(600))]
        while len(own) < 80:
            own.append(int(follows[own[-1]]) if rng.random() < 0.9 else int(rng.integers(600)))
        lists.append(own)
    wanted, at = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    counts = np.bincount(wanted, minlength=1001)
    items = lm_score.Items(counts, counts, 160, 32)
    net = items.net()
    rows = items.number[wanted]
    seen = np.append(net.items, rows[:-1])
    seen[at[:-1]] = net.items
    net.start_pairs(seen, rows)
    net.fit(seen, None, rows, at, np.random.default_rng(1), 6e-3, steps=400)

    def score(own):
        own = items.number[np.array(own)]
        return net.score(np.append(net.items, own[:-1]), None, own, np.array([0, len(own)]))

    rare = [i for i in range(600) if (net.symbol_of[:-1] == net.symbol_of[items.number[i]]).sum() > 1]
    assert len(rare) > 300
    told = [score([i, int(follows[i])])[1] for i in rare if int(follows[i]) in rare]
    # A class of 600 items in 32 has about 14: its right class alone gives log(1/14) = -2.6 at best.
    assert np.mean(told) > -1.8
    for first in (rare[0], rare[1], 5):
        assert np.exp([score([first, i])[1] + items.inside[i] for i in range(1001)]).sum() == pytest.approx(1, abs=1e-3)


def test_words_are_spelled_as_the_library_does():
    import pyarrow as pa

    texts = ["It's don't 12ab 3.14 a b  x　 y  naïve --> ??? \U0001f600x", " ", "one\ntwo\x0bthree\x85four", "", None, "x" * 5000]
    own, speller = lm_score.Slice(pa.array(texts, pa.large_string())), lm_score.speller(PATH)
    items, at = speller.spell_all(own)
    assert len(at) == len(own.words) + 2 and items[-1] == speller.end
    for i in range(len(own.words)):
        assert items[at[i] : at[i + 1]].tolist() == np.frombuffer(speller.spell(own.word(i)), "<u4").tolist(), own.word(i)
    items, at = speller.spell_all(lm_score.Slice(pa.array([None], pa.large_string())))
    assert items.tolist() == [speller.end] and at.tolist() == [0, 1]


def test_every_learned_place_is_trained_on(monkeypatch):
    import pyarrow as pa

    own_speller = lm_score.speller(PATH)
    own = lm_score.Spelled.of(pa.array([t for _, t in corpus()[:300]], pa.large_string()), own_speller)
    learned = np.arange(len(own.at) - 1) % 7 != 2
    counts = np.bincount(own.items, minlength=own_speller.items)
    model = lm_score.Model(counts, counts, len(own.tokens), own.size, 1)
    seen = []

    def step(self, state, seen_items, tails, wanted, rate, scored_from=0):
        seen.append((self is model.context, wanted[:, scored_from:].ravel()))
        return 0.0

    monkeypatch.setattr(Attention, "step", step)
    model.fit(own, learned, np.random.default_rng(0), 1e-3, lm_score.TRAIN_SHARE)
    tokens = own.tokens[np.repeat(learned, np.diff(own.at))]
    words = [own.items[own.item_at[i] : own.item_at[i + 1]] for i in range(own.size + 1)]
    firsts = Counter(int(model.first.number[words[i][0]]) for i in tokens)
    rests = Counter(int(model.rest.number[x]) for i in np.unique(tokens) for x in words[i][1:])
    for context, wanted in ((True, firsts), (False, rests)):
        found = Counter(np.concatenate([x for c, x in seen if c is context]).tolist())
        assert not wanted - found


def test_gradients_of_the_places_that_are_learned_from():
    net = Attention(7, width=4, window=5, tails=3)
    rng = np.random.default_rng(0)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64) + 0.2 * rng.standard_normal(getattr(net, k).shape))
    seen, tails, wanted = rng.integers(0, 8, (3, 5)), rng.integers(0, 4, (3, 5)), rng.integers(0, 7, (3, 5))
    loss, g, rows = net.gradients(seen, tails, wanted, 2)
    assert loss == pytest.approx(-net.log_probabilities(seen, tails, wanted)[:, 2:].mean())
    for k, (at, x) in rows.items():
        g[k] = np.zeros(getattr(net, k).shape)
        g[k][at] = x
    for k in ("embed", "qkv", "pair", "own", "tail"):
        array = getattr(net, k)
        for at in np.ndindex(array.shape):
            was = array[at]
            array[at] = was + 1e-3
            up = net.gradients(seen, tails, wanted, 2)[0]
            array[at] = was - 1e-3
            down = net.gradients(seen, tails, wanted, 2)[0]
            array[at] = was
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4, k


def test_steps_use_their_arrays_again():
    """The moments of a step are updated where they are, not copied at every step."""
    net = Attention(6, width=4, window=5)
    seen, state = np.random.default_rng(3).integers(0, 6, (3, 5)), {}
    net.step(state, seen, None, seen, 1e-2)
    held = {k: state[k] for k in net.DENSE}
    for _ in range(3):
        net.step(state, seen, None, seen, 1e-2)
    assert all(state[k][i] is held[k][i] for k in net.DENSE for i in (0, 1))
    assert (state["head"][1] > 0).any()


def test_distinct_words_are_gathered_as_lines():
    texts = pa.array(["One two\tone \xa0x two", None, "", "caf\xe9 \U0001f600 end", " "])
    own = lm_score.Slice(texts)
    assert own.lines().split(b"\n") == [own.word(i) for i in range(len(own.words))]
    assert sorted(own.lines().decode().split("\n")) == sorted({"one", "two", "\xa0x", "caf\xe9", "\U0001f600", "end"})
    assert lm_score.Slice(pa.array(["", None], pa.string())).lines() == b""
    speller = lm_score.speller(PATH)
    items, at = speller.spell_all(own)
    assert [items[a:b].astype("<u4").tobytes() for a, b in zip(at[:-2], at[1:-1], strict=True)] == [speller.spell(own.word(i)) for i in range(len(own.words))]


def test_common_beginnings_are_worked_out_once(monkeypatch):
    """Sequences that begin alike share their places; the scores are those of each sequence by itself."""
    rng = np.random.default_rng(4)
    net = Attention(9, width=4, window=6, overlap=2, symbol_of=np.array([0, 1, 2, 3, 4, 5, 6, 6, 6, 7, 7, 8]), shares=np.log(np.full(12, 0.3)))
    for k in net.NAMES:
        setattr(net, k, getattr(net, k) + 0.3 * rng.standard_normal(getattr(net, k).shape).astype(np.float32))
    starts = [[1, 2, 3], [1, 2], [4], [8, 9, 10, 11, 3, 2], [8, 9, 10]]
    lists = [starts[int(rng.integers(5))] for _ in range(300)] + [[], [5] * 6, [5] * 20, [3, 1] * 7]
    seen, at = np.concatenate(lists).astype(np.int64), np.cumsum([0, *map(len, lists)])
    wanted = rng.integers(0, 12, len(seen))
    expected = net.score(seen, None, wanted, at)
    rows, found = [], Attention._found
    monkeypatch.setattr(Attention, "_found", lambda self, z, *more: rows.append(len(z)) or found(self, z, *more))
    assert net.score_alike(seen, wanted, at) == pytest.approx(expected, abs=1e-5)
    # 3 + 1 + 6 + 6 beginnings of short sequences; the windows of the two long ones (20 and 14 places) are scored as ever.
    assert sum(rows) <= 3 + 1 + 6 + 6 + 80 < len(seen) / 8
    assert len(net.score_alike(seen[:0], wanted[:0], np.zeros(1, np.int64))) == 0


def test_words_of_earlier_slices_are_neither_spelled_nor_scored_again(monkeypatch):
    own_speller = lm_score.Speller(PATH)
    texts = [t for _, t in corpus()[:300]] + ["Foreign\xa0words " + "x" * 300]
    batches = [pa.array(x, pa.large_string()) for x in (texts, [*texts[50:], "newer words \U0001f600", None], [])]
    fresh = [lm_score.Spelled.of(b, lm_score.Speller(PATH)) for b in batches]
    asked, spell_new = [], lm_score.Speller.spell_new
    monkeypatch.setattr(lm_score.Speller, "spell_new", lambda self, own, which: asked.append(len(which)) or spell_new(self, own, which))
    spelled = [lm_score.Spelled.of(b, own_speller) for b in batches]
    for a, b in zip(fresh, spelled, strict=True):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("at", "tokens", "items", "item_at"))
    assert asked[0] == spelled[0].size and asked[1] < 10 and asked[2] == 0  # the long word isn't kept
    counts = np.bincount(spelled[0].items, minlength=own_speller.items)
    model = lm_score.Model(counts, counts, len(spelled[0].tokens), spelled[0].size, 1)
    kept, scored, word_scores = lm_score.Kept(scores=(np.float64,)), [], lm_score.Model.word_scores
    monkeypatch.setattr(lm_score.Model, "word_scores", lambda self, items, at: scored.append(len(at) - 1) or word_scores(self, items, at))
    for own in spelled:
        assert model.kept_word_scores(own, own.hashes(), kept) == pytest.approx(word_scores(model, own.items, own.item_at), abs=1e-5)
    assert scored[0] == spelled[0].size and sum(scored[1:]) < 10


def test_words_that_need_one_row_of_what_is_kept(monkeypatch):
    monkeypatch.setattr(lm_score, "KEPT", 4)
    kept = lm_score.Kept(scores=(np.float64,))
    words = np.array([1, 5, 9, 2, 6, 3], np.uint64)
    kept.put(words, words * 10.0)
    known, scores = kept.get(words)
    assert known.sum() == 3 and (scores == words[known] * 10.0).all()
    assert not kept.get(np.array([0, 4, 8], np.uint64))[0].any()


def test_places_that_are_only_seen_do_not_look_back():
    """In a later window the first places are seen by others only: they ask for no shares."""
    net = Attention(7, width=4, window=5, tails=3)
    seen = np.random.default_rng(0).integers(0, 8, (3, 5))
    s = net._hidden(seen, seen % 3, 2)
    assert s["a"].shape == (3, 3, 5) and s["z"].shape == (9, 4)
    assert s["z"] == pytest.approx(net._hidden(seen, seen % 3)["z"].reshape(3, 5, 4)[:, 2:].reshape(-1, 4), abs=1e-5)
