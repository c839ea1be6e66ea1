import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelathe.llm.token_counts import PrefixCounter, count_tokens, prefix_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def some_texts():
    rng = random.Random(6)
    signs = "abe'  \n\t　sdtmrevlnio'' 12½²é中ñ!?.́​\U0001f600\x1cÀÉΣßİ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(700)]
    words = "the internationalisation of tokenization can't we'll they're THEY'VE éléphants unbelievable 2024 antidisestablishmentarianism ꙮ".split()
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*texts, None, "", " ", "x" * 20_000, "ab " * 5000, "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "a <|startoftext|> the " * 3, "<|ENDOFTEXT|>"]


def test_counts_equal_library(spark, library):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string").repartition(4)
    rows = count_tokens(docs, PATH, limit=20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = size(library, texts[r.doc_id] or "")
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 20), texts[r.doc_id]


def test_runs_of_one_sign(library):
    """Of equal merges in a run the left one comes first."""
    signs = "hoprsz-)~—=!é"
    texts = [a + c * n + b for c in signs for n in range(1, 12) for a in ("", "r", "s", "-") for b in ("", "b", "g", ">", "/")]
    own = PrefixCounter(PATH)
    assert [n for n, _ in own.answer(texts, 20)] == [size(library, x) for x in texts]


def test_every_prefix(spark, library):
    texts = [x for x in some_texts() if x is None or len(x) < 200 and "|" not in x]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in prefix_tables(docs, PATH).collect():
        text = library.normalizer.normalize_str(texts[r.doc_id] or "")
        assert len(r.counts) == len(text) + 1
        for k in range(len(text) + 1):
            if library.normalizer.normalize_str(text[:k]) == text[:k]:
                assert r.counts[k] == size(library, text[:k]), (text, k)


def test_cut_is_the_longest_prefix(library):
    own = PrefixCounter(PATH)
    for text in some_texts()[600:760]:
        text = own.normalize(text or "")
        if "|" not in text:
            table = own.prefix_table(text)
            for limit in (0, 1, 5, 12):
                (n, cut), = own.answer([text], limit)
                assert n == table[-1]
                below = np.flatnonzero(table <= limit)
                assert cut == below[-1] or table[cut] <= limit


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_only_cut_words_get_prefix_tables(library, monkeypatch):
    """Whole words are counted without the ends of their prefixes; a word that a budget cuts has them all."""
    own, asked = PrefixCounter(PATH), []
    prefixes = own.prefixes
    monkeypatch.setattr(own, "prefixes", lambda word: asked.append(word) or prefixes(word))
    texts = ["the antidisestablishmentarianism of éléphants", "we'll go"]
    assert own.answer(texts, 3) == [(size(library, x), max(k for k in range(len(x) + 1) if size(library, x[:k]) <= 3)) for x in texts]
    assert asked == ["antidisestablishmentarianism"]


def test_totals_are_those_of_the_longest_prefixes():
    own, rng = PrefixCounter(PATH), random.Random(2)
    words = list({"".join(rng.choice("abertionsé中'-~") for _ in range(rng.randint(1, 14))) for _ in range(3000)})
    words += ["tion", "tiontion", "tiontionti", "t", "'re", "'ll", "h" * 3000]
    assert own.totals(words) == [own.prefixes(w)[-4:] for w in words]
    assert own.totals(words) == own.totals(words[::-1])[::-1]


def test_normalized_as_the_library_does(library):
    own, rng = PrefixCounter(PATH), random.Random(4)
    signs = [*map(chr, range(128)), *"\x85\xa0   　̧́ͅéÀΣςİﬁ가가中\U0001f600Åक़"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert own.normalize(text) == library.normalizer.normalize_str(text), ascii(text)
    asked = []
    own.library = lambda text: asked.append(text) or library.normalizer.normalize_str(text)
    own.runs.clear()
    assert own.normalize("Plain  TEXT\n") == "plain text "
    assert own.normalize("CAFÉ ole") == "caf\xe9 ole" and asked == ["É"]
