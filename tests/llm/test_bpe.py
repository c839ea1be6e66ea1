import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tracelathe.llm.bpe import Encoder, decode_documents, encode_documents, heap_merge, read_ranks, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def some_texts():
    rng = random.Random(1)
    signs = "ab'  \n\t\r 　sdtmrevl'' 12½²é中文ñ!?.́​\U0001f600\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return [*texts, None, "", " ", "x" * 30_000, "a b " * 20_000, "we're, they'll 'sx 're <|endoftext|>", texts[5]]


def test_equals_library(spark, library):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens bigint").repartition(3)
    rows = round_trip_digests(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_perfect_hash_is_minimal():
    e = Encoder(PATH)
    words = list(e.ranks)
    assert e.table.find(words).tolist() == list(e.ranks.values())
    assert sorted(e.table.value.tolist()) == sorted(e.ranks.values())
    assert (e.table.find([b"no such word %d" % i for i in range(2000)]) == -1).all()


def test_heap_merges_by_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert heap_merge(b"abcbc", ranks) == [258, 257]
    assert base64.b64encode(b"") == b""


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert round_trip_digests(empty, PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, ids string")
    row = decode_documents(encode_documents(docs, PATH), PATH).first()
    assert row.text == "a b" and bytes(row.decoded) == b"a b" and row.n_tokens == 2
