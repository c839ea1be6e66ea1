import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelathe.llm.token_files import pack_ids, read_token_files, token_file_report, unpack_ids, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 2, 16, 300, 50_257, 1 << 31, 1 << 60, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 5000])
def test_round_trip_of_ids(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, np.uint64, endpoint=True) >> rng.integers(0, 60, n).astype(np.uint64) * (rng.random(n) < 0.5).astype(np.uint64)
    data = pack_ids(ids)
    assert (unpack_ids(data) == ids).all() and len(unpack_ids(data)) == n
    assert (unpack_ids(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_small_ids_pack_densely():
    assert len(pack_ids(np.zeros(100_000, np.uint64))) < 10_000
    with pytest.raises(ValueError):
        unpack_ids(b"none" + bytes(40))


def some_docs():
    rng = random.Random(3)
    signs = "ab'  \n\t\r 　sdtmrevl'' 12½²é中ñ!?.́​\U0001f600\x1c\x85՘࢏"
    docs = [(3 * i % 1009, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))) for i in range(1009)]
    docs += [(2000, None), (2001, ""), (2002, "x" * 20_000), (2003, "a b\n" * 20_000), (2004, "a<|endoftext|> b<|endoftext|>"), (2005, "<|endoftext|>")]
    return docs


def test_equals_library(spark, tmp_path):
    docs = some_docs()
    frame = spark.createDataFrame([(*x, 7) for x in docs], "doc_id bigint, text string, start int").repartition(5)
    library, at, want = Tokenizer.from_file(PATH), 0, {}
    for d, text in sorted(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = token_file_report(frame, PATH).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(docs)
    write_token_files(frame, str(tmp_path / "files"), PATH, file_ids=100)
    rows = read_token_files(spark, str(tmp_path / "files")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows} == want


def test_empty_table(spark):
    assert token_file_report(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
