import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from test_line_dedup import expected as lines_left
from tracelathe.llm.bpe import read_ranks

LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice("abcdefghijkl") + rng.choice("mnopqrstuv") + rng.choice("aeiou") for _ in range(n))
    docs = [(d, some(rng.randint(30, 90))) for d in range(120)]
    docs += [(d, f"{some(20)} vile awful {some(20)} vile") for d in range(200, 240)]
    docs += [(300, docs[5][1]), (301, docs[6][1] + " one two"), (302, some(40) + "\n" + docs[7][1])]
    passage = some(30)
    docs += [(400, passage + " " + some(10)), (500, None), (501, "")]
    docs = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 240)) for d in [*range(60), *range(200, 230)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "none of this")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {d: t for d, t, *_ in docs}


def test_stages_take_effect(spark, folder):
    path, texts = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            assert gone == set(range(200, 240))
        if name == "line dedup":
            want = lines_left(sorted(before.items()))
            assert after == {d: t for d, (t, n) in want.items() if t is None or n}
        if name == "near dedup":
            assert gone == {301}
        if name == "decontamination":
            assert gone == {400}


def test_run_encodes_what_is_left(spark, folder):
    path, texts = folder
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert 500 in rows and rows[500].n_tokens == 0 and not set(rows) & {300, 301, 400, *range(200, 240)}
    for d in (0, 7, 119):
        ids = LIBRARY.encode_ordinary(texts[d])
        assert rows[d].n_tokens == len(ids) and bytes(rows[d].ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_empty_table(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_takes_a_similarity_of_08(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    docs, far = [], []
    for k in range(60):
        base = own(100)
        docs += [(10 * k, f"{base} {own(11)}"), (10 * k + 1, f"{base} {own(11)}")]  # 96 of 118 shingles: 0.814
        far += [(10 * k + 2, f"{base.split(' ', 20)[-1]} {own(25)}")]  # further than 0.8 from both
    frame = spark.createDataFrame(docs + far, "doc_id bigint, text string").repartition(4)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()}
    assert left == {d for d, _ in docs if d % 10 == 0} | {d for d, _ in far}


def test_copies_with_short_lines_leave_no_stubs(spark):
    long = [" ".join(f"w{k}{i}" for i in range(12)) for k in range(5)]
    texts = ["\n".join(["A title", "", long[0], long[1]]), "\n".join(["A title", "", long[0], long[1]]), "\n".join(["Other", long[1], long[2]]), "only\nshort lines", "only\nshort lines", "", None, long[0]]
    frame = spark.createDataFrame([(d, t, len(t or "")) for d, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, frame, "").collect()}
    assert left == {0: texts[0], 2: "Other\n" + long[2], 3: texts[3], 4: texts[4], 5: "", 6: None}


def test_rows_are_judged_in_place(spark, tmp_path):
    """Null and repeated ids, clashing columns and very long texts in all filtering stages."""
    rng = random.Random(11)
    own = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    passage, a, b, c = own(40), own(50), own(60), own(70)
    long = "\n".join(own(30) for _ in range(3000))
    rows = [(1, a), (1, passage), (1, b), (None, passage + " x"), (None, a + " tail"), (None, c), (2, c + " end"), (3, c), (4, None), (4, None), (5, ""), (6, long), (6, long), (None, None)]
    extra = "component int, kept int, row int, row_ int, lines int, `rest` int, spans int, contaminated int, head int, high int"
    frame = spark.createDataFrame([(d, t, k, *range(10)) for k, (d, t) in enumerate(rows)], "doc_id bigint, text string, k int, " + extra).repartition(4)
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    left = stage["near dedup"](spark, frame, str(tmp_path))
    assert left.columns == frame.columns
    # One row stays of (0, 4), (1, 3), (5, 6, 7) and (11, 12): that with the smallest id, rows without id last.
    assert {r.k for r in left.collect()} == {0, 1, 2, 6, 8, 9, 10, 13} | ({11} & {r.k for r in left.collect()} or {12})
    for held in (1 << 20, 0):
        clean = corpus_pipeline.decontaminate.drop_contaminated(frame, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), held_bytes=held)
        assert clean.columns == frame.columns and {r.k for r in clean.collect()} == set(range(14)) - {1, 3}
    lines = stage["line dedup"](spark, frame, str(tmp_path))
    kept = {r.k: r.text for r in lines.collect()}
    assert lines.columns == frame.columns and {4, 5, 8, 9, 10, 13} <= set(kept) and kept[11] == kept[12] == long and kept[5] == c
    assert 3 in kept and 7 not in kept


def test_large_benchmarks_give_the_same_rows(spark):
    from tracelathe.llm.decontaminate import find_contamination

    words = [f"w{i}" for i in range(400)]
    docs = [(None, " ".join(words[:20])), (1, " ".join(words[5:30])), (1, " ".join(words[100:105])), (1, " ".join(words[5:30])), (None, None), (2, "w200")]
    items = [(1, " ".join(words[:60])), (2, " ".join(words[:60])), (3, "w200"), (None, " ".join(words[100:200])), (3, "w104")]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, other = (sorted(map(str, find_contamination(frame, bench, held_bytes=h).collect())) for h in (1 << 20, 0))
    assert one == other and len(one) == len(docs) and sum("contaminated=True" in x for x in one) == 5
