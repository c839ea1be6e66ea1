"""Benchmark decontamination by winnowing.

Words are the runs of letters, digits and signs outside ASCII of the text with A-Z lower-cased. Of every window
of `9` consecutive 5-gram hashes (13 words) the smallest hash is kept as a fingerprint, the last one of equal
hashes. Two texts that share 13 words share a fingerprint at the same place in them, so joining the fingerprints
of the documents with those of the benchmark misses no shared window. Each joined pair of places is extended in
both directions as far as the words agree; a run of 13 words or more is a hit. An item of fewer words is one
window; documents are winnowed once more for every such length that occurs.

If the benchmark's texts have at most `held_bytes` bytes in all, its fingerprints and words go to every task and
one pass over the documents does it all. Else the fingerprints are joined by Spark, and each document meets the texts of the
items found for it in portions of about SHELF bytes. Results are the same.

Defined cases: null or empty texts and texts without words have no words, no hits and are not contaminated; texts may be of
any length; null items, items without id and items without words have no windows; items that repeat count as often as they
have ids; an empty benchmark contaminates nothing; every row is judged by itself, also rows without id and rows that repeat
an id. Other columns of the tables are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.columns import ALNUM, LOWER, U64, by_batch, gram_hashes, only, run_hashes, text_bytes, word_runs
from tracelathe.llm.graph import cut, numbered

WINDOW = 13
GRAM = 5
HELD_BYTES = 8 << 20
SHELF = 1 << 20


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, the place of the last smallest one."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, size = grams, np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        left, right = low[:-step], low[step:]
        take = right <= left
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, right, left)
        size += step
    return at


class Words:
    """The words of a batch of texts: hashes, places in the bytes, and where each text's words begin."""

    def __init__(self, texts):
        data, at = text_bytes(texts)
        self.data = LOWER[data]
        self.begin, self.end = word_runs(self.data, at, ALNUM)
        self.hash = run_hashes(self.data, self.begin, self.end)
        self.first = np.searchsorted(self.begin, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def prints(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints for shared spans of `window` words: their places and their values."""
        gram = min(GRAM, window)
        grams = gram_hashes(self.hash, gram)
        kept = winnow(grams, window - gram + 1)
        whole = self.text[: len(kept)] == self.text[window - 1 : window - 1 + len(kept)]
        marked = np.zeros(len(grams), bool)
        marked[kept[whole]] = True
        places = np.flatnonzero(marked)
        return places, grams[places] ^ U64(window)

    def spelled(self, a: int, b: int) -> bytes:
        return b" ".join(self.data[i:j].tobytes() for i, j in zip(self.begin[a:b].tolist(), self.end[a:b].tolist(), strict=True))


class Items:
    """The windows of benchmark items, ready to be found in documents."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.ids = [ids[i] for i in order]
        self.words = Words(pa.array([texts[i] for i in order], pa.large_string()))
        sizes = np.diff(self.words.first)
        self.windows = sorted({min(int(n), WINDOW) for n in sizes if n})
        prints, places = [], []
        for w in self.windows:
            at, value = self.words.prints(w)
            size = sizes[self.words.text[at]]
            own = size >= WINDOW if w == WINDOW else size == w
            places.append(at[own])
            prints.append(value[own])
        self.prints = np.concatenate(prints) if prints else np.zeros(0, U64)
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        by = np.argsort(self.prints, kind="stable")
        self.prints, self.places = self.prints[by], self.places[by]

    def spans(self, docs: Words) -> dict[int, list[tuple[int, int, int]]]:
        """Per text of `docs`: spans (first word, past the last word, item) of agreeing words, over all its words."""
        found: dict[int, dict[tuple[int, int], int]] = {}
        out: dict[int, list[tuple[int, int, int]]] = {}
        mine = self.words
        for w in self.windows:
            at, value = docs.prints(w)
            low, high = (np.searchsorted(self.prints, value, side) for side in ("left", "right"))
            for h in np.flatnonzero(high > low).tolist():
                q = int(at[h])
                d = int(docs.text[q])
                for p in self.places[low[h] : high[h]].tolist():
                    i = int(mine.text[p])
                    if (w < WINDOW) != (mine.first[i + 1] - mine.first[i] < WINDOW):
                        continue
                    known = found.setdefault(d, {})
                    if known.get((p - q, i), -1) > q:
                        continue
                    back = min(q - int(docs.first[d]), p - int(mine.first[i]))
                    ahead = min(int(docs.first[d + 1]) - q, int(mine.first[i + 1]) - p)
                    same = docs.hash[q - back : q + ahead] == mine.hash[p - back : p + ahead]
                    differ = np.flatnonzero(~same)
                    cut = int(np.searchsorted(differ, back))
                    a = int(differ[cut - 1]) + 1 if cut else 0
                    b = int(differ[cut]) if cut < len(differ) else len(same)
                    known[p - q, i] = q - back + b
                    least = min(WINDOW, int(mine.first[i + 1] - mine.first[i]))
                    if b - a >= least and docs.spelled(q - back + a, q - back + b) == mine.spelled(p - back + a, p - back + b):
                        out.setdefault(d, []).append((q - back + a, q - back + b, self.ids[i]))
        return out


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, item_ids array<bigint>, contaminated boolean"


def _judge(ids: pa.Array, docs: Words, spans: dict[int, list[tuple[int, int, int]]], names: dict[int, list[int]] | None = None) -> pa.RecordBatch:
    words = np.diff(docs.first)
    hit, items = np.zeros(len(words), np.int64), [[] for _ in words]
    for d, own in spans.items():
        marks = np.zeros(int(words[d]), bool)
        for a, b, _ in own:
            marks[a - docs.first[d] : b - docs.first[d]] = True
        hit[d] = marks.sum()
        items[d] = sorted(names[d] if names else {i for _, _, i in own}, key=str)
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(words.astype(np.int64)), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests),
            pa.array(items, pa.list_(pa.int64())), pa.array((hit > 0) & (20 * hit >= words)),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated"],
    )


def _held(spark, items: DataFrame):
    rows = items.collect()  # at most held_bytes of text
    return spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))


def _whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    held = _held(docs.sparkSession, items)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        return _judge(batch.column(0), words, held.value.spans(words))

    return docs.mapInArrow(by_batch(work), RESULT)


def _joined(docs: DataFrame, items: DataFrame, row: str) -> DataFrame:
    """As RESULT, with the rows' numbers in front; docs: row, doc_id, text (a written table)."""
    texts = items.select("text").distinct().withColumn("of", F.monotonically_increasing_id()).transform(cut)
    named = items.join(texts, "text").select("item_id", "of").distinct()
    shelves = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHELF))

    def item_prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Items(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        ids = np.array(own.ids, np.int64)[own.words.text[own.places]]
        window = np.minimum(np.diff(own.words.first), WINDOW)[own.words.text[own.places]]
        return pa.RecordBatch.from_arrays([pa.array(own.prints.view(np.int64)), pa.array(ids), pa.array(window.astype(np.int32))], names=["print", "of", "size"])

    item_fp = texts.mapInArrow(by_batch(item_prints), "print bigint, of bigint, size int").distinct().transform(cut)
    sizes = [r["size"] for r in item_fp.select("size").distinct().collect()]  # at most 13 numbers

    def doc_prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        parts = [words.prints(w) for w in sizes]
        at = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
        value = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, U64)
        rows = batch.column(0).to_numpy()[words.text[at]]
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(rows, pa.int64())], names=["print", "at"])

    prints = docs.select(F.col(row).alias("at"), "text").mapInArrow(by_batch(doc_prints), "print bigint, at bigint").distinct()
    pairs = prints.join(item_fp.select("print", "of"), "print").select("at", "of").distinct()
    shelf = F.pmod(F.xxhash64("of"), F.lit(shelves)).alias("shelf")
    near = pairs.join(texts, "of").groupBy("at", shelf).agg(F.collect_list(F.struct("of", "text")).alias("near"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, spans, found = [], [], []
        for d, own in enumerate(batch.column(2).to_pylist()):
            hits = Items([x["of"] for x in own], [x["text"] for x in own]).spans(Words(batch.column(1).slice(d, 1))).get(0, [])
            if hits:
                rows.append(batch.column(0)[d].as_py())
                spans.append(np.array(sorted({(a, b) for a, b, _ in hits}), np.int64).tobytes())
                found.append(sorted({i for _, _, i in hits}))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["at", "spans", "found"])

    met = docs.join(near, F.col(row) == F.col("at")).select("at", "text", "near")
    hits = met.mapInArrow(by_batch(verify), "at bigint, spans binary, found array<bigint>").transform(cut)
    ids = hits.select("at", F.explode("found").alias("of")).join(named, "of").groupBy("at").agg(F.collect_set("item_id").alias("ids"))
    marks = hits.groupBy("at").agg(F.collect_list("spans").alias("spans")).join(ids, "at")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, spans = Words(batch.column(2)), {}
        for d, (own, names) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if own:
                first = int(words.first[d])
                all_spans = [x for part in own for x in np.frombuffer(part, np.int64).reshape(-1, 2).tolist()]
                spans[d] = [(a + first, b + first, None) for a, b in all_spans], names
        out = _judge(batch.column(1), words, {d: x for d, (x, _) in spans.items()}, {d: names for d, (_, names) in spans.items()})
        return pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=[row, *out.schema.names])

    whole = docs.join(marks, F.col(row) == F.col("at"), "left").select(row, "doc_id", "text", "spans", "ids")
    return whole.mapInArrow(by_batch(judge), f"`{row}` bigint, {RESULT}")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    items = only(benchmark, item_id=item_id, text=item_text).filter("text is not null and item_id is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document: words, hit words, the items found (ids as sorted strings), and the verdict."""
    docs = only(docs, doc_id=doc_id, text=text)
    items, size = _items(benchmark, item_id, item_text)
    if size <= held_bytes:
        return _whole(docs, items)
    docs, row = numbered(docs)
    return _joined(docs, items, row).drop(row)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """The rows, with all their columns, that aren't contaminated."""
    items, size = _items(benchmark, item_id, item_text)
    if size > held_bytes:
        rows, row = numbered(docs)
        named = rows.select(F.col(row), F.lit(None).cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        return rows.join(_joined(named, items, row).filter("contaminated").select(row), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
    held = _held(docs.sparkSession, items)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text))
        words = Words(texts)
        judged = _judge(pa.nulls(batch.num_rows, pa.int64()), words, held.value.spans(words))
        return batch.filter(pc.invert(judged.column(judged.schema.get_field_index("contaminated"))))

    return docs.mapInArrow(by_batch(work, text), docs.schema)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
#: The same result in DuckDB: every window of every document against every window of every item.
ORACLE = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS j FROM iw WHERE len(w) > 0) x
), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM dw, (SELECT DISTINCT k FROM windows) s WHERE len(w) >= k) x
), hits AS (SELECT doc_id, j, k, item_id FROM places JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hits) x GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) x GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
