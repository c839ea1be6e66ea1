"""Ranked lexical search: every document against every item, by dense blocked multiplication.

Items are taken in blocks of about `block_bytes` of text, whatever their number; a block's distinct terms are its vocabulary. One pass
over the documents packs each batch into a tile, written once: its documents' ids, lengths and the counts of vocabulary terms. The corpus' counts
(documents, terms, documents per term) come from the tiles. A second pass turns a tile's counts into term impacts and multiplies, for
each stretch of the vocabulary, the matrix (items x terms that occur in the tile) of weights by the matrix (terms x documents) of
impacts in float64. TERMS bounds a stretch, so that every partial sum is a whole number below 2**53 and so exact:
weights are below 2**16 and impacts at most 10**6. Stretches are added up in 64-bit integers. A task keeps the best k of each item; among equal scores the smaller doc_id
wins within a tile, within a task and in the last ranking, so ties at any edge fall the same way for any tiling. No document text is shuffled:
what is shuffled is k rows for each item and task.

Null and empty texts have no terms and aren't found; items without terms have no rows. Documents without doc_id count in the statistics
but aren't ranked. Documents that repeat an id are ranked each; items that repeat an item_id are items each. Empty tables give an
empty result. Other columns are ignored, their names may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.llm.columns import ALNUM, by_batch, coded_words, only
from tracelathe.llm.graph import cut

#: Bytes of item text whose terms are one vocabulary; it bounds what is sent to every task.
BLOCK_BYTES = 4 << 20
#: Terms in a stretch of the vocabulary, and items in a matrix: 2**16 x 10**6 x TERMS is below 2**53.
TERMS = 1024
ITEMS = 1024
#: Matrices of weights that a worker keeps; others are made again for each tile.
HELD = 16
TILE = "docs bigint, terms bigint, ids binary, named binary, lengths binary, starts binary, codes binary, counts binary"


def _tiles(docs: DataFrame, held) -> DataFrame:
    """A row for each batch of documents: how many have terms and how many terms; the documents with vocabulary terms, and (code, count) of each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = held.value
        doc, own, words = coded_words(batch.column(1), ALNUM)
        lengths = np.bincount(doc, minlength=batch.num_rows)
        code = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy()[own] if len(own) else np.zeros(0, np.int32)
        met = code >= 0
        places, counts = np.unique(doc[met] * np.int64(len(vocabulary)) + code[met], return_counts=True)
        of, codes = np.divmod(places, max(1, len(vocabulary)))
        rows, starts = np.unique(of, return_index=True)
        ids = batch.column(0)
        named = ids.is_valid().to_numpy(zero_copy_only=False)[rows]
        ids = ids.fill_null(0).to_numpy()[rows]
        packed = [ids, named, lengths[rows].astype(np.int64), np.append(starts, len(codes)).astype(np.int64), codes.astype(np.int32), counts.astype(np.int64)]
        scalars = [pa.array([int(np.count_nonzero(lengths))]), pa.array([len(doc)])]
        return pa.RecordBatch.from_arrays([*scalars, *(pa.array([x.tobytes()]) for x in packed)], names=["docs", "terms", "ids", "named", "lengths", "starts", "codes", "counts"])

    return docs.mapInArrow(by_batch(work), TILE)


def _document_counts(tiles: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for codes in batch.column(0):
                total += np.bincount(np.frombuffer(codes.as_buffer(), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    rows = tiles.select("codes").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most a vocabulary
    total = np.zeros(size, np.int64)
    total[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return total


def stretched(lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * N) div L of each length n; beyond 64 bits in Python's integers."""
    if len(lengths) and 90 * int(lengths.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * n * docs // terms for n in lengths.tolist()], np.int64)
    return 10 + 90 * lengths * docs // max(1, terms)


class Items:
    """A block of items: the places of their terms in the vocabulary, with weights."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, codes: np.ndarray, weights: np.ndarray, docs: int, terms: int):
        self.rows, self.starts, self.codes, self.weights, self.docs, self.terms = rows, starts, codes, weights, docs, terms
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def matrix(self, a: int, t: int) -> np.ndarray:
        """Weights of the items from a on by the terms from t on; up to HELD of these, of 8 MB at most, are kept."""
        found = self.held.get((a, t))
        if found is None:
            b = min(a + ITEMS, len(self.rows))
            codes = self.codes[self.starts[a] : self.starts[b]]
            item = np.repeat(np.arange(b - a), np.diff(self.starts[a : b + 1]))
            own = (codes >= t) & (codes < t + TERMS)
            found = np.zeros((b - a, min(TERMS, len(self.weights) - t)))
            found[item[own], codes[own] - t] = self.weights[codes[own]]
            if len(self.held) < HELD:
                self.held[a, t] = found
        return found

    def scores(self, a: int, lengths: np.ndarray, starts: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Items from a on x documents, exact."""
        doc = np.repeat(np.arange(len(lengths)), np.diff(starts))
        impact = 1_000_000_000 * counts // (1000 * counts + 8 * stretched(lengths, self.docs, self.terms)[doc])
        total = np.zeros((min(ITEMS, len(self.rows) - a), len(lengths)), np.int64)
        for t in np.unique(codes // TERMS).tolist():
            own = codes // TERMS == t
            present, column = np.unique(codes[own] - t * TERMS, return_inverse=True)
            dense = np.zeros((len(present), len(lengths)))
            dense[column, doc[own]] = impact[own]
            total += (self.matrix(a, t * TERMS)[:, present] @ dense).astype(np.int64)
        return total


class Best:
    """The k best documents so far of `n` items, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge, self.edge_id = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).min)

    def meet(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: items from `first` on x documents."""
        edge, edge_id = (x[first : first + len(scores), None] for x in (self.edge, self.edge_id))
        item, column = np.nonzero((scores > edge) | ((scores == edge) & (ids[None, :] < edge_id)))
        if not len(item):
            return
        of = np.concatenate((self.item, item + first))
        score, name = np.concatenate((self.score, scores[item, column])), np.concatenate((self.id, ids[column]))
        order = np.lexsort((name, -score, of))
        of, score, name = of[order], score[order], name[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        self.item, self.score, self.id = of[keep], score[keep], name[keep]
        full = place[keep] == self.k - 1
        self.edge[self.item[full]], self.edge_id[self.item[full]] = self.score[full], self.id[full]


def _search(tiles: DataFrame, held, k: int) -> DataFrame:
    """(item_row, doc_id, score): each task's k best of each item."""

    def run(batches):
        items = held.value
        best = Best(len(items.rows), k)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                ids, named, lengths, starts, codes, counts = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, bool, np.int64, np.int64, np.int32, np.int64), strict=True))
                if not named.any():
                    continue
                for a in range(0, len(items.rows), ITEMS):
                    best.meet(a, items.scores(a, lengths, starts, codes, counts)[:, named], ids[named])
        if len(best.item):
            yield pa.RecordBatch.from_arrays([pa.array(items.rows[best.item]), pa.array(best.id), pa.array(best.score)], names=["item_row", "doc_id", "score"])

    return tiles.select("ids", "named", "lengths", "starts", "codes", "counts").mapInArrow(run, "item_row bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    docs = only(docs, doc_id=doc_id, text=text)
    items = cut(only(items, item_id=item_id, text=item_text).withColumn("item_row", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = []
    for block in range(blocks):
        own = items.filter("text is not null").filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).select("item_row", "text").toArrow()  # about block_bytes
        item, code, vocabulary = coded_words(own.column(1), ALNUM)
        if not len(vocabulary):
            continue
        words = vocabulary.cast(pa.string())
        tiles = _tiles(docs, spark.sparkContext.broadcast(words)).transform(cut)
        n_docs, n_terms = tiles.agg(F.sum("docs"), F.sum("terms")).first()
        if not n_docs:
            continue
        in_docs = _document_counts(tiles, len(words))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in in_docs.tolist()], float)
        places = np.unique(item * np.int64(len(words)) + code)
        of, codes = np.divmod(places, len(words))
        rows, starts = np.unique(of, return_index=True)
        numbers = own.column(0).to_numpy()[rows]
        bag = Items(numbers, np.append(starts, len(codes)), codes, weights, n_docs, n_terms)
        best = _ranked(_search(tiles, spark.sparkContext.broadcast(bag), k), k)
        found.append(best if blocks == 1 else cut(best))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).filter("false")
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.union(more)
    return ranked.join(items.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: The same result in DuckDB.
ORACLE = f"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, unnest({_TERMS.format("text")}) AS term FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS.format("text")}) AS terms FROM benchmark),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
sizes AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY d),
total AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS terms FROM sizes),
held AS (SELECT d, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term),
scored AS (
  SELECT i, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (d), total
  WHERE doc_id IS NOT NULL GROUP BY i, item_id, d, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
