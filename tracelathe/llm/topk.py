"""Exact top-k search by columnar branch and bound.

The query set is every row whose id is divisible by `every`; the candidates are all rows. Rows are packed into
blocks in vertical layout (one line per dimension), which are written once and dealt to parts of about PART_ROWS rows, 16
parts at least. Queries are packed into blocks of their own; each block of queries goes to every part, and a task that holds a
part's candidates takes the queries as they come, keeping each query's best k. So what is shuffled is the candidates once and the queries
once for each part; the parts' results, k for each query, are ranked at the end.

For a query, inner products are accumulated over one group of dimensions at a time. What the remaining dimensions
can add lies within the product of the two vectors' remaining lengths (their remaining mass), so after each group
candidates whose upper bound is below the k-th best score known, or below the k-th largest lower bound, are dropped
and the survivors are compacted. Ties at the k-th score survive, so that the smaller id can be chosen.

A part's blocks are met in order of their longest vector, and a block is passed over for a query whose bound it can't reach.

Scores are inner products of integers floor(scale * component). Vectors that are null, empty or hold a null or a
component that isn't finite take no part; vectors meet only those of their own length. A row is no candidate of its own query, by
the row and not by its id: rows that repeat an id are candidates of each other, and queries each, so their ids have several rows of each
rank. Rows with null ids take no part. An empty table has an empty result. Integer
components of up to 2**31 and lengths whose products stay below 2**53 are exact. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.llm.columns import only
from tracelathe.llm.graph import cut

BLOCK = 8192
PART_ROWS = 131_072
QUERIES = 512
GROUP = 8
PARTS = 16


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (dims, ids, rows, columns) of at most `size` vectors in vertical layout; rows: vec_id, row, values."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, numbers, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                own_values = flat[(ends[own] - n)[:, None] + np.arange(n)]
                have = held.setdefault(n, [[], [], [], 0])
                have[0].append(ids[own])
                have[1].append(numbers[own])
                have[2].append(own_values)
                have[3] += len(own)
                if have[3] >= size:
                    yield from blocks(n, held.pop(n))
        for n, have in held.items():
            yield from blocks(n, have)

    def blocks(n, have):
        ids, numbers, values = (np.concatenate(x) for x in have[:3])
        for a in range(0, len(ids), size):
            part = values[a : a + size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([ids[a : a + size].tobytes()]), pa.array([numbers[a : a + size].tobytes()]), pa.array([np.ascontiguousarray(part.T).tobytes()])],
                names=["dims", "ids", "rows", "columns"],
            )

    return rows.mapInArrow(run, "dims int, ids binary, rows binary, columns binary")


def _rests(columns: np.ndarray, group: int) -> np.ndarray:
    """Per vector the length of what is left after 0, 1, 2, ... groups of dimensions."""
    squares = (columns**2).cumsum(axis=0)
    total = squares[-1]
    return np.sqrt(np.maximum([total, *(total - squares[min(a + group, len(columns)) - 1] for a in range(0, len(columns), group))], 0))


class Best:
    """The best k of a block of queries so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.rows, self.columns, self.k = ids, rows, columns, k
        self.rest = _rests(columns, GROUP)
        self.score = [np.zeros(0) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]

    def meet(self, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        k, longest = self.k, rest[0].max()
        for q in range(len(self.ids)):
            score, query = self.score[q], self.columns[:, q]
            edge = score[-1] if len(score) == k else -np.inf
            if self.rest[0, q] * longest < edge - 1e-6 * (1 + abs(edge)):
                continue
            alive, part, total = None, columns, np.zeros(len(ids))
            for g, a in enumerate(range(0, len(columns), GROUP), 1):
                total = total + query[a : a + GROUP] @ part[a : a + GROUP]
                slack = self.rest[g, q] * (rest[g] if alive is None else rest[g, alive])
                if len(total) > k:
                    low = total - slack
                    edge = max(edge, np.partition(low, len(low) - k - 1)[len(low) - k - 1])  # the query itself may be one of the k
                good = total + slack >= edge - 1e-6 * (1 + abs(edge))
                kept = np.count_nonzero(good)
                if kept < 0.7 * len(total):
                    stay = np.flatnonzero(good)
                    alive = stay if alive is None else alive[stay]
                    total, part = total[stay], part[:, stay]
            names, own = (ids, rows) if alive is None else (ids[alive], rows[alive])
            other = (own != self.rows[q]) & (total >= edge - 1e-6 * (1 + abs(edge)))
            total, names = np.concatenate((score, total[other])), np.concatenate((self.found[q], names[other]))
            order = np.lexsort((names, -total))[:k]
            self.score[q], self.found[q] = total[order], names[order]


def top_k(rows: DataFrame, k: int, every: int, scale: float = 64.0, vec_id="vec_id", vector="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates, ties to the smaller id."""
    rows = only(rows, vec_id=vec_id, vector=vector).filter("vec_id is not null and size(vector) > 0")
    whole = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    rows = rows.select("vec_id", F.expr("transform(vector, x -> double(x))").alias("vector")).filter(f"forall(vector, x -> {whole})")
    rows = rows.select("vec_id", F.expr(f"transform(vector, x -> floor({scale}D * x))").alias("vector"))
    values = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.expr("transform(vector, x -> double(x))").alias("values"))
    values = values.transform(cut)
    size = values.count()
    parts = max(PARTS, -(-size // PART_ROWS))
    candidates = _pack(values, min(BLOCK, max(256, size // (2 * parts)))).withColumn("part", F.pmod(F.xxhash64("ids", "dims"), F.lit(parts)).cast("int"))
    queries = _pack(values.filter(f"vec_id % {every} = 0"), QUERIES).transform(cut)
    spread = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "dims", "ids", "rows", "columns")
    dealt = candidates.select("part", F.lit(0).alias("asks"), "dims", "ids", "rows", "columns").union(spread).repartition(parts, "part").sortWithinPartitions("part", "asks")

    def run(batches):
        at, held, ordered = None, {}, False
        for batch in batches:
            for part, asks, dims, ids, numbers, columns in zip(*batch.columns, strict=True):
                part, n = part.as_py(), dims.as_py()
                ids, numbers, columns = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(numbers.as_py(), np.int64), np.frombuffer(columns.as_py()).reshape(n, -1)
                if part != at:
                    at, held, ordered = part, {}, False
                if not asks.as_py():
                    held.setdefault(n, []).append((ids, numbers, columns, _rests(columns, GROUP)))
                    continue
                if not ordered:
                    for blocks in held.values():
                        blocks.sort(key=lambda x: -x[3][0].max())
                    ordered = True
                best = Best(ids, numbers, columns, k)
                for block in held.get(n, ()):
                    best.meet(*block)
                sizes = [len(x) for x in best.found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(best.ids, sizes)), pa.array(np.repeat(best.rows, sizes)), pa.array(np.concatenate(best.found)), pa.array(np.concatenate(best.score).astype(np.int64))],
                        names=["query_id", "query_row", "vec_id", "score"],
                    )

    found = dealt.mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same result in DuckDB.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
