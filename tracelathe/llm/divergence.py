"""Source divergence audit: how far the sources of each language differ in their use of words, and by which words.

Identical texts of a language are one row with what each source holds of it (how often); each is read once for its terms, and its
counts are added with those multiplicities. So a text copied a million times costs one tokenization, and copies meet in partial sums
before any shuffle, by a digest of the text. Term counts are summed per (lang, source, term), then per (lang, term); every later step
works on these sums.

Pairs of sources are evaluated sparsely. With p0 the smoothed share of a term that a source never uses, the sum over all kept
terms of f(p, q) is V f(p0, q0), and for each source the terms that it does use against the other's q0 (grouped by equal p), and for
terms that both use a correction. Corrections are added up in each task, so a term of all sources makes no rows of pairs. The
result itself has a row for each pair of sources of a language.

Null text, lang and source are read as ''. Groups without terms take part with counts of 0; languages without kept terms have
values of 0 in `pair` and no rows in `term`. Arithmetic is in 64-bit integers: shares are divided in three steps of three
digits, so counts of up to 9 * 10**15 per group are exact. Empty tables give an empty result. Other columns are ignored, their
names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.llm.columns import LETTERS, coded_words, only, pieces
from tracelathe.llm.graph import cut

#: Rows that a task adds up before it hands sums on.
HELD_ROWS = 1 << 20
#: Entries of one step of an expansion.
STEP_ROWS = 1 << 22


def collapsed(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """(lang, text, held): each distinct text of a language once, with the sources that hold it and how often."""
    rows = only(docs, text=text, lang=lang, source=source).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    counts = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("held"))
    return texts.join(held, ["lang", "digest"]).select("lang", "text", "held")


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return sums.rename_columns({"count_sum": "count", "docs_sum": "docs"}).select(["lang", "source", "term", "count", "docs"])


def _weighted(batch: pa.RecordBatch):
    """Tables (lang, source, term, count, docs) of a batch of (lang, text, held); the empty term counts the documents of a group."""
    lang, held = batch.column(0), batch.column(2)
    owner = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
    flat = held.flatten()
    source, times = flat.field(0), flat.field(1).to_numpy()
    langs = lang.take(pa.array(owner))
    yield pa.table({"lang": langs, "source": source, "term": pa.array([""] * len(owner)), "count": np.zeros(len(owner), np.int64), "docs": times})
    doc, code, words = coded_words(batch.column(1), LETTERS)
    words = words.cast(pa.string())
    size = max(1, len(words))
    places, tf = np.unique(doc * np.int64(size) + code, return_counts=True)
    of, codes = np.divmod(places, size)
    starts = np.searchsorted(of, np.arange(batch.num_rows + 1))
    group = langs.dictionary_encode().indices.to_numpy().astype(np.int64) * (len(source) + 1) + source.dictionary_encode().indices.to_numpy()
    groups, example, group = np.unique(group, return_index=True, return_inverse=True)
    for a, b in _portions(starts[owner + 1] - starts[owner], STEP_ROWS):
        many = starts[owner[a:b] + 1] - starts[owner[a:b]]
        held_by = np.repeat(np.arange(a, b), many)
        entry = np.arange(len(held_by)) - np.repeat(np.cumsum(many) - many, many) + starts[owner[held_by]]
        keys, inverse = np.unique(codes[entry] * len(groups) + group[held_by], return_inverse=True)  # a term's groups stand together
        count, docs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(count, inverse, tf[entry] * times[held_by])
        np.add.at(docs, inverse, times[held_by])
        c, g = np.divmod(keys, len(groups))
        first = pa.array(example[g])
        yield pa.table({"lang": langs.take(first), "source": source.take(first), "term": words.take(pa.array(c)), "count": count, "docs": docs})


def _portions(sizes: np.ndarray, limit: int):
    """Stretches (a, b) whose sizes add up to about `limit`, one entry at least."""
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, docs, held): what each language's documents hold of a term, in all and by source; the empty term stands for the documents themselves."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                for table in _weighted(piece):
                    held.append(table)
                    rows += len(table)
                if rows > HELD_ROWS:
                    held = [_merged(held)]
                    rows = len(held[0])
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(max_chunksize=1 << 16)

    sums = texts.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")
    # One exchange serves both sums; of a term it gets a row for each source and task at most a few times.
    sums = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("held"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kinds)), three digits at a time; 0 where there are no kinds."""
    by = total + 2 * kinds
    rest, digits = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        digits = digits * 1000 + F.call_function("div", rest * 1000, by)
        rest = (rest * 1000) % by
    return F.when(kinds > 0, digits + 1).otherwise(F.lit(0))


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); 0 where both are 0."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("bigint"))


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): per pair of sources, for the terms that both use, what the sums against p0 get wrong; rows: lang, held (source, p, p0)."""

    def run(batches):
        names: dict[tuple[str, str], int] = {}
        keys, values, held = [], [], 0

        def compact():
            if not keys:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, inverse, np.concatenate(values))
            return known, total

        def rows(known, total):
            back = list(names)
            a, b = (known >> 31).tolist(), (known & 0x7FFFFFFF).tolist()
            columns = [pa.array([back[x][0] for x in a], pa.string()), pa.array([back[x][1] for x in a], pa.string()), pa.array([back[x][1] for x in b], pa.string()), pa.array(total)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

        for batch in batches:
            lists = batch.column(1)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), sizes)
            pairs = zip(batch.column(0).take(pa.array(of)).to_pylist(), flat.field(0).to_pylist(), strict=True)
            name = np.fromiter((names.setdefault(x, len(names)) for x in pairs), np.int64, len(of))
            p, p0 = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes[sizes > 1]).tolist():
                own = starts[sizes == n]
                for a in range(0, len(own), max(1, STEP_ROWS // n)):
                    at = own[a : a + max(1, STEP_ROWS // n), None] + np.arange(n)[None, :]
                    for d in range(1, n):
                        x, y = at[:, :-d].ravel(), at[:, d:].ravel()
                        value = _spread(p[x], p[y]) - _spread(p[x], p0[y]) - _spread(p0[x], p[y]) + _spread(p0[x], p0[y])
                        keys.append(np.minimum(name[x], name[y]) << 31 | np.maximum(name[x], name[y]))
                        values.append(value)
                        held += len(x)
                        if held > STEP_ROWS:
                            known, total = compact()
                            keys, values, held = [known], [total], len(known)
                            if held > STEP_ROWS // 2:
                                yield rows(known, total)
                                keys, values, held = [], [], 0
        known, total = compact()
        if len(known):
            yield rows(known, total)

    return terms.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other of its language (`pair`), and the terms that it uses more than its language does (`term`)."""
    counted = term_counts(collapsed(docs, **columns)).transform(cut)
    kept = counted.filter("term <> ''").filter(F.col("docs") >= least_docs)
    groups = counted.filter("term = ''").select("lang", F.explode("held.source").alias("source"))
    uses = kept.select("lang", F.explode("held").alias("of")).groupBy("lang", "of.source").agg(F.sum("of.count").alias("n"), F.count(F.lit(1)).alias("used"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.expr("aggregate(held, 0L, (a, x) -> a + x.count)")).alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    stats = groups.join(uses, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", *(zero(c) for c in ("n", "used", "v", "lang_n")))
    stats = stats.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("n"), F.col("v"))).transform(cut)
    # Every use of a kept term, with the source's share of it (p) and the language's (q).
    entries = kept.select("lang", "term", F.expr("aggregate(held, 0L, (a, x) -> a + x.count)").alias("all"), F.explode("held").alias("of")).select("lang", "term", "all", "of.*")
    used = entries.join(stats, ["lang", "source"]).select("lang", "term", "source", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q")).transform(cut)
    best = used.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(stats, used).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(best).filter(F.col("rank") <= top_terms))


def _pairs(stats: DataFrame, used: DataFrame) -> DataFrame:
    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = stats.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("v") * spread(F.col("p0"), F.col("q0"))).alias("value"))
    shares = used.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("n"))
    one = shares.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (spread(F.col("p"), F.col("q0")) - spread(F.col("p0"), F.col("q0")))).alias("value"))
    both = _corrections(used.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).filter("size(held) > 1").select("lang", "held"))
    halves = one.union(both)
    turned = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return alone.union(halves).union(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SHARE = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * {v})"
_SPREAD = "((p - q) * (p - q)) // (p + q)"
#: The same result in DuckDB, over every (source, term) of a language.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest({_TERMS}) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format(c="coalesce(c.c, 0)", n="t.n", v="v")} AS p
  FROM groups g JOIN kept k USING (lang) JOIN kinds USING (lang) JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), whole AS (
  SELECT lang, term, {_SHARE.format(c="sum(c)", n="any_value(n)", v="any_value(v)")} AS q
  FROM counts JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) USING (lang) JOIN kinds USING (lang) GROUP BY lang, term
), pair AS (
  SELECT lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN (
    SELECT lang, a.source AS one, b.source AS two, sum({_SPREAD}) AS value
    FROM shares a JOIN (SELECT lang, source, term, p AS q FROM shares) b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.one = a.source AND s.two = b.source
  WHERE a.source <> b.source
), term AS (
  SELECT lang, source, term AS item, {_SPREAD} AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank
  FROM (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term' AS part, * FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
