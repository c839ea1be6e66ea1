"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is what stands between line feeds; its words are what blanks separate, lower-cased, so lines that differ
in case or spacing are equal. A line goes when an earlier line (smaller doc_id, then smaller position; whether
that one stays or not) lies within the edit bound: equal words, and for lines of `near_words` words or more also
one word inserted, deleted or replaced. Lines of fewer than `least_words` words, such as headings, list marks
and blank lines, always stay.

1. Lines are reduced to two 64-bit hashes of their words, and equal ones to their earliest place.
2. One edit leaves the first or the second half of a line as it is. Lines of which neither half (cut as for its
   own length and as for one word less) occurs in another line can't have a neighbour. This loses nothing.
3. Only the others emit their variants: for every word outside the shared half the hash of the line without it, the
   exclusive or of hashes of (word, place), so that one running value each from the left and the right gives all of a
   line's variants. Equal keys join: two lines of equal length that miss the same place differ by a replaced word; a line's
   variant that is another whole line differs by an inserted one. Every key keeps only its earliest line, so
   groups are summed before they are shuffled and no pairs are made.
4. The words of a line and the earliest line found for it are compared, which verifies the distance.

A place is a document (its doc_id and a hash of its text) and a position. Tables go to every task only if they have at most
HELD_BYTES bytes; larger ones are joined by shuffling. A document's lines are looked up by position, so long ones take time in
proportion to their length.

Defined cases: null texts stay null and empty texts stay empty; texts may have any number of lines, and lines any length; a text
that loses all its lines becomes an empty text with n_kept 0; rows that repeat doc_id and text are one document, in all of its
rows; rows that repeat a doc_id with other texts are documents of their own; rows without id keep all lines; an empty table gives
an empty table; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.llm.graph import shared_checkpoints

LEAST_WORDS = 5
NEAR_WORDS = 10
#: Bytes of an intermediate table that is sent to every task at most.
HELD_BYTES = 8 << 20
DOC = ("doc_id", "mark")
PLACE = (*DOC, "pos")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos, words (lower-cased) of every line."""
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*PLACE, F.expr("filter(split(lower(line), '[\\t-\\r ]+'), x -> x <> '')").alias("words"))


def _hashed(lines: DataFrame) -> DataFrame:
    """Adds n, two hashes of the words, and the hashes of the halves."""
    halves = [
        f"xxhash64('{side}', n - {cut}, slice(words, {'1' if side == 'head' else f'n - (n - {cut} - (n - {cut}) div 2) + 1'}, {f'(n - {cut}) div 2' if side == 'head' else f'n - {cut} - (n - {cut}) div 2'}))"
        for cut in (0, 1)
        for side in ("head", "tail")
    ]
    return lines.withColumn("n", F.size("words")).select(*PLACE, "words", "n", F.expr("xxhash64(1, words)").alias("k1"), F.expr("xxhash64(words, 2)").alias("k2"), F.expr(f"array({', '.join(halves)})").alias("halves"))


def first_lines(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """One row per distinct line: its earliest place, its hashes, and its halves (null if short)."""
    lines = _hashed(_lines(docs).filter(f"size(words) >= {least_words}"))
    halves = [F.first(F.when(F.col("n") >= near_words, F.col("halves")[i])).alias(f"h{i}") for i in range(4)]
    place = F.min(F.struct(*PLACE)).alias("place")
    return lines.groupBy("k1", "k2", "n").agg(place, *halves).select("k1", "k2", "n", "place.*", *(f"h{i}" for i in range(4)))


def _candidates(firsts: DataFrame, near_words: int) -> DataFrame:
    """(place, head, tail) of the distinct lines that share their first or second half with another line."""
    near = firsts.filter(f"n >= {near_words}")
    keys = near.select(*PLACE, F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("half", "key"))
    # A line can have a key twice (both cuts may give the same words), so the key's lines are told apart by their places.
    line = F.xxhash64(*PLACE)
    shared = keys.groupBy("key").agg(F.min(line).alias("low"), F.max(line).alias("high")).filter("low < high").select(F.col("key").alias("of")).checkpoint()
    found = keys.join(shared, F.col("key") == F.col("of"), "left_semi")
    return found.groupBy(*PLACE).agg(F.max(F.col("half") % 2 == 0).alias("head"), F.max(F.col("half") % 2 == 1).alias("tail"))


def _held(rows: DataFrame, size) -> DataFrame:
    """A checkpointed table, to be broadcast if its rows, of `size` bytes each, have at most HELD_BYTES."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= HELD_BYTES else rows


def near_repeats(docs: DataFrame, firsts: DataFrame, near_words: int) -> DataFrame:
    """The places of distinct lines with an earlier line at one word's distance; docs: doc_id, mark, text."""
    found = _candidates(firsts, near_words).checkpoint()
    of_docs = found.groupBy(*DOC).agg(F.collect_list(F.struct("pos", "head", "tail")).alias("wanted")).checkpoint()
    of_docs = _held(of_docs, 32 + 24 * F.size("wanted"))
    words = "filter(split(lower(element_at(lines, x.pos + 1)), '[\\t-\\r ]+'), w -> w <> '')"
    chosen = docs.join(of_docs, [*DOC]).select(*DOC, "wanted", F.split("text", "\n").alias("lines"))
    chosen = chosen.select(*DOC, F.explode(F.expr(f"transform(wanted, x -> named_struct('pos', x.pos, 'head', x.head, 'tail', x.tail, 'words', {words}))")).alias("x"))
    lines = chosen.select(*DOC, "x.*").withColumn("n", F.size("words"))
    total = "aggregate(transform(words, (w, i) -> xxhash64(w, i)), 0L, (a, b) -> a ^ b)"
    lines = lines.withColumn("all", F.expr(total)).repartition(*PLACE).checkpoint()
    place = F.struct(*PLACE)
    # Dealt by line first: the running values over a line's words then need no exchange of their own.
    spelled = lines.select(*PLACE, "n", "head", "tail", "words").repartition(*PLACE).select(*PLACE, "n", "head", "tail", F.posexplode("words").alias("i", "word"))
    own = Window.partitionBy(*PLACE).orderBy("i")
    here, moved = (f"xxhash64(word, i - {d})" for d in (0, 1))
    left = F.coalesce(F.expr(f"bit_xor({here})").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = F.coalesce(F.expr(f"bit_xor({moved})").over(own.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    # An edit in the first half leaves the second one shared, and the other way round.
    variants = spelled.withColumn("sum", left.bitwiseXOR(right)).filter("head and i >= (n - 1) div 2 or tail and i <= n div 2").select(*PLACE, "n", "i", "sum").checkpoint()
    # The same place missing in lines of one length: a replaced word.
    cut = variants.select(place.alias("place"), "n", "i", "sum")
    first_cut = _held(cut.groupBy("n", "i", "sum").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").drop("last").checkpoint(), F.lit(64))
    replaced = cut.join(first_cut, ["n", "i", "sum"]).filter("place > first").select("place", "first")
    # A line's variant that is another line as a whole: an inserted word.
    heads = lines.groupBy(F.col("n").alias("m"), F.col("all").alias("sum")).agg(F.min(place).alias("whole")).checkpoint()
    inserted = variants.select((F.col("n") - 1).alias("m"), "sum", place.alias("place")).join(_held(heads, F.lit(64)), ["m", "sum"]).select("place", "whole").checkpoint()
    longer_goes = inserted.filter("place > whole").select("place", F.col("whole").alias("first"))
    shorter_goes = inserted.filter("place < whole").groupBy("whole").agg(F.min("place").alias("first")).select(F.col("whole").alias("place"), "first")
    pairs = replaced.union(shorter_goes).union(longer_goes).distinct()
    mine = lines.select(place.alias("place"), "words")
    other = lines.select(place.alias("first"), F.col("words").alias("other"))
    compared = pairs.join(mine, "place").join(other, "first")
    return compared.filter(one_word_apart("words", "other")).select("place.*").distinct()


def one_word_apart(one: str, other: str):
    """Whether two arrays of words differ by at most one word inserted, deleted or replaced."""
    least = f"least(size({one}), size({other}))"
    # Equal words from the left, then from the right: the edit distance is at most 1 if they leave at most one word of either.
    left = f"coalesce(nullif(array_position(zip_with(slice({one}, 1, {least}), slice({other}, 1, {least}), (x, y) -> x <> y), true), 0) - 1, {least})"
    ends = [f"slice({x}, size({x}) - {least} + 1, {least})" for x in (one, other)]
    right = f"coalesce(nullif(array_position(reverse(zip_with({ends[0]}, {ends[1]}, (x, y) -> x <> y)), true), 0) - 1, {least})"
    return F.expr(f"abs(size({one}) - size({other})) <= 1 and {left} + {right} >= greatest(size({one}), size({other})) - 1")


COUNTS = ("n_lines", "n_kept", "n_long", "n_long_kept")


def _rebuilt(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """rest (all other columns), text (what is left of it), and counts; in a name space of its own."""
    shared_checkpoints(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").filter("text is not null and doc_id is not null")
    firsts = first_lines(texts, least_words, near_words).checkpoint()
    gone = near_repeats(texts, firsts, near_words).checkpoint()
    kept = firsts.select(*PLACE).join(gone, [*PLACE], "left_anti")
    kept = kept.groupBy(*(F.col(c).alias(f"of_{c}") for c in DOC)).agg(F.collect_list("pos").alias("kept"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    rows = docs.select(rest, "doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = rows.join(kept, (F.col("doc_id") == F.col("of_doc_id")) & (F.col("mark") == F.col("of_mark")), "left")
    rows = rows.select("rest", "text", F.col("doc_id").isNull().alias("whole"), F.split("text", "\n").alias("lines"), F.coalesce("kept", F.expr("cast(array() as array<int>)")).alias("kept"))
    words = "size(filter(split(lower(x), '[\\t-\\r ]+'), w -> w <> ''))"
    rows = rows.withColumn("long", F.expr(f"filter(transform(lines, (x, i) -> if({words} >= {least_words}, i, -1)), i -> i >= 0)"))
    every = "sequence(0, size(lines) - 1)"
    rows = rows.withColumn("places", F.expr(f"if(whole, {every}, array_sort(array_union(kept, array_except({every}, long))))"))
    rows = rows.withColumn("stay", F.expr("transform(places, i -> element_at(lines, i + 1))"))
    counts = {"n_lines": "size(lines)", "n_kept": "size(stay)", "n_long": "size(long)", "n_long_kept": "if(whole, size(long), size(kept))"}
    counts = [F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.expr(x)).cast("long").alias(name) for name, x in counts.items()]
    return rows.select("rest", F.array_join("stay", "\n").alias("text"), *counts)


def _as_before(docs: DataFrame, rows: DataFrame, left_out: tuple[str, ...] = ()) -> list:
    """The columns of `docs`, with the text that is left."""
    return [rows["text"].alias("text") if c == "text" else rows["rest"].getField(c).alias(c) for c in docs.columns if c not in left_out]


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with repeated lines taken out of `text`, and n_lines, n_kept (0 for null texts), which replace such columns.

    n_long and n_long_kept count only the lines of least_words words or more.
    """
    rows = _rebuilt(docs, least_words, near_words)
    return rows.select(*_as_before(docs, rows, COUNTS), *COUNTS)


def drop_repeated(docs: DataFrame, least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with repeated lines taken out, without those that had lines of least_words words or more and lost them all; no new columns."""
    rows = _rebuilt(docs, least_words, near_words).filter("text is null or n_long = 0 or n_long_kept > 0")
    return rows.select(*_as_before(docs, rows))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_kept and the SHA-256 of the text that stays (null for null texts).

    Lines of fewer than LEAST_WORDS words always stay, those of fewer than NEAR_WORDS go only if equal; README.md has their share.
    """
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: The same result in DuckDB: pairs of neighbours come from all variants, spelled out.
ORACLE = f"""
WITH parted AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM parted) x
), lines AS (
  SELECT doc_id, pos, line, list_filter(regexp_split_to_array(lower(line), '[\\t-\\r ]+'), lambda x: x <> '') AS words FROM placed
), firsts AS (
  SELECT words, min(row(doc_id, pos)) AS place FROM lines WHERE len(words) >= {LEAST_WORDS} GROUP BY words
), variants AS (
  SELECT place, len(words) AS n, i, md5(array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ')) AS body
  FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM firsts WHERE len(words) >= {NEAR_WORDS}) x
), wholes AS (
  SELECT place, len(words) AS n, md5(array_to_string(words, ' ')) AS body FROM firsts WHERE len(words) >= {NEAR_WORDS}
), gone AS (
  SELECT v.place FROM variants v JOIN variants o ON v.n = o.n AND v.i = o.i AND v.body = o.body AND o.place < v.place
  UNION SELECT v.place FROM variants v JOIN wholes w ON v.n = w.n + 1 AND v.body = w.body AND w.place < v.place
  UNION SELECT w.place FROM variants v JOIN wholes w ON v.n = w.n + 1 AND v.body = w.body AND v.place < w.place
), kept AS (
  SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM gone)
), marked AS (
  SELECT l.doc_id, l.pos, l.line, len(l.words) < {LEAST_WORDS} OR row(l.doc_id, l.pos) IN (SELECT place FROM kept) AS stays FROM lines l
), joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(j.text, '')) END AS text_sha256
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
