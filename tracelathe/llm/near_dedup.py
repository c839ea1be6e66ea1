"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles of 5 words (words are separated by blanks, A-Z lower-cased; fewer
words make one shingle). Documents with equal sets are one class. The classes are then branched by independent
trees: at each level a node's classes part by their smallest shingle under one of the tree's hash functions. Two
sets of similarity s stay together through d levels with probability s**d, so from level FIRST on nodes of at most LEAF
classes are compared exhaustively as soon as they appear, larger ones are branched up to DEPTH levels, and there are as many
trees as make the chance of missing a pair at the threshold at most MISSED.

Comparing happens inside a node and gives no pairs: a task has the sets of a node's classes, joins those that it
finds linked, surest first, and passes over pairs that are joined already. So a node of n classes gives n - 1 links
at most. A node that is still large after all levels is dealt into parts of about LEAF classes, and a few hubs of
the node are members of every part. Trees are taken in batches; the components of the links found so far are known
to the next one, in which nodes of one component end at once. So a group of copies is compared a few times, not in
every tree.

Large nodes that have several components after all batches are branched again, by more and deeper trees; its trees,
too, miss a pair at the threshold with at most MISSED at their last level, which is nearer for lower thresholds. Where
at most FEW classes of a node lie outside its main component, and in what is still large after the second branching,
those classes meet all others of the node, in blocks of FEW. So pairs inside a connected component are not compared,
and of those between components the two branchings miss at most 2 * MISSED at the threshold.

Sketches (one byte each of FINE further smallest shingles) only decide which pairs of a node are worth a look: a pair
goes on unless its estimated similarity is more than three standard deviations below the threshold. Links are
confirmed on full sets.

Defined cases: null and empty texts and texts without words have empty sets and are linked with nothing; equal
texts are one class; texts may be of any length; the result has one row per input row, with ids as given (rows that
repeat a doc_id are compared as one document each); a row without id is a copy if its group has an id and else stands
for itself (null component, kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.columns import LOWER, SOLID, U64, by_batch, gram_hashes, mix, only, run_hashes, text_bytes, word_runs
from tracelathe.llm.graph import components, cut, numbered, tasks

SHINGLE = 5
MISSED = 0.003
#: The first branching: the level of its first nodes, and its last.
FIRST = 3
DEPTH = 4
LEAF = 256
HUBS = 2
#: Trees of the first batch; the rest is the second.
FIRST_TREES = 2
#: The second branching: its trees, the levels that its first nodes have, and its last level, at most each.
TREES_2 = 42
FIRST_2 = 6
DEPTH_2 = 12
#: Classes outside a node's main component that meet the rest of it in one block, and the rest's part in a task.
FEW = 256
BLOCK = 1024
#: Members of groups that a task compares at least.
GROUP_ROWS = 2000
#: Bytes of a sketch at least.
FINE = 192
#: Ids (of 8 bytes) that are sent to every task at most; more are joined by shuffling.
HELD_IDS = 1_000_000


def shingle_sets(texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    begin, end = word_runs(data, at, SOLID)
    words = run_hashes(data, begin, end)
    first = np.searchsorted(begin, at).tolist()
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def smallest(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Per set and hash function the smallest hash, as 32 bits; 0 for empty sets."""
    out = np.zeros((len(sets), coordinates), np.uint32)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        first = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for j in range(coordinates):
            a, b = mix(np.array([2 * j + 1, 2 * j + 2], U64))
            out[full, j] = np.minimum.reduceat(((values ^ b) * (a | U64(1))) >> U64(32), first).astype(np.uint32)
    return out


def trees_for(similarity: float, depth: int) -> int:
    """Trees of so many levels that miss a pair of this similarity with at most MISSED."""
    apart = 1 - similarity**depth
    return max(1, math.ceil(math.log(MISSED) / math.log(apart))) if apart > 0 else 1


def second_branching(similarity: float) -> tuple[int, int]:
    """Trees and last level: the deepest for which TREES_2 trees suffice."""
    depth = max((d for d in range(1, DEPTH_2 + 1) if trees_for(similarity, d) <= TREES_2), default=1)
    return trees_for(similarity, depth), depth


def sketches(docs: DataFrame, shingle: int, coarse: int, fine_size: int) -> DataFrame:
    """row, doc_id, n_shingles, two hashes of the set, and its smallest shingles; docs: row, doc_id, text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2), shingle)
        low = smallest(sets, coarse + fine_size)
        path, fine = low[:, :coarse], low[:, coarse:].astype(np.uint8)
        marks = set_marks(sets)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([x.tobytes() for x in path], pa.binary()), pa.array([x.tobytes() for x in fine], pa.binary())],
            names=["row", "doc_id", "n_shingles", "high", "low", "path", "fine"],
        )

    return docs.mapInArrow(by_batch(work), "row bigint, doc_id bigint, n_shingles bigint, high bigint, low bigint, path binary, fine binary")


def set_marks(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    return np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets], np.int64).reshape(-1, 2)


def _groups(batches):
    """Tables of whole groups from batches that are sorted by their first column, the group."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        group = held.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on in the next batch
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _close(rows: DataFrame, least: float, most: int) -> DataFrame:
    """The members (node, id, component, fine) of groups that have another member of another component whose sketch agrees enough."""

    def run(batches):
        for table in _groups(batches):
            node, component = table.column(0).to_numpy(), table.column(2).to_numpy()
            fine = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(node), -1)
            good, d = np.zeros(len(node), bool), 1
            while (same := node[:-d] == node[d:]).any():
                i = np.flatnonzero(same & (component[:-d] != component[d:]))
                i = i[(fine[i] == fine[i + d]).mean(axis=1) >= least]
                good[i] = good[i + d] = True
                d += 1
            if good.any():
                yield from table.filter(pa.array(good)).combine_chunks().to_batches()

    dealt = tasks(rows.select("node", "id", "component", "fine").repartition("node"), most, GROUP_ROWS).sortWithinPartitions("node")
    return dealt.mapInArrow(run, "node bigint, id bigint, component bigint, fine binary")


def join_group(component: list[int], agreement: np.ndarray, sets: list[np.ndarray], least: float, num: int, den: int) -> list[tuple[int, int]]:
    """Links (places of two members) that join the components of a group as far as its sets are linked; surest pairs first."""
    label = {c: c for c in component}

    def root(c):
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    i, j = np.nonzero(np.triu(agreement >= least, 1))
    out = []
    for k in np.argsort(-agreement[i, j], kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        p, q = root(component[a]), root(component[b])
        x, y = sets[a], sets[b]
        if p != q and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
            common = len(np.intersect1d(x, y, assume_unique=True))
            if den * common >= num * (len(x) + len(y) - common):
                label[q] = p
                out.append((a, b))
    return out


def _links(groups: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, fine_size: int) -> DataFrame:
    """Links (a, b) between classes of different components that share a group; groups: node, id, component."""
    least = _least(num / den, fine_size)
    groups = groups.transform(cut)
    n = groups.count()
    members = _held(groups.select("id").distinct().transform(cut, n))
    fine = classes.select("id", "fine").join(members, "id", "left_semi").transform(cut, n)
    close = _close(groups.join(fine, "id"), least, n).transform(cut)
    n = close.count()
    ids = _held(close.select("id").distinct().transform(cut, n))
    wanted = classes.select("id", "head", "high", "low").join(ids, "id", "left_semi").transform(cut, n)
    heads = _held(wanted.select("head").distinct().transform(cut, n))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(0), shingle)
        marks = set_marks(sets)
        return pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())], names=["h", "l", "members"])

    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left_semi").select("text")
    found = texts.mapInArrow(by_batch(work), "h bigint, l bigint, members binary")
    sets = found.join(wanted, (F.col("h") == F.col("high")) & (F.col("l") == F.col("low"))).select(F.col("id").alias("of"), "members")
    sets = tasks(sets.dropDuplicates(["of"]), n, GROUP_ROWS)

    def judge(batches):
        for table in _groups(batches):
            node, ids = table.column(0).to_numpy(), table.column(1).to_pylist()
            edges = [*np.flatnonzero(np.diff(node, prepend=node[0] - 1)).tolist(), len(node)]
            component, fine, members = (table.column(c) for c in (2, 3, 4))
            a, b = [], []
            for c, e in zip(edges, edges[1:], strict=False):
                bytes_ = np.frombuffer(b"".join(fine[c:e].to_pylist()), np.uint8).reshape(e - c, -1)
                agreement = np.stack([(bytes_ == x).mean(axis=1) for x in bytes_])
                own = [np.frombuffer(x.as_buffer(), U64) for x in members[c:e]]
                for x, y in join_group(component[c:e].to_pylist(), agreement, own, least, num, den):
                    a.append(ids[c + x])
                    b.append(ids[c + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = close.join(sets, F.col("id") == F.col("of")).select("node", "id", "component", "fine", "members")
    dealt = tasks(rows.repartition("node"), n, GROUP_ROWS).sortWithinPartitions("node")
    return dealt.mapInArrow(judge, "a bigint, b bigint").transform(cut)


def _branch(classes: DataFrame, path: str, trees: range, first: int, depth: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(nodes of at most LEAF classes, nodes that stay large): node, tree, id, component; and count of the large ones.

    classes: id, component, and the column `path` with `width` bytes per level of each tree. The first nodes are those
    of level `first`; nodes of one component end.
    """
    each = F.expr(f"transform(sequence({trees.start}, {trees.stop - 1}), t -> named_struct('tree', t, 'path', substring({path}, t * {width * depth} + 1, {width * depth})))")
    rows = classes.select("id", "component", F.explode(each).alias("x")).select("id", "component", "x.tree", "x.path")
    rows = rows.withColumn("node", F.xxhash64("tree", F.expr(f"substring(path, 1, {width * first})")))
    leaves, most = None, classes.count() * len(trees)
    for level in range(first, depth + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.min("component").alias("low"), F.max("component").alias("high"))
        sizes = sizes.filter("low < high").select(F.col("node").alias("of"), "count").transform(cut, most)
        rows = rows.join(sizes, F.col("node") == F.col("of")).drop("of").transform(cut, most)
        small = rows.filter(f"count <= {LEAF}").select("node", "tree", "id", "component")
        leaves = small if leaves is None else leaves.union(small)
        rows = rows.filter(f"count > {LEAF}")
        if level < depth:
            rows = rows.drop("count").withColumn("node", F.xxhash64("node", F.expr(f"substring(path, {width * level + 1}, {width})")))
            most = rows.count()
            if not most:
                rows = rows.withColumn("count", F.lit(0).cast("bigint"))
                break
    return leaves, rows.select("node", "tree", "id", "component", "count")


def _dealt(large: DataFrame) -> DataFrame:
    """Large nodes in parts of about LEAF classes, each with the node's hubs: node, id, component."""
    parts = F.expr(f"int(ceil(count / {LEAF - HUBS}))")
    one = large.select("node", "id", "component", parts.alias("parts"))
    place = F.xxhash64("id", "node")
    low = [F.min(F.struct(F.xxhash64("id", "node", F.lit(k)), "id", "component")).alias(f"hub{k}") for k in range(HUBS)]
    hubs = one.groupBy("node").agg(F.first("parts").alias("parts"), *low)
    hub = F.array_distinct(F.array(*(F.struct(f"hub{k}.id", f"hub{k}.component") for k in range(HUBS))))
    hubs = hubs.select("node", "parts", F.explode(hub).alias("x")).select("node", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = one.select(F.xxhash64("node", F.pmod(place, F.col("parts")).cast("int")).alias("node"), "id", "component")
    return members.union(hubs.select(F.xxhash64("node", "part").alias("node"), "x.id", "x.component")).distinct()


def _held(ids: DataFrame) -> DataFrame:
    """A written table of one or two ids a row, to be broadcast if it has at most HELD_IDS rows."""
    return F.broadcast(ids) if ids.count() <= HELD_IDS else ids


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the components that are known now."""
    return rows.drop("component").join(_held(labels.select(F.col("id").alias("of"), "component")), F.col("id") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "id"))


def _mixed(large: DataFrame) -> DataFrame:
    """The nodes of several components: node, id, component, main (the largest one), others (classes outside it)."""
    counts = large.groupBy("node", "component").count()
    main = counts.groupBy("node").agg(F.max_by("component", F.struct("count", "component")).alias("main"), (F.sum("count") - F.max("count")).alias("others"), F.sum("count").alias("size"))
    n = large.count()
    main = main.filter("others > 0").withColumnRenamed("node", "of").transform(cut, n)
    return large.select("node", "id", "component").join(main, F.col("node") == F.col("of")).drop("of").transform(cut, n)


def _met(mixed: DataFrame) -> DataFrame:
    """Groups in which every class outside a node's main component meets all classes of the node: node, id, component."""
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("others") / FEW)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / BLOCK)).cast("int")
    blocks = lambda n, size: F.sequence(F.lit(0), F.ceil(F.col(n) / size).cast("int") - 1)
    few = mixed.filter("component <> main").select("node", "id", "component", own.alias("block"), F.explode(blocks("size", BLOCK)).alias("part"))
    rest = mixed.select("node", "id", "component", F.explode(blocks("others", FEW)).alias("block"), part.alias("part"))
    return few.union(rest).select(F.xxhash64("node", "block", "part").alias("node"), "id", "component").distinct()


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", num: int = 85, den: int = 100, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept, for den * intersection >= num * union.

    With `row`, a column that tells rows apart, the result has that column too, and exactly one row of each group is
    kept: that with the smallest doc_id (null ids last), then the smallest row.
    """
    docs = only(docs, doc_id=doc_id, text=text) if row is None else only(docs, doc_id=doc_id, text=text, row=row)
    similarity = num / den
    trees, (trees_2, depth_2) = trees_for(similarity, DEPTH), second_branching(similarity)
    fine_size = max(FINE, trees_2 * depth_2)
    marked = sketches(docs.select(F.lit(0).cast("bigint").alias("row") if row is None else "row", "doc_id", "text"), shingle, trees * DEPTH, fine_size).transform(cut)
    classes = marked.filter("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("head"), F.first("path").alias("path"), F.first("fine").alias("fine"))
    classes = classes.withColumn("id", F.monotonically_increasing_id()).transform(cut)
    find = lambda groups: _links(groups, classes, docs, shingle, num, den, fine_size)
    labels = classes.select("id", F.col("id").alias("component")).limit(0)
    links, crowds = [], []
    for batch in (range(0, min(FIRST_TREES, trees)), range(min(FIRST_TREES, trees), trees)):
        if len(batch):
            leaves, large = _branch(_labelled(classes.select("id", "path"), labels), "path", batch, min(FIRST, DEPTH), DEPTH, 4)
            crowds.append(large.transform(cut))
            links.append(find(leaves.select("node", "id", "component").union(_dealt(crowds[-1]))))
            labels = components(_all(links))
    mixed = _mixed(_labelled(_all(crowds), labels))
    hard = _labelled(mixed.filter(f"others > {FEW}").select("id").distinct(), labels).join(classes.select("id", "fine"), "id").transform(cut)
    groups = _met(mixed.filter(f"others <= {FEW}"))
    if hard.limit(1).count():
        leaves, large = _branch(hard, "fine", range(trees_2), min(FIRST_2, depth_2), depth_2, 1)
        large = large.transform(cut)
        links.append(find(groups.union(leaves.select("node", "id", "component")).union(_dealt(large))))
        labels = components(_all(links))
        groups = _met(_mixed(_labelled(large, labels)))
    groups = groups.transform(cut)
    if groups.limit(1).count():
        links.append(find(groups))
        labels = components(_all(links))
    named = _labelled(classes.select("id", "head", F.col("high").alias("h"), F.col("low").alias("l")), labels)
    heads = named.groupBy(F.col("component").alias("of")).agg(F.min("head").alias("component_id"))
    named = named.join(heads, F.col("component") == F.col("of")).select("h", "l", "component", "component_id").transform(cut)
    out = marked.select("row", "doc_id", "n_shingles", "high", "low").join(named, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", F.when(F.col("component").isNull(), F.col("doc_id")))
    result = out.select("row", "doc_id", "n_shingles", "component", component.alias("component_id"))
    if row is None:
        kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull())
        return result.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = result.filter("component is not null").groupBy(F.col("component").alias("of")).agg(F.min(order).alias("first"))
    kept = F.coalesce(F.col("first.row") == F.col("row"), F.lit(True))
    return result.join(stays, F.col("component") == F.col("of"), "left").select(F.col("row").alias(row), "doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _least(similarity: float, coordinates: int) -> float:
    return max(0.0, similarity - 3.2 * (similarity * (1 - similarity) / coordinates) ** 0.5)


def drop_near_copies(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The rows, with all their columns, of which one stays for each group of near copies."""
    rows, row = numbered(docs)
    gone = near_duplicates(rows, doc_id, text, row=row, **options).filter("not kept").select(row)
    return rows.join(gone, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same result in DuckDB: all pairs of documents that share a shingle, then everything that can be reached over links.
ORACLE = rf"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[j:j + {SHINGLE} - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS j FROM words WHERE len(w) > 0) x
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)
"""
