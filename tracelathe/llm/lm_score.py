"""Log probabilities of texts under a language model of words.

A text's tokens are its words (runs without blanks, A-Z lower-cased) and one end. Texts whose id's crc32 modulo 7 is
2 are held out; the others are learned from. A public rank file spells a word in items: subword ids, the last id of a
word being another item than the same id inside a word, so that spellings end themselves. A token's probability is

    own * share of the text's tokens before it that are this token
    + (1 - own) * P(first item | the tokens before) * ((1 - e) * c / C + e * P(the other items | those before in the word))

- P(first item | the tokens before): a causal self-attention model over the first and last items of the tokens before,
  in overlapping windows with batched masked attention, every token scored once. It predicts one of all items.
- c / C: what share of the learned tokens with this first item is this word.
- e: what share is left to words that are not known: the words learned once, by the learned tokens of several items; 1 where
  the first item was never learned, 0 for words of one item, which it tells by itself.
- P(the other items | ...): a second causal self-attention model, within a word. Each distinct word is scored once.
- own: grows from 0 to OWN as the text goes on.

So this is a distribution over all words, also unknown ones. Both models predict over all items of the rank file by a
softmax over classes and one inside a class. They are trained in numpy: from a start on slices of the corpus of about SLICE bytes
together (START_STEPS steps), every task trains on all windows of the learned texts of each of its slices (a caller may ask for a share of them,
`train_share`), and the tasks' changes are averaged, weighted by the windows they saw. Counts cover all learned tokens.

`base_score` is what word counts alone give: the sum of log10((c + 1) / (N + V + 1)) over a text's tokens; c: the
token's count, N: all tokens, V: distinct tokens, in learned texts. It gives every unknown word the whole mass of one unknown word.

Counts are looked up without moving texts or joining single words. Documents are written as slices of a few MB to
the shared folder, spelled once: numbers of words text by text, and each distinct word's items. Each slice sends the hashes of its distinct words, with their counts in learned texts, to buckets;
a bucket adds up its words' counts and sends them back in the order in which they came; each slice then has the
counts of all its words and scores its texts. Words that are frequent in most of a few slices are summed per task instead,
and their totals, at most HOT_WORDS, go to every task, as do the items' counts (one per item of the rank file). What is
shuffled grows with the distinct words of slices, and the number of buckets with the texts' bytes.

Words are told apart by their items; bytes that are no UTF-8 count as U+FFFD. Null texts are empty (the end only); a null id counts as empty text for the fold; texts may be of any length (a text
larger than a slice is one slice); rows that repeat are scored each; an empty table has an empty result; with no
learned texts c, N and V are 0 and the models are untrained. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.attention import Attention
from tracelathe.llm.bpe import read_ranks
from tracelathe.llm.columns import LOWER, SOLID, U64, mix, only, pieces, run_hashes, text_bytes, word_runs
from tracelathe.llm.graph import cut, table_path

SLICE = 4 << 20
BUCKET = 16 << 20
OWN, OWN_AFTER = 0.15, 100
SYMBOLS, SHARED = 160, 32
TRAIN_SHARE = 1.0
START_STEPS, START_RATE, RATE = 800, 2e-2, 1.5e-3
#: Slices that the start looks for its text in.
START_SLICES = 64
#: The start goes over its slices so many times at most. Places in a batch of the start, and of the rest.
EPOCHS, START_BATCH, BATCH = 6, 1024, 4096
#: Slices that frequent words are looked for in, how often they occur there at least, and how many there are at most.
HOT_SLICES, HOT_COUNT, HOT_WORDS = 16, 8, 32_768
#: Parts that the models' weights are summed in.
SHARDS = 16
#: Words (a power of two) whose spellings and scores a process keeps from slice to slice, and the most items of a spelling that is kept.
KEPT, KEPT_ITEMS = 1 << 20, 6


#: White space of the pattern that words can hold.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Kept:
    """What is known of words by their hashes (distinct ones), in a table of KEPT rows; a word that needs another's row takes it."""

    def __init__(self, **columns):
        self.keys = np.zeros(KEPT, U64)
        self.columns = {k: np.zeros((KEPT, *shape), kind) for k, (kind, *shape) in columns.items()}

    def get(self, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which words are known, and the columns of those."""
        row = (words & U64(KEPT - 1)).astype(np.int64)
        known = (self.keys[row] == words) & (words > 0)
        return known, *(x[row[known]] for x in self.columns.values())

    def put(self, words: np.ndarray, *values: np.ndarray) -> None:
        row = (words & U64(KEPT - 1)).astype(np.int64)
        self.keys[row] = words
        stays = self.keys[row] == words
        for x, own in zip(self.columns.values(), values, strict=True):
            x[row[stays]] = own[stays]


class Speller:
    """Spells words as items: twice the subword id, plus one for a word's last id; the end is an item of its own."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = read_ranks(path)
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = 2 * (max(ranks.values()) + 1)
        self.items = self.end + 1
        self.line_feed = ranks[b"\n"]
        self.kept = Kept(sizes=(np.uint8,), items=(np.uint32, KEPT_ITEMS))

    def spell(self, word: bytes) -> bytes:
        """One word's items, packed."""
        ids = np.array(self.library.encode_ordinary(word.decode("utf-8", "replace")), "<u4") * 2
        ids[-1] += 1
        return ids.astype("<u4").tobytes()

    def spell_all(self, own: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The items of a slice's distinct words in one array, and where each word's begin (one more at the end); the last word is the end."""
        known, known_sizes, known_items = self.kept.get(own.words)
        new = np.flatnonzero(~known)
        items, new_sizes = self.spell_new(own, new)
        sizes = np.empty(len(own.words), np.int64)
        sizes[known], sizes[new] = known_sizes, new_sizes
        at = np.concatenate(([0], np.cumsum(np.append(sizes, 1))))
        out = np.full(at[-1], self.end, np.int64)
        new_at = np.cumsum(new_sizes) - new_sizes
        out[np.repeat(at[new] - new_at, new_sizes) + np.arange(len(items))] = items
        places = np.arange(KEPT_ITEMS)
        inside = places < known_sizes[:, None]
        out[(at[:-2][known][:, None] + places)[inside]] = known_items[inside]
        few = new_sizes <= KEPT_ITEMS
        kept = np.zeros((int(few.sum()), KEPT_ITEMS), np.uint32)
        inside = places < new_sizes[few][:, None]
        kept[inside] = items[(new_at[few][:, None] + places)[inside]]
        self.kept.put(own.words[new[few]], new_sizes[few], kept)
        return out, at

    def spell_new(self, own: Slice, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of these words, one word after the other, and how many each has.

        Words are encoded together, one a line: no match of the pattern crosses a line feed, as words have no white space; the few with
        white space of other kinds are spelled one by one.
        """
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = own.lines(which).decode("utf-8", "replace")
        odd = {i: np.frombuffer(self.spell(own.word(which[i])), "<u4") for i, w in enumerate(text.split("\n")) if ODD.search(w)} if ODD.search(text) else {}
        if odd:
            text = "\n".join("x" if i in odd else w for i, w in enumerate(text.split("\n")))
        ids = np.array(self.library.encode_ordinary(text), np.int64)
        breaks = np.flatnonzero(ids == self.line_feed)
        sizes = np.diff(np.concatenate(([-1], breaks, [len(ids)]))) - 1
        items = 2 * ids[ids != self.line_feed]
        items[np.cumsum(sizes) - 1] += 1
        if odd:
            parts = np.split(items, np.cumsum(sizes)[:-1])
            for i, x in odd.items():
                parts[i] = x.astype(np.int64)
            sizes, items = np.array([len(x) for x in parts]), np.concatenate(parts)
        return items, sizes


_SPELLERS: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _SPELLERS:
        _SPELLERS[path] = Speller(path)
    return _SPELLERS[path]


class Slice:
    """The distinct words of a batch of texts (sorted by hash), and the words of each text in order, ends included."""

    def __init__(self, texts):
        data, at = text_bytes(texts)
        self.data = LOWER[data]
        self.begin, self.end = word_runs(self.data, at, SOLID)
        hashes = run_hashes(self.data, self.begin, self.end)
        self.words, self.first, which = np.unique(hashes, return_index=True, return_inverse=True)
        first = np.searchsorted(self.begin, at)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.at = first + np.arange(len(at))  # a text's tokens: its words and the end
        self.tokens = np.full(int(self.at[-1]), len(self.words), np.int64)
        self.tokens[np.arange(len(which)) + doc] = which

    def word(self, i: int) -> bytes:
        k = self.first[i]
        return self.data[self.begin[k] : self.end[k]].tobytes()

    def lines(self, which=slice(None)) -> bytes:
        """The distinct words (all, or those of these numbers), a line feed between any two."""
        first = self.first[which]
        begin, size = self.begin[first], self.end[first] - self.begin[first] + 1
        at = np.cumsum(size)
        out = np.append(self.data, np.uint8(10))[np.arange(at[-1] if len(at) else 0) + np.repeat(begin - (at - size), size)]
        out[at - 1] = 10
        return out[:-1].tobytes()


class Spelled:
    """A slice as items: the numbers of its words, text by text (each text's begin at `at`), and the items of each distinct word (from `item_at`); the last word is the end."""

    #: Columns that hold it, and what is packed in them.
    COLUMNS = {"starts": "<i8", "tokens": "<u4", "items": "<u4", "sizes": "<u4"}

    def __init__(self, at: np.ndarray, tokens: np.ndarray, items: np.ndarray, item_at: np.ndarray):
        self.at, self.tokens, self.items, self.item_at = at, tokens, items, item_at
        self.size = len(item_at) - 2  # distinct words

    @classmethod
    def of(cls, texts, own_speller: Speller) -> Spelled:
        own = Slice(texts)
        items, item_at = own_speller.spell_all(own)
        # Frequent words first, so that their numbers pack well.
        order = np.append(np.argsort(-np.bincount(own.tokens, minlength=len(own.words) + 1)[:-1], kind="stable"), len(own.words))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return cls(own.at, number[own.tokens], *_chosen(items, item_at, order))

    @classmethod
    def read(cls, *columns) -> Spelled:
        at, tokens, items, sizes = (_unpacked(c.as_py(), kind) for c, kind in zip(columns, cls.COLUMNS.values(), strict=True))
        return cls(at, tokens.astype(np.int64), items.astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))

    @classmethod
    def joined(cls, parts: list[Spelled]) -> Spelled:
        """Several slices as one; words that they share are one word."""
        hashes, first, which = np.unique(np.concatenate([p.hashes() for p in parts]), return_index=True, return_inverse=True)
        begin = np.cumsum([0, *(p.size for p in parts)])
        tokens = [np.append(which[a:b], len(hashes))[p.tokens] for p, a, b in zip(parts, begin, begin[1:], strict=False)]
        texts = np.cumsum([0, *(len(t) for t in tokens)])
        at = np.concatenate([[0], *(p.at[1:] + a for p, a in zip(parts, texts, strict=False))])
        sizes = np.concatenate([*(np.diff(p.item_at)[:-1] for p in parts), [1]])
        items = np.concatenate([*(p.items[:-1] for p in parts), parts[0].items[-1:]])
        return cls(at, np.concatenate(tokens), *_chosen(items, np.concatenate(([0], np.cumsum(sizes))), np.append(first, begin[-1])))

    def packed(self) -> list[bytes]:
        return [_packed(x, kind) for x, kind in zip((self.at, self.tokens, self.items, np.diff(self.item_at)), self.COLUMNS.values(), strict=True)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word's items, without the end's."""
        place = np.arange(len(self.items)) - np.repeat(self.item_at[:-1], np.diff(self.item_at))
        parts = mix(self.items.astype(U64) + (place.astype(U64) << U64(32)) + U64(1))
        return mix(np.add.reduceat(parts, self.item_at[:-1]))[:-1]

    def earlier(self) -> tuple[np.ndarray, np.ndarray]:
        """Per token its place in its text, and how often it has occurred there before."""
        doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        place = np.arange(len(doc)) - self.at[doc]
        key = doc * (self.size + 1) + self.tokens
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        before = np.empty(len(key), np.int64)
        before[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        return place, before

    def learned_counts(self, learned: np.ndarray) -> np.ndarray:
        """Per distinct word, and last for the end, the occurrences in learned texts."""
        keep = np.repeat(learned, np.diff(self.at))
        return np.bincount(self.tokens[keep], minlength=self.size + 1)


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Compressed, the bytes of one place of all values together."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _chosen(items: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the words of these numbers, in that order, and where each word's begin (one more at the end)."""
    size = np.diff(at)[which]
    out = np.concatenate(([0], np.cumsum(size)))
    return items[np.repeat(at[:-1][which] - out[:-1], size) + np.arange(out[-1])], out


class Items:
    """Numbers for a vocabulary's items, the frequent ones first; those never learned share the last number and its class."""

    def __init__(self, counts: np.ndarray, seen: np.ndarray, symbols: int, shared: int):
        size = len(counts)
        order = np.argsort(-(counts + (seen > 0) * 1e-3), kind="stable")
        told = int(((counts > 0) | (seen > 0)).sum())
        self.number = np.full(size, told, np.int64)
        self.number[order[:told]] = np.arange(told)
        weights = np.append(counts[order[:told]] + 0.02, 0.02 * (size - told))
        alone = min(symbols - shared, len(weights) - 1)
        rest = np.cumsum(weights[alone:])
        symbol = np.concatenate((np.arange(alone), alone + np.minimum((shared * rest / rest[-1]).astype(np.int64), shared - 1)))
        symbol = np.unique(symbol, return_inverse=True)[1]
        totals = np.bincount(symbol, weights)
        shares = weights / totals[symbol]
        # No fit sees the items that were never learned, so their share of the last class stays as it is.
        self.inside = np.zeros(size, np.float32)
        if told < size:
            left = 1 - shares[-1]
            if left > 0 and symbol[-2:-1].tolist() == symbol[-1:].tolist():
                self.inside[order[:told][symbol[:-1] == symbol[-1]]] = np.log(left)
            self.inside[order[told:]] = np.log(shares[-1] / (size - told))
        self.symbol, self.shares, self.n_symbols = symbol, np.log(np.maximum(shares, 1e-30)), len(totals)

    def net(self, **options) -> Attention:
        return Attention(self.n_symbols, symbol_of=self.symbol, shares=self.shares, apart=1, **options)


class Model:
    """The two attention models and the counts that go to every task; firsts, rests: how often each item is a learned token's first one and another one."""

    def __init__(self, firsts: np.ndarray, rests: np.ndarray, n: int, v: int, ones: int):
        self.n, self.v = n, v
        self.firsts, self.rests = firsts, rests
        last = np.arange(len(firsts)) % 2 == 1
        last[-1:] = True  # the end
        self.last = last
        self.escape = min(0.9, max(ones, 1) / max(float(firsts[~last].sum()), 2.0))
        self.first, self.rest = Items(firsts, firsts, SYMBOLS, SHARED), Items(rests, firsts + rests, SYMBOLS, SHARED)
        ends = np.flatnonzero(last & (firsts + rests > 0))
        self.tail = np.full(len(firsts), len(ends), np.int64)
        self.tail[ends] = np.arange(len(ends))
        self.context, self.spelling = self.first.net(tails=len(ends) + 1), self.rest.net(window=16, overlap=8, seed=2)

    def weights(self) -> np.ndarray:
        return np.concatenate((self.context.weights(), self.spelling.weights()))

    def load(self, weights: np.ndarray) -> None:
        size = len(self.context.weights())
        self.context.load(weights[:size])
        self.spelling.load(weights[size:])

    def context_rows(self, own: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is seen (first items, last items) and wanted at every token of a slice."""
        firsts = self.first.number[own.items[own.item_at[:-1]]][own.tokens]
        tails = self.tail[own.items[own.item_at[1:] - 1]][own.tokens]
        seen, ends = np.empty_like(firsts), np.empty_like(tails)
        seen[1:], ends[1:] = firsts[:-1], tails[:-1]
        seen[own.at[:-1]] = self.context.items
        ends[own.at[:-1]] = len(self.context.tail) - 1
        return seen, ends, firsts

    def spelling_rows(self, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is seen and wanted inside words, as items, and where each word's begin."""
        inside = np.ones(len(items), bool)
        inside[at[:-1]] = False
        wanted = np.flatnonzero(inside)
        sizes = np.zeros(len(at), np.int64)
        np.cumsum(np.diff(at) - 1, out=sizes[1:])
        return items[wanted - 1], items[wanted], sizes

    def fit(self, own: Spelled, learned: np.ndarray, rng, rate: float, share: float, steps: int | None = None, states=None) -> int:
        """Trains on windows of a slice's learned texts and on its words in them; how many tokens were looked at."""
        states = states or ({}, {})
        seen, tails, wanted = self.context_rows(own)
        texts = np.flatnonzero(learned)
        if not len(texts):
            return 0
        sizes = np.diff(own.at)[texts]
        index = np.repeat(own.at[:-1][texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text_at = np.concatenate(([0], np.cumsum(sizes)))
        seen, tails, wanted, tokens = seen[index], tails[index], wanted[index], own.tokens[index]
        if steps:
            self.context.start_pairs(seen, wanted)
        most = lambda n: steps and min(steps, -(-EPOCHS * n // START_BATCH))  # noqa: E731  small corpora would be learned by heart
        losses = self.context.fit(seen, tails, wanted, text_at, rng, rate, share, START_BATCH if steps else BATCH, most(len(wanted)), states[0])
        seen, wanted, rest_at = self.spelling_rows(*_chosen(own.items, own.item_at, np.unique(tokens)))
        seen, wanted = self.rest.number[seen], self.rest.number[wanted]
        if steps:
            self.spelling.start_pairs(seen, wanted)
        self.spelling.fit(seen, None, wanted, rest_at, rng, rate, share, START_BATCH if steps else BATCH, most(len(wanted)), states[1])
        return len(losses)

    def kept_word_scores(self, own: Spelled, words: np.ndarray, kept: Kept) -> np.ndarray:
        """As word_scores, for all words of a slice (of these hashes, and the end); those that are kept aren't worked out again."""
        known, scores = kept.get(words)
        out, new = np.zeros(len(words) + 1), np.flatnonzero(~known)
        out[:-1][known] = scores
        if len(new):
            out[new] = self.word_scores(*_chosen(own.items, own.item_at, new))
            kept.put(words[new], out[new])
        return out

    def word_scores(self, items: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of each word's items after its first."""
        seen, wanted, rest_at = self.spelling_rows(items, at)
        if not len(wanted):
            return np.zeros(len(at) - 1)
        found = self.spelling.score_alike(self.rest.number[seen], self.rest.number[wanted], rest_at).astype(float) + self.rest.inside[wanted]
        total = np.concatenate(([0.0], np.cumsum(found)))
        return total[rest_at[1:]] - total[rest_at[:-1]]

    def scores(self, own: Spelled, counts: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of every token; counts: the distinct words' in learned texts; inside: their word_scores, if known."""
        seen, tails, wanted = self.context_rows(own)
        first = own.items[own.item_at[:-1]]
        known = self.context.score(seen, tails, wanted, own.at).astype(float) + self.first.inside[first][own.tokens]
        alone, total = self.last[first], self.firsts[first]
        e = np.where(alone, 0.0, np.where(total > 0, self.escape, 1.0))
        word = np.where(alone, 0.0, np.logaddexp(np.log(np.maximum((1 - e) * counts / np.maximum(total, 1), 1e-300)), np.log(np.maximum(e, 1e-300)) + (self.word_scores(own.items, own.item_at) if inside is None else inside)))
        place, before = own.earlier()
        mine = OWN * place / (place + OWN_AFTER)
        model = known + word[own.tokens] + np.log(1 - mine)
        return np.where(before > 0, np.logaddexp(model, np.log(np.maximum(mine * before / np.maximum(place, 1), 1e-300))), model) / np.log(10)


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def write_slices(docs: DataFrame, path: str, ranks_path: str) -> None:
    """Rows of slices: those of Spelled, with their documents' ids and which are held out; docs: doc_id, text, held."""
    kinds = {"slice": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.binary()} | {c: pa.binary() for c in Spelled.COLUMNS} | {"bytes": pa.int64(), "learned_tokens": pa.int64(), "learned_texts": pa.int64()}

    def run(batches):
        own_speller, number, waiting, size = speller(ranks_path), 0, [], 0

        def row():
            nonlocal number, waiting, size
            rows = pa.Table.from_batches(waiting).combine_chunks()
            data, _ = text_bytes(rows.column(1))
            number += 1
            name = hashlib.blake2b(data.tobytes() + f"{TaskContext.get().partitionId()} {number}".encode(), digest_size=8).digest()
            own = Spelled.of(rows.column(1), own_speller)
            held = rows.column(2).to_numpy().astype(bool)
            told = [int.from_bytes(name) >> 1, rows.column(0).to_pylist(), held.tobytes(), *own.packed(), len(data), int(np.diff(own.at)[~held].sum()), int((~held).sum())]
            waiting, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(told, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for piece in pieces(batch, "text", SLICE):
                own_size = len(text_bytes(piece.column(1))[0])
                if waiting and size + own_size > SLICE:
                    yield row()
                waiting.append(piece)
                size += own_size
        if waiting:
            yield row()

    named = {pa.int64(): "bigint", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    docs.mapInArrow(run, ", ".join(f"{c} {named[k]}" for c, k in kinds.items())).write.parquet(path)


def _learned(held) -> np.ndarray:
    return ~np.frombuffer(held.as_py(), bool)


def _cuts(home: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket, the buckets that have something, and where each one's part begins (one more at the end)."""
    order = np.argsort(home, kind="stable")
    full, at = np.unique(home[order], return_index=True)
    return order, full, np.append(at, len(home))


def hot_words(slices: DataFrame) -> np.ndarray:
    """Hashes (sorted) of words that are frequent in half of a few slices; which ones these are changes no result."""

    def run(batches):
        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                own = Spelled.read(*columns)
                counts = np.bincount(own.tokens, minlength=own.size + 1)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(own.hashes()[counts >= HOT_COUNT].view(np.int64))], names=["word"])

    few = slices.select(*Spelled.COLUMNS).limit(HOT_SLICES)
    found = few.mapInArrow(run, "word bigint").groupBy("word").count()
    rows = found.filter(F.col("count") >= (min(few.count(), HOT_SLICES) + 1) // 2).orderBy(F.desc("count"), "word").limit(HOT_WORDS).collect()
    return np.unique(np.array([r.word for r in rows], np.int64).view(U64))


def word_counts(slices: DataFrame, buckets: int, n_items: int, hot: np.ndarray) -> DataFrame:
    """What buckets tell: (slice, bucket, counts): a slice's words of a bucket, in their order there, have these counts in learned texts.

    Without slice: the hot words of a bucket with their counts, and its items with how often they are a token's first and another item.
    distinct, ones: of the bucket's words, those learned, and learned once; in one of its rows.
    """

    def send(batches):
        firsts, rests, often = np.zeros(n_items, np.int64), np.zeros(n_items, np.int64), np.zeros(len(hot), np.int64)
        for batch in batches:
            for name, held, *columns in zip(*batch.columns, strict=True):
                own = Spelled.read(*columns)
                counts, items, at, words = own.learned_counts(_learned(held)), own.items, own.item_at, own.hashes()
                firsts += np.bincount(items[at[:-1]], counts, len(firsts)).astype(np.int64)
                inside = np.ones(len(items), bool)
                inside[at[:-1]] = False
                rests += np.bincount(items[inside], np.repeat(counts, np.diff(at))[inside], len(rests)).astype(np.int64)
                place = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
                is_hot = hot[place] == words if len(hot) else np.zeros(len(words), bool)
                often[place[is_hot]] += counts[:-1][is_hot]
                words, counts = words[~is_hot], counts[:-1][~is_hot]
                order, full, cuts = _cuts((words % U64(buckets)).astype(np.int64), buckets)
                parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(full), pa.int64()), pa.array(full.astype(np.int32)), pa.array([words[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.int32).tobytes() for p in parts], pa.binary()), *(pa.nulls(len(full), pa.binary()) for _ in "ab")],
                    names=["slice", "bucket", "words", "counts", "items", "item_counts"],
                )
        for values, totals, names in ((hot, often[:, None], ("words", "counts")), (np.arange(len(firsts)), np.stack((firsts, rests), axis=1), ("items", "item_counts"))):
            some = np.flatnonzero(totals.any(axis=1))
            if len(some):
                order, full, cuts = _cuts((values[some] % values.dtype.type(buckets)).astype(np.int64), buckets)
                parts = [some[order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = {"slice": pa.nulls(len(full), pa.int64()), "bucket": pa.array(full.astype(np.int32))} | {x: pa.nulls(len(full), pa.binary()) for x in ("words", "counts", "items", "item_counts")}
                columns |= {names[0]: pa.array([values[p].astype(np.int64 if names[0] == "items" else U64).tobytes() for p in parts], pa.binary()), names[1]: pa.array([totals[p].astype(np.int64).tobytes() for p in parts], pa.binary())}
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    def add(batches):
        bucket, rows, often, items = None, [], {}, {}

        def flush():
            words = np.concatenate([np.zeros(0, U64), *(np.frombuffer(w, U64) for _, w, _ in rows)])
            counts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(c, np.int32) for _, _, c in rows)])
            _, which = np.unique(words, return_inverse=True)
            total = np.bincount(which, counts).astype(np.int64)
            at, out = 0, []
            for _, w, _ in rows:
                out.append(total[which[at : at + len(w) // 8]].astype(np.int64).tobytes())
                at += len(w) // 8
            hot_totals = np.array(list(often.values()), np.int64)
            distinct = int((total > 0).sum() + (hot_totals > 0).sum())
            ones = int((total == 1).sum() + (hot_totals == 1).sum())
            names, n = [*(s for s, _, _ in rows), None], len(rows)
            pairs = np.array([[*x] for x in items.values()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*out, hot_totals.tobytes()], pa.binary()), pa.array([*[None] * n, np.array(list(often), U64).tobytes()], pa.binary()),
                    pa.array([*[None] * n, np.array(list(items), np.int64).tobytes()], pa.binary()), pa.array([*[None] * n, pairs.tobytes()], pa.binary()), pa.array([*[0] * n, distinct], pa.int64()), pa.array([*[0] * n, ones], pa.int64()),
                ],
                names=["slice", "bucket", "counts", "words", "items", "item_counts", "distinct", "ones"],
            )

        for batch in batches:
            for name, b, words, counts, ids, id_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and bucket is not None:
                    yield flush()
                    rows, often, items = [], {}, {}
                bucket = b
                if name is not None:
                    rows.append((name, words, counts))
                elif words is not None:
                    for w, c in zip(np.frombuffer(words, U64).tolist(), np.frombuffer(counts, np.int64).tolist(), strict=True):
                        often[w] = often.get(w, 0) + c
                else:
                    for i, (f, r) in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(id_counts, np.int64).reshape(-1, 2).tolist(), strict=True):
                        was = items.get(i, (0, 0))
                        items[i] = (was[0] + f, was[1] + r)
        if bucket is not None:
            yield flush()

    sent = slices.select("slice", "held", *Spelled.COLUMNS).mapInArrow(send, "slice bigint, bucket int, words binary, counts binary, items binary, item_counts binary")
    told = "slice bigint, bucket int, counts binary, words binary, items binary, item_counts binary, distinct bigint, ones bigint"
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, told).transform(cut)


def train(slices: DataFrame, model: Model, train_share: float = TRAIN_SHARE, start_steps: int = START_STEPS) -> None:
    """Trains the model's two networks on the slices' learned texts."""
    spark = slices.sparkSession
    held = spark.sparkContext.broadcast(model)  # of fixed size
    columns = ["slice", "held", *Spelled.COLUMNS]

    def start(batches):
        rows = sorted(((name.as_py(), _learned(kept_out), Spelled.read(*own)) for batch in batches for name, kept_out, *own in zip(*batch.columns, strict=True)), key=lambda r: r[0])
        if rows:
            own_model = held.value
            own_model.fit(Spelled.joined([own for _, _, own in rows]), np.concatenate([told for _, told, _ in rows]), np.random.default_rng(1), START_RATE, 1.0, start_steps)
            yield pa.RecordBatch.from_arrays([pa.array([own_model.weights().tobytes()], pa.binary())], names=["weights"])

    learned = slices.filter("learned_tokens > 0")
    # Slices drawn by their hashes with chances in proportion to their tokens, until they have SLICE bytes together.
    race = F.expr("-ln((pmod(slice, 1073741789) + 1) / 1073741790) / learned_tokens")
    drawn = learned.select("slice", "bytes", race.alias("race")).orderBy("race", "slice").limit(START_SLICES).collect()
    before = np.cumsum([0, *(r.bytes for r in drawn)])
    drawn = [r.slice for r, size in zip(drawn, before, strict=False) if size < SLICE]
    if not drawn:
        return
    rows = learned.filter(F.col("slice").isin(drawn)).select(columns).repartition(1).mapInArrow(start, "weights binary").collect()  # of the model's size
    begun = np.frombuffer(rows[0].weights, np.float32)
    model.load(begun)
    held = spark.sparkContext.broadcast(model)
    each = -(-len(begun) // SHARDS)

    def learn(batches):
        own_model, seen, states, name = held.value, 0, ({}, {}), 0
        own_model.load(begun)
        for batch in batches:
            for name, kept_out, *own in zip(*batch.columns, strict=True):
                name = name.as_py()
                seen += own_model.fit(Spelled.read(*own), _learned(kept_out), np.random.default_rng(name), RATE, train_share, None, states)
        if seen:
            change = (own_model.weights() - begun).astype(np.float16)
            own_model.load(begun)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SHARDS, dtype=np.int32)), pa.array([int(name % 64)] * SHARDS, pa.int32()), pa.array([float(seen)] * SHARDS), pa.array([change[k * each : (k + 1) * each].astype(np.float16).tobytes() for k in range(SHARDS)], pa.binary())],
                names=["shard", "part", "weight", "change"],
            )

    schema = "shard int, part int, weight double, change binary"

    def mean(batches):
        at, total, weight = None, None, 0.0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float16).tobytes()], pa.binary())], names=["shard", "part", "weight", "change"])

        for batch in batches:
            for shard, part, w, change in zip(*batch.columns, strict=True):
                key = (shard.as_py(), part.as_py())
                if key != at:
                    if at is not None:
                        yield row()
                    at, total, weight = key, 0.0, 0.0
                total = total + np.frombuffer(change.as_py(), np.float16).astype(np.float64) * w.as_py()
                weight += w.as_py()
        if at is not None:
            yield row()

    # Summed in parts first, so that no task gets a row from every other.
    sums = learned.select(columns).mapInArrow(learn, schema).repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(mean, schema)
    sums = sums.withColumn("part", F.lit(0)).repartition("shard").sortWithinPartitions("shard").mapInArrow(mean, schema)
    found = {r.shard: np.frombuffer(r.change, np.float16).astype(np.float32) for r in sums.collect()}  # of the model's size
    model.load(begun + np.concatenate([found[k] for k in sorted(found)]))


def learn_corpus(docs: DataFrame, ranks_path: str, train_share: float = TRAIN_SHARE, **options) -> tuple[DataFrame, DataFrame, int, np.ndarray, np.ndarray, Model]:
    """The slices, what the buckets tell, their number, the hot words and their counts, and the trained model; docs: doc_id, text, held."""
    spark = docs.sparkSession
    path = table_path(spark, "slices")
    write_slices(docs, path, ranks_path)
    slices = spark.read.parquet(path)
    totals = slices.agg(F.sum("bytes").alias("bytes"), F.sum("learned_tokens").alias("n"), F.sum("learned_texts").alias("texts")).first()
    buckets = max(8, -(-(totals.bytes or 0) // BUCKET))
    hot = hot_words(slices)
    size = speller(ranks_path).items
    counts = word_counts(slices, buckets, size, hot)
    seen = counts.agg(F.sum("distinct").alias("v"), F.sum("ones").alias("ones")).first()
    pairs, often = np.zeros((size, 2), np.int64), np.zeros(len(hot), np.int64)
    for r in counts.filter("slice is null").select("words", "counts", "items", "item_counts").toLocalIterator():  # at most all items and HOT_WORDS words
        pairs[np.frombuffer(r.items, np.int64)] = np.frombuffer(r.item_counts, np.int64).reshape(-1, 2)
        often[np.searchsorted(hot, np.frombuffer(r.words, U64))] = np.frombuffer(r.counts, np.int64)
    model = Model(pairs[:, 0], pairs[:, 1], totals.n or 0, (seen.v or 0) + ((totals.texts or 0) > 0), seen.ones or 0)
    model.texts = totals.texts or 0
    train(slices, model, train_share, **options)
    return slices, counts, buckets, hot, often, model


def score_texts(docs: DataFrame, ranks_path: str, train_share: float = TRAIN_SHARE, doc_id="doc_id", text="text", **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = only(docs, doc_id=doc_id, text=text).withColumn("held", is_held_out(F.col("doc_id")))
    return score_slices(*learn_corpus(docs, ranks_path, train_share, **options))


_KEPT_SCORES: dict[str, Kept] = {}


def kept_scores(model: str) -> Kept:
    """This process's table of word scores under the model of that name; the table of another model goes."""
    if model not in _KEPT_SCORES:
        _KEPT_SCORES.clear()
        _KEPT_SCORES[model] = Kept(scores=(np.float64,))
    return _KEPT_SCORES[model]


def score_slices(slices: DataFrame, counts: DataFrame, buckets: int, hot: np.ndarray, often: np.ndarray, model: Model) -> DataFrame:
    held_model = slices.sparkSession.sparkContext.broadcast((model, hot, often))  # of fixed size
    name = hashlib.blake2b(model.weights().tobytes() + model.firsts.tobytes() + model.rests.tobytes()).hexdigest()

    def run(batches):
        model, hot, often = held_model.value
        kept = kept_scores(name)
        for batch in batches:
            for doc_ids, held, own_counts, *columns in zip(*batch.columns, strict=True):
                own = Spelled.read(*columns)
                words = own.hashes()
                c = np.zeros(own.size + 1, np.int64)
                c[-1] = model.texts
                place = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
                is_hot = hot[place] == words if len(hot) else np.zeros(len(words), bool)
                c[:-1][is_hot] = often[place[is_hot]]
                other = np.flatnonzero(~is_hot)
                order, full, cuts = _cuts((words[other] % U64(buckets)).astype(np.int64), buckets)
                where = {b: order[x:y] for b, x, y in zip(full.tolist(), cuts, cuts[1:], strict=False)}
                for part in own_counts.as_py() or ():
                    c[other[where[part["bucket"]]]] = np.frombuffer(part["counts"], np.int64)
                score = model.scores(own, c, model.kept_word_scores(own, words, kept))
                c = c[own.tokens]
                base = np.log10((c + 1) / (model.n + model.v + 1))
                known, base, score = (np.add.reduceat(x, own.at[:-1]) for x in ((c > 0).astype(np.int64), base, score))
                size = np.diff(own.at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.as_py(), pa.int64()), pa.array(np.frombuffer(held.as_py(), bool)), pa.array(size), pa.array(known),
                        pa.array(np.full(len(size), model.n, np.int64)), pa.array(base), pa.array(score),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    back = counts.filter("slice is not null").groupBy(F.col("slice").alias("of")).agg(F.collect_list(F.struct("bucket", "counts")).alias("back"))
    joined = slices.join(back, F.col("slice") == F.col("of"), "left").select("doc_ids", "held", "back", *Spelled.COLUMNS)
    return joined.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
