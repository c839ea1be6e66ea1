"""Exact token counts of every prefix of a text, for a word-level BPE file of the tokenizers library.

Words are encoded independently, so a prefix has the tokens of its whole words and those of the word it cuts. For
every different word a dynamic program over its bytes finds the last token of each prefix: a token t that ends
there follows the encoding of what precedes it exactly if the merges leave the pair (its last token, t) as it is.
One such t exists, and counts follow. As a word's end changes its last token, each place has two answers: inside a
longer word, which the next places build on, and as the word's end, which is the count of the prefix. With the
table of counts, truncation to a budget and budget questions need no further encoding. Counts of whole texts ask for
the second answer at words' ends only; all of them are worked out for the word that a budget cuts.

Prefixes are those of the text as the library normalises it. Strings of special tokens in a text count as one
token, as the library has it by default; prefixes that cut such a string are not offered. Null texts are empty;
texts may be of any length; rows that repeat and rows without id are counted each; an empty table has an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelathe.llm.columns import Kept, by_batch, only
from tracelathe.llm.pretokens import split_pattern, tokenizers_classes

#: Bytes of resolved words that a worker keeps at most.
KEPT_BYTES = 170 << 20
#: Decided borders that a worker keeps at most.
KEPT = 800_000
END = "</w>"
#: The normalizer whose work on ASCII is done here, and the blanks that it changes.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BLANKS = re.compile("[\t-\r ]{2,}|[\t-\r]")
#: Signs beyond ASCII with the ASCII sign before them, which they may be composed with; shorter runs than RUN are kept.
BEYOND = re.compile("([\x00-\x7f]?[^\x00-\x7f]+)")
RUN = 32


class PrefixCounter:
    """Counts for one tokenizer file (BPE over bytes, words ending in "</w>")."""

    def __init__(self, path: str, classes: np.ndarray | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as text:
            spec = json.load(text)
        if spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != END:
            raise ValueError("a BPE file with word ends is needed")
        self.library = Tokenizer.from_file(path).normalizer.normalize_str
        self.usual, self.runs = spec["normalizer"] == NORMALIZER, {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.classes = tokenizers_classes() if classes is None else classes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.spell = {b: s for b, s in spelled.items()}
        # Tokens are numbered by age: single bytes, then what the merges make, in their order.
        age: dict[str, int] = {}
        for s in spelled.values():
            age[s] = len(age)
        for s in spelled.values():
            age[s + END] = len(age)
        self.singles = len(age)
        self.made: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(age))]
        for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            i = age.setdefault(a + b, len(age))
            if i == len(self.halves):
                self.halves.append((age[a], age[b]))
                self.made[age[a], age[b]] = i
        inner = {x: i for x, i in age.items() if not x.endswith(END)}
        final = {x[: -len(END)]: i for x, i in age.items() if x.endswith(END)}
        #: For a spelling its token inside a word and its token at a word's end (-1: none).
        self.tokens = {x: (inner.get(x, -1), final.get(x, -1)) for x in inner | final}
        self.longest = max(map(len, self.tokens))
        self.fits: dict[int, bool] = {}
        self.kept = Kept(KEPT_BYTES)

    def normalize(self, text: str) -> str:
        """The text as the library normalizes it, which is asked for signs beyond ASCII only: no ASCII sign is composed with what precedes it."""
        if not self.usual:
            return self.library(text)
        if text.isascii():
            return BLANKS.sub(" ", text).lower()
        parts, runs = BEYOND.split(text), self.runs
        if len(runs) > KEPT >> 3:
            runs.clear()
        for i, x in enumerate(parts):
            if i & 1:
                known = runs.get(x)
                if known is None:
                    known = self.library(x)
                    if len(x) < RUN:
                        runs[x] = known
                parts[i] = known
            else:
                parts[i] = x.lower()
        return BLANKS.sub(" ", "".join(parts))  # blanks of both kinds may meet

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves token a and then token b side by side: no merge crosses their border in time."""
        made, halves, singles = self.made.get, self.halves, self.singles
        limit = 1 << 60
        while True:
            if made((a, b), limit) < limit:
                return False
            # The younger of the two was made last; before that its part at the border stood there.
            if a >= singles and (a > b or b < singles):
                limit, a = a, halves[a][1]
            elif b >= singles:  # of equal merges the left one comes first, so one across the border precedes b's own
                limit, b = b + 1, halves[b][0]
            else:
                return True

    def prefixes(self, word: str) -> bytes:
        """Token counts (packed u32) of the word's prefixes of 1, 2, ... characters."""
        raw = word.encode()
        text = raw.decode("latin-1").translate(self.spell)
        n, longest = len(text), self.longest
        token, fits, fit = self.tokens.get, self.fits, self._fit
        last, count = [-1] * (n + 1), [0] * (n + 1)
        out = []
        for j in range(1, n + 1):
            inside = j < n
            ending = not inside or raw[j] & 0xC0 != 0x80  # a character ends here
            for i in range(j - longest if j > longest else 0, j):
                found = token(text[i:j])
                if found is None:
                    continue
                t, f = found
                if inside and t >= 0 and (not i or fits.get(last[i] << 20 | t) or fit(last[i], t, fits)):
                    last[j], count[j] = t, count[i] + 1
                    inside = False
                if ending and f >= 0 and (not i or fits.get(last[i] << 20 | f) or fit(last[i], f, fits)):
                    out.append(count[i] + 1)
                    ending = False
                if not inside and not ending:
                    break
        if word[0] == "'" and word in ("'re", "'ve", "'ll"):  # a shorter prefix of these is two words
            out[1] = out[0] + self.total(word[1])
        return np.array(out, "<u4").tobytes()

    def _fit(self, a: int, b: int, fits: dict[int, bool]) -> bool:
        key = a << 20 | b
        known = fits.get(key)
        if known is None:
            if len(fits) > KEPT:
                fits.clear()
            known = fits[key] = self.apart(a, b)
        return known

    def total(self, word: str) -> int:
        return int(np.frombuffer(self.prefixes(word), "<u4")[-1])

    def totals(self, words: list[str]) -> list[bytes]:
        """Token counts (packed u32) of whole words, without those of their prefixes: only a word's own end is asked for.

        What precedes a place decides its last token inside a word, so words in order share the places of what they begin with alike.
        """
        longest, token, fits, fit = self.longest, self.tokens.get, self.fits, self._fit
        order = sorted(range(len(words)), key=words.__getitem__)
        out = [b""] * len(words)
        before, last, count = "", [-1], [0]
        for k in order:
            text = words[k].encode().decode("latin-1").translate(self.spell)
            n, same = len(text), 0
            most = min(n, len(before)) - 1  # the last place of the word before has no token inside
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for j in range(same + 1, n):
                t, c = -1, 0
                for i in range(j - longest if j > longest else 0, j):
                    found = token(text[i:j])
                    if found is None or found[0] < 0:
                        continue
                    if i:
                        known = fits.get(last[i] << 20 | found[0])
                        if known is None:
                            known = fit(last[i], found[0], fits)
                        if not known:
                            continue
                    t, c = found[0], count[i] + 1
                    break
                last.append(t)
                count.append(c)
            for i in range(n - longest if n > longest else 0, n):
                found = token(text[i:])
                if found is not None and found[1] >= 0 and (not i or fits.get(last[i] << 20 | found[1]) or fit(last[i], found[1], fits)):
                    out[k] = (count[i] + 1).to_bytes(4, "little")
                    break
            before = text
        return out

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return split_pattern(texts, self.classes, spaced=False)

    def counts(self, words: list[str]) -> np.ndarray:
        """The tokens of every word."""
        self.kept.trim()
        new = list(set(words).difference(self.kept.table))
        for word, packed in zip(new, self.totals(new), strict=True):
            self.kept.add(word, packed)
        return np.frombuffer(b"".join(map(self.kept.table.__getitem__, words)), "<u4").astype(np.int64)

    def segments(self, text: str) -> list[str]:
        """The text, normalised, parted at the strings of special tokens."""
        parts = [text]
        for s in self.special:
            parts = [y for x in parts for y in x.split(s)]
        return [self.normalize(x) for x in parts]

    def prefix_table(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... characters of a normalised text without special strings."""
        words, _ = self.words([text])
        out, at, before = np.zeros(len(text) + 1, np.int64), 0, 0
        own = {word: np.frombuffer(self.prefixes(word), "<u4") for word in set(words)}
        for word in words:
            begin = text.index(word, at)
            out[at + 1 : begin + 1] = before
            at = begin + len(word)
            out[begin + 1 : at + 1] = before + own[word]
            before = int(out[at])
        out[at + 1 :] = before
        return out

    def answer(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """Per text: its tokens, and the most characters (of the normalised text) that a prefix of at most `limit` tokens has."""
        segments = [self.segments(x) for x in texts]
        flat = [x for own in segments for x in own]
        words, at = self.words(flat)
        totals = self.counts(words)
        out, k = [], 0
        for own in segments:
            n, cut, done, chars = 0, 0, False, 0
            for s, segment in enumerate(own):
                if s:  # the special string itself
                    n += 1
                    done = done or n > limit
                a, b = int(at[k]), int(at[k + 1])
                k += 1
                ends = n + np.cumsum(totals[a:b])
                if not done:
                    over = int(np.searchsorted(ends, limit, "right"))
                    if over == b - a:
                        cut = chars + len(segment)
                    else:
                        done = True
                        begin = chars
                        place = 0
                        for word in words[a : a + over + 1]:
                            found = segment.index(word, place)
                            place = found + len(word)
                        inside = np.frombuffer(self.prefixes(words[a + over]), "<u4") + (int(ends[over - 1]) if over else n)
                        good = np.flatnonzero(inside <= limit)
                        cut = begin + (found + int(good[-1]) + 1 if len(good) else found)
                n = int(ends[-1]) if b > a else n
                chars += len(segment)
            out.append((n, cut))
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str, classes: np.ndarray | None = None) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path, classes)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, and cut_chars, where a budget of `limit` tokens ends."""
    classes = docs.sparkSession.sparkContext.broadcast(tokenizers_classes())  # one byte per code point

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n, cut = (np.array(x, np.int64) for x in zip(*counter(tokenizer, classes.value).answer(texts, limit), strict=True))
        size = pa.array([len(x.encode()) for x in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit), pa.array(cut)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(by_batch(work), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint")


def prefix_tables(docs: DataFrame, tokenizer: str, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id and the counts of all prefixes, 0 characters first, of its normalised text.

    Special strings are treated as ordinary text here, so that every prefix has a count.
    """
    classes = docs.sparkSession.sparkContext.broadcast(tokenizers_classes())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(tokenizer, classes.value)
        tables = [own.prefix_table(own.normalize(x or "")).tolist() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(by_batch(work), "doc_id bigint, counts array<bigint>")

