"""Splitting of text into pre-tokens, for whole batches at once.

The rules are those of public_tokenizers.PATTERN: contractions, runs of letters, numbers or other signs with
one leading space, and blanks, of which a run leaves its last sign to what follows. With `spaced=False` they are
those of word-level BPE files: no leading spaces, each number sign alone, blanks dropped.

Which code points are letters, numbers and blanks depends on a library's Unicode version; the tables are asked
from the library itself.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, BLANK = range(4)
PATTERNS = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s"))


def _table(matches) -> np.ndarray:
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code, pattern in PATTERNS:
        table[np.frombuffer(matches(pattern, points).encode("utf-32-le"), np.uint32)] = code
    return table


@cache
def tiktoken_classes() -> np.ndarray:
    """The class of every code point for the tiktoken library."""
    import tiktoken

    def matches(pattern: str, points: str) -> str:
        single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return bytes(single.encode_ordinary(points)).decode()

    return _table(matches)


@cache
def tokenizers_classes() -> np.ndarray:
    """The class of every code point for the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return _table(lambda pattern, points: "".join(x for x, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(points)))


def split_pattern(texts: list[str], classes: np.ndarray, spaced: bool = True) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts in one list, and where each text's begin (one more at the end)."""
    whole = "".join(texts)
    n = len(whole)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    if not n:
        return [], np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[points]
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    start = np.zeros(n + 1, bool)
    start[at] = True
    begins |= start
    if spaced:
        after = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~start[1:n]) + 1
        begins[after - 1] = True
        begins[after[points[after - 1] == 32]] = False
    else:
        begins[:n] |= kind == NUMBER
    quotes = np.flatnonzero((points[:-1] == 39) & begins[: n - 1] & (kind[1:] == LETTER) & ~start[1:n])
    for i in quotes.tolist():
        ahead = whole[i + 1 : i + 3]
        size = 1 if ahead[0] in "stmd" else 2 if ahead in ("re", "ve", "ll") and not start[i + 2] else 0
        if size:
            begins[i + 1] = False
            begins[i + 1 + size] = True
    cuts = np.flatnonzero(begins)
    firsts, ends = cuts[:-1], cuts[1:]
    if not spaced:
        solid = kind[firsts] != BLANK
        firsts, ends = firsts[solid], ends[solid]
    return [whole[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)], np.searchsorted(firsts, at)
