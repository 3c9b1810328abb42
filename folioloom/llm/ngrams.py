"""Tokens of texts in any script as arrays, and counts of their n-grams in tables of fixed size.

A token is a word, or a single character of a script that is written without blanks.  Tokens
are hashed without loops over characters: a polynomial hash of prefixes, modulo 2^64.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Sizes of the tables of single tokens and of pairs.
ONES, PAIRS = 1 << 16, 1 << 19
#: Blocks of the one table: tokens, those that begin and end a sentence, those followed by another, pairs.
STARTS, ENDS, FOLLOWED, TWOS = ONES, 2 * ONES, 3 * ONES, 4 * ONES
TABLE = 4 * ONES + PAIRS
#: Characters whose arrays are in memory at once.
STRETCH = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OTHER, LETTER, ALONE, MARK, BREAK = range(5)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of the characters of the basic plane."""
    kind, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.category(c)[0] in "LMN":
            kind[i] = LETTER
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
    for first, last in ((0x0E00, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)):
        kind[first : last + 1][kind[first : last + 1] == LETTER] = ALONE
    for c in ".．。｡!！?？…؟۔।॥":
        kind[ord(c)] = MARK
    for c in "\n\r\x0b\x0c\x85  ":
        kind[ord(c)] = BREAK
    return kind, lower


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray  # 64-bit hashes
    mark: np.ndarray  # whether a terminal mark stands between a token and the next
    line: np.ndarray  # whether a line ends there

    @property
    def one(self) -> np.ndarray:
        return (self.key >> np.uint64(40)).astype(np.int64) % ONES

    def two(self) -> np.ndarray:
        """The slot of each token with the next one."""
        k = self.key[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ self.key[1:]
        k *= np.uint64(0x165667B19E3779F9)
        return (k >> np.uint64(36)).astype(np.int64) % PAIRS


def tokens(text: str) -> Tokens:
    kind_of, lower_of = _classes()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(code, 0xFFFF)
    kind = kind_of[low]
    wide = code > 0xFFFF
    if wide.any():
        kind = np.where(wide, np.where((code >= 0x20000) & (code < 0x40000), ALONE, OTHER), kind)
        code = np.where(wide, code, lower_of[low])
    else:
        code = lower_of[low]
    letter = np.concatenate([[False], kind == LETTER, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    alone = np.flatnonzero(kind == ALONE)
    start = np.concatenate([edge[::2], alone])
    end = np.concatenate([edge[1::2], alone + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    up, down = _powers(1 << max(len(code), 1).bit_length())
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])])
        key = (prefix[end] - prefix[start]) * down[start]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
    after = np.concatenate([start[1:], [len(code)]]).astype(np.int64) if len(start) else start
    marks, breaks = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (MARK, BREAK))
    return Tokens(start, end, key, marks[after] > marks[end], breaks[after] > breaks[end])


def stretches(text: str) -> Iterator[tuple[Tokens, bool, bool]]:
    """(tokens, whether the first has been seen, whether more follow) of bounded stretches of a text.

    A stretch begins with the last token of the one before, so no pair is lost or seen twice.
    """
    at, size, seen = 0, STRETCH, False
    while at < len(text):
        t = tokens(text[at : at + size])
        if at + size >= len(text):
            yield t, seen, False
            return
        if len(t.start) < 3:
            size *= 2
            continue
        # The last token may go on; the one before it is whole and comes again.
        whole = Tokens(t.start[:-1], t.end[:-1], t.key[:-1], t.mark[:-1], t.line[:-1])
        yield whole, seen, True
        at, size, seen = at + int(t.start[-2]), STRETCH, True


def count(text: str, table: np.ndarray) -> None:
    """Adds the tokens of a text, lines apart, to a table of `TABLE` counts."""
    for t, seen, more in stretches(text):
        n = len(t.start)
        if not n:
            continue
        one, cut = t.one, t.mark | t.line
        new = np.ones(n, bool)
        new[0] = not seen
        table[:ONES] += np.bincount(one[new], minlength=ONES)
        starts = np.concatenate([[not seen], cut[:-1]])
        table[STARTS:ENDS] += np.bincount(one[starts], minlength=ONES)
        # The last token's gap is told by the stretch that begins with it.
        last = n - 1 if more else n
        ends = cut.copy()
        ends[-1] |= not more
        table[ENDS:FOLLOWED] += np.bincount(one[:last][ends[:last]], minlength=ONES)
        within = ~cut[:-1]
        table[FOLLOWED:TWOS] += np.bincount(one[:-1][within], minlength=ONES)
        table[TWOS:] += np.bincount(t.two()[within], minlength=PAIRS)


@dataclass
class Model:
    """A hidden-event model of pairs: log-odds of a sentence boundary between two tokens."""

    end: np.ndarray  # log-odds that a token is the last of its sentence
    start: np.ndarray  # log P(token | begin of a sentence)
    one: np.ndarray  # P(token)
    followed: np.ndarray  # how often a token is followed by another
    two: np.ndarray  # how often by this one
    length: float  # tokens of a sentence, on average

    def odds(self, t: Tokens) -> np.ndarray:
        """For each gap between two tokens."""
        a, b = t.one[:-1], t.one[1:]
        seen, pair = self.followed[a], self.two[t.two()]
        inside = np.log((np.minimum(pair, seen) + PRIOR * self.one[b]) / (seen + PRIOR))
        return self.end[a] + self.start[b] - inside


#: Observations that the distribution of all tokens counts for beside those after one token.
PRIOR = 5.0


def model(table: np.ndarray) -> Model:
    n = table.astype(np.float64)
    one, starts, ends, followed, two = n[:STARTS], n[STARTS:ENDS], n[ENDS:FOLLOWED], n[FOLLOWED:TWOS], n[TWOS:]
    p = (one + 0.1) / (one.sum() + 0.1 * ONES)
    usual = (ends.sum() + 1) / (ends.sum() + followed.sum() + 10)
    e = (ends + PRIOR * usual) / (ends + followed + PRIOR)
    first = (starts.sum() + 1) / (one.sum() + 10)
    begin = p * (starts + PRIOR * first) / ((one + PRIOR) * first)
    return Model(
        np.log(e / (1 - e)).astype(np.float32), np.log(begin).astype(np.float32), p.astype(np.float32),
        followed.astype(np.float32), two.astype(np.float32), float((one.sum() + 10) / (starts.sum() + 1)))
