"""Sentences of two languages that are translations of each other, paired within a chapter.

Method: length-based dynamic programming.  The ratio of the lengths of two renderings is
modelled as a normal variable of the standardised difference, with the mean ratio and the
variance estimated over all chapters; the optimal path over one-to-one, omission, merge,
split and crossed beads is found for each chapter.  Lengths alone lose the way after an
omission, so the first path only teaches which words of one side go with which characters of
the other (association over all chapters, in tables of fixed size); the path is then found
again with both, twice.

The units of the path are clauses: a sentence that merges several others then needs no bead
of its own size, and is paired with each of its counterparts.  The pairs are those of the
path's beads whose words agree better than nearly all clauses that can't be renderings.
What was reordered lies off the path: a path is found again through the clauses left over, in
which leaving one out costs nothing, and again, until it finds no further pair.

A chapter of more than `PART` sentences on a side isn't held by one task.  Parts of the same
relative position are aligned first, with half a part more on both sides; then every part of
the clauses left over with every such part of the other side, until no pair is found: so
every clause has met every one of the other side that is left, however far it has moved.

Defined results: repeated rows count once; null or blank texts, and chapters with one side
only, have no pairs; equal sentences are told apart by their order, those without an order
come last; rows without chapter, id or language take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, once, ranked, table

#: Sizes of the hashed vocabularies: words of the second side, character pairs of the first.
WORDS, PAIRS = 1 << 11, 1 << 12
#: A stretch between commas found in this share of the chapters is a stock phrase.
STOCK_SHARE = 0.02
#: Beads (first side, second side) with their prior probabilities; crossed is two-to-two in reverse.
BEADS = {(1, 1): 0.82, (1, 0): 0.06, (0, 1): 0.06, (2, 1): 0.02, (1, 2): 0.02}
CROSSED = 0.02
#: What equal or different numbers add to an agreement or take from it.
NUMBER = 0.3
#: A pair on the path may agree less by this much.
ON_PATH = 0.08
#: On the path, agreement counts this much, above what neither speaks for a pair nor against it.
GAIN, NEUTRAL = 6.0, 0.55
#: Share of the pairs that can't be renderings allowed above the cut.
CHANCE = 0.0015
#: What distance in the chapter takes from a pair's agreement off the path.
FAR = 0.1
#: Sentences of a side aligned at once, and clauses of the parts of longer chapters.
PART = 1000
#: Weight of the side of which more is explained.
SHORTER = 0.75

SEGMENT = re.compile(r"[^，；,;]+(?:[，；]+|[,;]+(?=[\s”\"’»]|$)|[,;])?[”\"’»」]*")
WORD = re.compile(r"[^\W\d_]+|\d+")
HAN_RUN = re.compile(r"[㐀-鿿]+|\d+")
_NUMERAL = "〇零一二两三四五六七八九十百千"
NUMBER_HAN = re.compile(rf"(?<![期拜周第{_NUMERAL}])(?:\d+|[{_NUMERAL}]+)")
_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
# English numerals.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_ENGLISH = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}


def han_number(s: str) -> int:
    if s.isdigit():
        return int(s)
    total, digit = 0, 0
    for c in s:
        if c in "十百千":
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
        else:
            digit = _DIGIT[c] if c in _DIGIT else 0
    return total + digit


def numbers(text: str, han: bool) -> frozenset[int]:
    """The numbers in a text that a translation keeps; one and two are left out: an article, and a pair."""
    if han:
        return frozenset(n for m in NUMBER_HAN.finditer(text) if (n := han_number(m.group())) > 2)
    out, last = set(), None
    for m in WORD.finditer(text.lower()):
        w = m.group()
        n = int(w) if w.isdigit() and len(w) < 10 else _ENGLISH.get(w)
        if n is None:
            last = None
        elif last is not None and last >= 20 and last % 10 == 0 and 0 < n < 10 and not w.isdigit():
            out.discard(last)
            out.add(last + n)
            last = None
        else:
            out.add(n)
            last = n if not w.isdigit() else None
    return frozenset(n for n in out if n > 2)


def phrase(segment: str) -> str:
    """A segment without marks, case and a leading conjunction."""
    s = re.sub(r"[\W_]+", " ", segment.lower()).strip()
    return re.sub(r"^(?:and|then|but|y|e)\s+(?:then\s+)?", "", s)


def segments(text: str) -> list[str]:
    return [m.group() for m in SEGMENT.finditer(text) if m.group().strip()]


def clauses(text: str, stock: dict[str, bool]) -> list[str]:
    """The clauses of a sentence: each a segment that says something, with its stock phrases.

    `stock` has the stock phrases; True for those that lead the clause after them.
    """
    out: list[str] = []
    lead = ""
    for s in segments(text):
        p = phrase(s)
        short = len(p) < 6 if re.search("[㐀-鿿]", p) else len(p.split()) < 3
        if p in stock or short:
            if out and not lead and not stock.get(p, True):
                out[-1] += s
            else:
                lead += s
        else:
            out.append(lead + s)
            lead = ""
    if lead:
        if out:
            out[-1] += lead
        else:
            out.append(lead)
    return out


@dataclass
class Unit:
    sentence: int
    length: int
    slots: np.ndarray
    numbers: frozenset


def units(ids: list[int], texts: list[str], han: bool, stock: dict[str, bool], cut: bool = False) -> list[Unit]:
    """The clauses of texts, or the texts themselves if they are `cut` into clauses already."""
    out = []
    for i, text in zip(ids, texts):
        for c in [text] if cut else clauses(text, stock):
            if han:
                keys = {run[k : k + 2] for m in HAN_RUN.finditer(c) for run in [m.group()] for k in range(max(1, len(run) - 1))}
                slots = sorted({crc32(k.encode()) % PAIRS for k in keys})
            else:
                slots = sorted({crc32(m.group().encode()) % WORDS for m in WORD.finditer(c.lower())})
            if slots:
                out.append(Unit(i, len(c.strip()), np.array(slots), numbers(c, han)))
    return out


@dataclass
class Model:
    stock: dict[str, bool]
    ratio: float  # characters of the second side for one of the first
    spread: float  # variance of the standardised difference, for each character of the first side
    at: np.ndarray | None = None  # word * PAIRS + pair, of the associated ones
    bits: np.ndarray | None = None  # their association in bits
    weight_word: np.ndarray | None = None  # (WORDS,) information of a word
    weight_pair: np.ndarray | None = None  # (PAIRS,) information of a character pair
    cut: float = 0.65  # agreement that chance pairs hardly reach

    @cached_property
    def assoc(self) -> np.ndarray:
        """(WORDS, PAIRS), made where it is used: what travels are the pairs that are associated."""
        dense = np.zeros(WORDS * PAIRS, np.float32)
        dense[self.at] = self.bits
        return dense.reshape(WORDS, PAIRS)


def agreement(first: list[Unit], second: list[Unit], m: Model) -> np.ndarray:
    """(first, second): how much of the information of each is accounted for by the other.

    What a token says is its information; what the other side explains of it is their pointwise
    mutual information.  The side that says less is the better witness, as a rendering may
    leave details out.
    """
    words, wi = np.unique(np.concatenate([u.slots for u in second]), return_inverse=True)
    pairs, pi = np.unique(np.concatenate([v.slots for v in first]), return_inverse=True)
    at_a = np.cumsum([0] + [len(v.slots) for v in first])
    at_b = np.cumsum([0] + [len(u.slots) for u in second])
    known = m.assoc[np.ix_(words, pairs)].astype(np.float32)
    # What of each word the units of the first side explain, and of each pair those of the second.
    of_word = np.minimum(np.maximum.reduceat(np.ascontiguousarray(known.T)[pi], at_a[:-1], axis=0), m.weight_word[words].astype(np.float32)[None, :])
    of_pair = np.minimum(np.maximum.reduceat(known[wi, :], at_b[:-1], axis=0), m.weight_pair[pairs].astype(np.float32)[None, :])
    has_word, has_pair = np.zeros((len(second), len(words)), np.float32), np.zeros((len(first), len(pairs)), np.float32)
    has_word[np.repeat(np.arange(len(second)), np.diff(at_b)), wi] = 1
    has_pair[np.repeat(np.arange(len(first)), np.diff(at_a)), pi] = 1
    by_second = (of_word @ has_word.T) / np.maximum(has_word @ m.weight_word[words], 1e-9)[None, :]
    by_first = (has_pair @ of_pair.T) / np.maximum(has_pair @ m.weight_pair[pairs], 1e-9)[:, None]
    low, high = np.minimum(by_first, by_second), np.maximum(by_first, by_second)
    score = (1 - SHORTER) * low + SHORTER * high
    for i, v in enumerate(first):
        if v.numbers:
            for j, u in enumerate(second):
                if u.numbers:
                    score[i, j] += NUMBER if v.numbers & u.numbers else -NUMBER
    return score


def length_cost(a: np.ndarray, b: np.ndarray, m: Model) -> np.ndarray:
    """-log P of lengths that far apart; a and b broadcast."""
    z = np.abs(b - a * m.ratio) / np.sqrt(np.maximum(a + b / m.ratio, 1) / 2 * m.spread)
    return z * z / 2


def best_path(first: list[Unit], second: list[Unit], m: Model, score: np.ndarray | None, above: np.ndarray | None = None) -> list[tuple[list[int], list[int]]]:
    """The beads of the optimal path: indexes into both sides.

    With `above`, the least score of a pair, the path is through what was left over: it has
    one-to-one beads of such pairs only, and leaving a clause out costs nothing.
    """
    n, k = len(first), len(second)
    a = np.array([u.length for u in first], float)
    b = np.array([u.length for u in second], float)
    fit = GAIN * (score - NEUTRAL) if score is not None else np.zeros((n, k))
    kinds = [(1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2)][: 3 if above is not None else 6]
    # Cell (i, j) is at (i + 2, j + 2) of tables with two rims, so that every cell has all its forerunners.
    wide = k + 3
    cost = np.full((len(kinds), n + 3, wide), np.inf)
    if n and k:
        one = length_cost(a[:, None], b[None, :], m)
        if above is not None:
            # Of two chains the one that explains more; lengths settle what words leave open.
            cost[0, 3:, 3:] = np.where(score > above, -GAIN * (score - above) - 1 / (1 + one), np.inf)
        else:
            cost[0, 3:, 3:] = one - fit - math.log(BEADS[1, 1])
            if n > 1:
                cost[3, 4:, 3:] = length_cost((a[:-1] + a[1:])[:, None], b[None, :], m) - (fit[:-1] + fit[1:]) / 2 - math.log(BEADS[2, 1])
            if k > 1:
                cost[4, 3:, 4:] = length_cost(a[:, None], (b[:-1] + b[1:])[None, :], m) - (fit[:, :-1] + fit[:, 1:]) / 2 - math.log(BEADS[1, 2])
            if n > 1 and k > 1:
                cost[5, 4:, 4:] = one[:-1, 1:] + one[1:, :-1] - fit[:-1, 1:] - fit[1:, :-1] - math.log(CROSSED)
    cost[1:3, 2:, 2:] = 0.0 if above is not None else 4.0 - math.log(BEADS[1, 0])
    total = np.full((n + 3) * wide, np.inf)
    total[2 * wide + 2] = 0
    move = np.zeros(len(total), np.int8)
    flat, back = cost.reshape(len(kinds), -1), [x * wide + y for x, y in kinds]
    for d in range(1, n + k + 1):  # the cells of a diagonal don't depend on each other, and lie in even steps
        lo, hi = max(0, d - k), min(n, d)
        at = (lo + 2) * wide + d - lo + 2
        end = at + (hi - lo) * (wide - 1) + 1
        tried = flat[:, at : end : wide - 1] + np.stack([total[at - x : end - x : wide - 1] for x in back])
        how = tried.argmin(0)
        move[at : end : wide - 1] = how
        total[at : end : wide - 1] = tried[how, np.arange(len(how))]
    i, j, beads = n, k, []
    while i or j:
        x, y = kinds[move[(i + 2) * wide + j + 2]]
        if (x, y) == (2, 2):
            beads += [([i - 2], [j - 1]), ([i - 1], [j - 2])]
        elif x and y:
            beads.append((list(range(i - x, i)), list(range(j - y, j))))
        i, j = i - x, j - y
    return beads[::-1]


def chapter_pairs(first: list[Unit], second: list[Unit], m: Model) -> list[tuple[int, int, float]]:
    """(first, second, score) of the clause pairs of one chapter: those of the path's beads that agree,
    then those of the paths through what is left over, until there are no more.
    """
    if not first or not second:
        return []
    score = agreement(first, second, m)
    far = FAR * np.abs(np.arange(len(first))[:, None] / len(first) - np.arange(len(second))[None, :] / len(second))
    pairs = [(x, y) for xs, ys in best_path(first, second, m, score) for x in xs for y in ys if score[x, y] - far[x, y] + ON_PATH > m.cut]
    new = pairs
    left, right = np.arange(len(first)), np.arange(len(second))
    while new or new is pairs:
        left, right = np.setdiff1d(left, [x for x, _ in new]), np.setdiff1d(right, [y for _, y in new])
        own = score[np.ix_(left, right)]
        above = m.cut + far[np.ix_(left, right)]
        # A clause that agrees with none needn't be passed on the way.
        left_, right_ = (np.flatnonzero((own > above).any(k)) for k in (1, 0))
        if not len(left_):
            break
        at = np.ix_(left_, right_)
        beads = best_path([first[x] for x in left[left_]], [second[y] for y in right[right_]], m, own[at], above[at])
        new = [(int(left[left_[x]]), int(right[right_[y]])) for (x,), (y,) in beads]
        pairs = pairs + new
    return [(x, y, float(score[x, y])) for x, y in pairs]


# --- over DataFrames ---------------------------------------------------------------------

#: Bins of the histogram of agreements between distant clauses, over 0 to 2.
BINS = 2000
#: A word and a character pair seen together less often aren't associated.
LEAST = 3
_CE, _CZ, _N, _D, _HIST = WORDS * PAIRS, WORDS * PAIRS + WORDS, WORDS * PAIRS + WORDS + PAIRS, WORDS * PAIRS + WORDS + PAIRS + 1, WORDS * PAIRS + WORDS + PAIRS + 2
TABLE = _HIST + BINS


def chapters(sentences: DataFrame, script_map: DataFrame, first: str = "zh", second: str = "en") -> DataFrame:
    """A row for each chapter, or part of a long one, with both sides in order.

    A part holds the sentences whose relative position is within it, and half a part more on
    both sides; `first_core` tells those of the first side that no other part has.  A whole
    chapter has part -1.
    """
    rows = bounded_rows(script_map.where("trad is not null and simp is not null").dropDuplicates(["trad"]), 200_000, "script_map")
    text = F.translate("text", "".join(r.trad for r in rows), "".join(r.simp for r in rows)) if rows else F.col("text")
    own = sentences.where(F.col("chapter_id").isNotNull() & F.col("lang").isin(first, second) & (F.trim("text") != "")).select(
        "chapter_id", "lang", "sentence_id", F.coalesce(F.col("sent").cast("bigint"), F.lit((1 << 62))).alias("sent"),
        F.when(F.col("lang") == first, text).otherwise(F.col("text")).alias("text"))
    sizes = cut_lineage(own.groupBy("chapter_id").agg(
        F.sum((F.col("lang") == first).cast("bigint")).alias("n1"), F.sum((F.col("lang") == second).cast("bigint")).alias("n2")).where("n1 > 0 and n2 > 0"))
    item = F.struct("sent", "sentence_id", "text", "core")
    sides = [F.sort_array(F.collect_list(F.when(F.col("lang") == x, item))).alias(k) for x, k in ((first, "a"), (second, "b"))]
    short = sizes.where(F.greatest("n1", "n2") <= PART)
    grouped = own.join(short, "chapter_id", "left_semi").withColumn("core", F.lit(True)).groupBy("chapter_id").agg(*sides).withColumn("part", F.lit(-1))
    long = sizes.where(F.greatest("n1", "n2") > PART)
    if not long.isEmpty():
        of = own.join(long, "chapter_id")
        placed = ranked(of, ["chapter_id", "lang"], ["sent", "sentence_id"]).withColumn("n", F.when(F.col("lang") == first, F.col("n1")).otherwise(F.col("n2")))
        parts = _diagonal(placed).groupBy("chapter_id", "part").agg(*sides)
        grouped = grouped.unionByName(parts)
    return grouped.select("chapter_id", "part", F.col("a.sentence_id").alias("first_id"), F.col("a.text").alias("first_text"), F.col("a.core").alias("first_core"),
                          F.col("b.sentence_id").alias("second_id"), F.col("b.text").alias("second_text"), F.col("b.core").alias("second_core"))


def _diagonal(placed: DataFrame) -> DataFrame:
    """Rows (rank, n, n1, n2) with the parts of their relative position; `core` in the one they lie in."""
    parts = F.ceil(F.greatest("n1", "n2") / PART)
    return (
        placed.withColumn("_p", parts).withColumn("_at", F.col("rank") / F.col("n") * F.col("_p"))
        .withColumn("part", F.explode(F.sequence(F.greatest(F.floor(F.col("_at") - 0.5), F.lit(0)).cast("int"), F.least(F.floor(F.col("_at") + 0.5), F.col("_p") - 1).cast("int"))))
        .withColumn("core", F.floor("_at") == F.col("part")).drop("_p", "_at")
    )


def stock_phrases(chapters_: DataFrame) -> tuple[dict[str, bool], float]:
    """Phrases between commas that a fixed share of the chapters has, and the ratio of lengths."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            seen: dict[str, list[int]] = {}
            size = [0, 0]
            for texts in (b["first_text"], b["second_text"]):
                side = 0 if texts is b["first_text"] else 1
                for chapter in texts:
                    here = set()
                    for text in chapter:
                        size[side] += len(text)
                        parts = segments(text)
                        for k, x in enumerate(parts if len(parts) > 1 else []):
                            p = phrase(x)
                            c = seen.setdefault(p, [0, 0, 0])
                            c[0] += 1
                            c[1] += k == 0
                            c[2] += p not in here
                            here.add(p)
            out = [(p, *c) for p, c in seen.items()] + [("\x00first", size[0], 0, 1 << 40), ("\x00second", size[1], 0, 1 << 40)]
            yield pd.DataFrame(out, columns=["p", "n", "lead", "chapters"])

    n = chapters_.count()
    counted = chapters_.mapInPandas(run, "p string, n bigint, lead bigint, chapters bigint").groupBy("p").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead"), F.sum("chapters").alias("chapters"))
    rows = bounded_rows(counted.where(F.col("chapters") >= max(3, STOCK_SHARE * n)), 200_000, "stock phrases")
    size = {r.p: r.n for r in rows if r.p.startswith("\x00")}
    return {r.p: r.lead >= 0.5 * r.n for r in rows if not r.p.startswith("\x00")}, max(size.get("\x00second", 0), 1) / max(size.get("\x00first", 0), 1)


def _sides(row, m: Model) -> tuple[list[Unit], list[Unit]]:
    return units(list(row.first_id), list(row.first_text), True, m.stock), units(list(row.second_id), list(row.second_text), False, m.stock)


def count_beads(chapters_: DataFrame, m: Model) -> pd.DataFrame:
    """Counts over the one-to-one beads of all chapters, and of agreements between distant clauses."""
    shared = chapters_.sparkSession.sparkContext.broadcast(m)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        t = np.zeros(TABLE, np.int64)
        joint = t[: WORDS * PAIRS].reshape(WORDS, PAIRS)
        for b in rows:
            for row in b.itertuples():
                a, z = _sides(row, model)
                if not a or not z:
                    continue
                score = agreement(a, z, model) if model.at is not None else None
                if score is not None:
                    far = np.abs(np.arange(len(a))[:, None] / len(a) - np.arange(len(z))[None, :] / len(z)) > 0.3
                    t[_HIST:] += np.histogram(np.clip(score[far], 0, 1.999), BINS, (0, 2))[0]
                for xs, ys in best_path(a, z, model, score):
                    if len(xs) == 1 == len(ys) and (score is None or score[xs[0], ys[0]] > model.cut):
                        v, u = a[xs[0]], z[ys[0]]
                        joint[np.ix_(u.slots, v.slots)] += 1
                        t[_CE + u.slots] += 1
                        t[_CZ + v.slots] += 1
                        t[_N] += 1
                        t[_D] += round(1000 * (u.length - v.length * model.ratio) ** 2 / ((v.length + u.length / model.ratio) / 2))
        at = np.flatnonzero(t)
        yield pd.DataFrame({"slot": at, "n": t[at]})

    counted = chapters_.mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    # At most TABLE rows; rare companions say nothing and stay where they are.
    counts = counted.where((F.col("slot") >= _CE) | (F.col("n") >= LEAST)).toPandas()
    shared.destroy()
    return counts


def learnt(m: Model, counts: pd.DataFrame) -> Model:
    """The model with the associations, the spread and the cut that the counts give."""
    slot, count = counts["slot"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    rest = np.zeros(TABLE - _CE)
    single = slot >= _CE
    rest[slot[single] - _CE] = count[single]
    ce, cz, n = rest[:WORDS], rest[WORDS : WORDS + PAIRS], rest[_N - _CE]
    word, pair = slot[~single] // PAIRS, slot[~single] % PAIRS
    bits = np.log2((count[~single] + 0.1) / (ce[word] * cz[pair] / max(n, 1) + 0.1))
    tied = bits > 0
    at, bits = slot[~single][tied].astype(np.int32), bits[tied].astype(np.float32)
    info = [np.where(c >= LEAST, np.log2((n + 1) / (c + 1)).clip(0, 8), 0) for c in (ce, cz)]
    hist = rest[_HIST - _CE :]
    cut = m.cut
    if hist.sum() >= 1000:
        cut = float(np.searchsorted(np.cumsum(hist), (1 - CHANCE) * hist.sum()) * 2 / BINS)
    return Model(m.stock, m.ratio, max(1.0, rest[_D - _CE] / 1000 / n) if n else m.spread, at, bits, info[0], info[1], cut)


def train(chapters_: DataFrame, passes: int = 3) -> Model:
    stock, ratio = stock_phrases(chapters_)
    m = Model(stock, ratio, 6.8)
    for _ in range(passes):
        m = learnt(m, count_beads(chapters_, m))
    return m


FOUND = "chapter_id bigint, first_id bigint, first_clause int, second_id bigint, second_clause int, score double"


def align(chapters_: DataFrame, m: Model) -> DataFrame:
    """(chapter_id, first_id, second_id, score): pairs of sentences, by their best clauses."""
    shared = chapters_.sparkSession.sparkContext.broadcast(m)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for row in b.itertuples():
                a, z = _sides(row, shared.value)
                best: dict[tuple[int, int], float] = {}
                for x, y, s in chapter_pairs(a, z, shared.value):
                    key = (a[x].sentence, z[y].sentence)
                    best[key] = max(s, best.get(key, -9.0))
                out += [(row.chapter_id, i, j, s) for (i, j), s in best.items()]
            yield pd.DataFrame(out, columns=["chapter_id", "first_id", "second_id", "score"])

    whole = chapters_.where("part < 0").mapInPandas(run, "chapter_id bigint, first_id bigint, second_id bigint, score double")
    long = chapters_.where("part >= 0")
    if long.isEmpty():
        return whole
    return whole.unionByName(_align_long(long, m).groupBy("chapter_id", "first_id", "second_id").agg(F.max("score").alias("score")))


def _clauses(parts: DataFrame, m: Model) -> DataFrame:
    """(chapter_id, side, id, clause, text, pos) of the clauses of long chapters, each once, in order."""
    shared = parts.sparkSession.sparkContext.broadcast(m.stock)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for row in b.itertuples():
                for side, ids, texts, core in ((0, row.first_id, row.first_text, row.first_core), (1, row.second_id, row.second_text, row.second_core)):
                    for k, (i, text, own) in enumerate(zip(ids, texts, core)):
                        if own:
                            out += [(row.chapter_id, side, i, n, c, row.part, k) for n, c in enumerate(clauses(text, shared.value))]
            yield pd.DataFrame(out, columns=["chapter_id", "side", "id", "clause", "text", "part", "k"])

    made = parts.mapInPandas(run, "chapter_id bigint, side int, id bigint, clause int, text string, part int, k int")
    return cut_lineage(ranked(cut_lineage(made), ["chapter_id", "side"], ["part", "k", "clause"], "pos").drop("part", "k"))


def _align_long(parts: DataFrame, m: Model) -> DataFrame:
    """Pairs of clauses of chapters in parts: see the module's docstring."""
    shared = parts.sparkSession.sparkContext.broadcast(m)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for row in b.itertuples():
                a, z = ([u for i, x in enumerate(side) for u in units([i], [x["text"]], han, shared.value.stock, True)] for side, han in ((row.a, True), (row.b, False)))
                for x, y, s in chapter_pairs(a, z, shared.value):
                    p, q = row.a[a[x].sentence], row.b[z[y].sentence]
                    if p["core"]:
                        out.append((row.chapter_id, p["id"], p["clause"], q["id"], q["clause"], s))
            yield pd.DataFrame(out, columns=["chapter_id", "first_id", "first_clause", "second_id", "second_clause", "score"])

    left, found, diagonal = _clauses(parts, m), None, True
    while True:
        sizes = left.groupBy("chapter_id").agg(*[F.count(F.when(F.col("side") == k, 1)).alias(f"n{k + 1}") for k in (0, 1)]).where("n1 > 0 and n2 > 0")
        placed = ranked(left.join(sizes, "chapter_id"), ["chapter_id", "side"], ["pos"]).withColumn("n", F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n2")))
        if diagonal:
            keyed = _diagonal(placed).withColumn("other", F.col("part"))
        else:  # every part of what is left of one side meets every one of the other
            mine, count = F.floor(F.col("rank") / PART).cast("int"), F.ceil(F.when(F.col("side") == 0, F.col("n2")).otherwise(F.col("n1")) / PART).cast("int")
            keyed = placed.withColumn("_mine", mine).withColumn("_theirs", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("core", F.lit(True)).withColumn(
                "part", F.when(F.col("side") == 0, F.col("_mine")).otherwise(F.col("_theirs"))).withColumn("other", F.when(F.col("side") == 0, F.col("_theirs")).otherwise(F.col("_mine")))
        item = F.struct("pos", "id", "clause", "text", "core")
        grouped = keyed.groupBy("chapter_id", "part", "other").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == k, item))).alias("ab"[k]) for k in (0, 1)])
        pairs = cut_lineage(grouped.mapInPandas(run, FOUND))
        # A clause may have found one in several parts: what is best for both stays.
        ends = [["chapter_id", f"{x}_id", f"{x}_clause"] for x in ("first", "second")]
        for keys in ends:
            best = pairs.groupBy(*keys).agg(F.max("score").alias("_best"))
            pairs = pairs.join(best, keys).where("score >= _best").drop("_best") if not diagonal else pairs
        new = cut_lineage(pairs.distinct())
        found = new if found is None else cut_lineage(found.unionByName(new))
        if not diagonal and new.isEmpty():
            return found
        used = [new.select("chapter_id", F.lit(k).alias("side"), F.col(f"{x}_id").alias("id"), F.col(f"{x}_clause").alias("clause")) for k, x in enumerate(("first", "second"))]
        left = cut_lineage(left.join(used[0].unionByName(used[1]).distinct(), ["chapter_id", "side", "id", "clause"], "left_anti"))
        diagonal = False


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(table(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text"), "sentence_id")
    c = cut_lineage(chapters(rows, table(spark, sf_dir, "script_map")))
    return align(c, train(c))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select(F.least("first_id", "second_id").alias("sent_a"), F.greatest("first_id", "second_id").alias("sent_b"))


def p2_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_alignment": p2_alignment}
ORACLE: dict[str, str] = {}
