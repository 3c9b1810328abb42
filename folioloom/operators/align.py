"""Alignment of two ordered sides by length, chapter by chapter.

One kernel serves all profiles: a step takes 1..A items of one side and 1..B of the other,
and costs how far their weights are apart, plus penalties for group size, for quotation marks
on one side only and for leaving the diagonal.  Of equal paths the one whose steps come from
the earlier items wins.  A row of the table depends on earlier rows only, so it is computed at
once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import measures


class Unalignable(ValueError):
    """The sides differ too much in number for the profile's groups."""


@dataclass(frozen=True)
class Profile:
    most_ref: int
    most_target: int
    ref_penalty: float
    target_penalty: float
    position: float
    quote: float


# Fixed values of the two profiles.
PAIRS = Profile(3, 3, 0.16, 0.16, 0.08, 0.04)
GROUPS = Profile(2, 5, 0.22, 0.08, 0.10, 0.0)


def best_steps(ref: np.ndarray, target: np.ndarray, p: Profile, ref_open=None, ref_close=None, target_open=None, target_close=None) -> list[tuple[int, int, float]]:
    """(a, b, length cost) of the steps of the cheapest path over both sides' weights."""
    n, m = len(ref), len(target)
    r, t = np.concatenate([[0], np.cumsum(ref)]), np.concatenate([[0], np.cumsum(target)])
    ratio = t[-1] / r[-1] if r[-1] else 1.0
    none = np.zeros(max(n, m), bool)
    ro, rc, to, tc = (none if x is None else np.asarray(x, bool) for x in (ref_open, ref_close, target_open, target_close))
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    back = np.zeros((n + 1, m + 1, 2), np.int8)
    for x in range(1, n + 1):
        row = np.full(m + 1, np.inf)
        for a in range(min(p.most_ref, x), 0, -1):
            want = (r[x] - r[x - a]) * ratio
            quoted = ro[x - a] | rc[x - 1]
            for b in range(min(p.most_target, m), 0, -1):
                y = np.arange(b, m + 1)
                have = t[y] - t[y - b]
                cost = np.abs(want - have) / np.maximum(np.maximum(want, have), 1.0) + (a - 1) * p.ref_penalty + (b - 1) * p.target_penalty
                if p.quote:
                    cost = cost + np.where((to[y - b] | tc[y - 1]) != quoted, p.quote, 0.0)
                cost = cost + np.abs(x / n - y / m) * p.position
                new = total[x - a, y - b] + cost
                better = new < row[y]
                row[y[better]] = new[better]
                back[x, y[better]] = (a, b)
        total[x] = row
    if not np.isfinite(total[n, m]):
        raise Unalignable(f"{n} and {m} items")
    steps, x, y = [], n, m
    while x or y:
        a, b = map(int, back[x, y])
        want, have = (r[x] - r[x - a]) * ratio, t[y] - t[y - b]
        steps.append((a, b, float(abs(want - have) / max(want, have, 1.0))))
        x, y = x - a, y - b
    return steps[::-1]


_WORD, _HAN = re.compile(measures.WORD), {h: re.compile(h) for h in (measures.HAN, measures.HAN_KANA)}
_MARKS = {m: re.compile(m) for m in (measures.EAST_MARKS, measures.BOOK_MARKS, measures.WEST_MARKS)}


def weight(text: str, lang: str, profile: str) -> float:
    """The same weight as `measures.weight`, for texts that are in Python already."""
    unit, each, marks = measures.PROFILES[profile][lang]
    total = len((_HAN.get(unit) or _WORD).findall(text)) * each + len(_MARKS[marks].findall(text)) * (0.25 if lang in ("zh", "ja") else 0.35)
    if profile == "book" and lang == "zh":
        total += len(re.findall("[A-Za-z]+", text)) * 1.5
    return max(1.0, total)


def _opens(texts) -> list[bool]:
    return [t[:1] in "“\"'‘" and t != "" for t in texts]


def _closes(texts) -> list[bool]:
    return [t[-1:] in "”\"'’" and t != "" for t in texts]


def sides(paragraphs: DataFrame, keys: list[str], ref: str, target: str) -> DataFrame:
    """One row per chapter with both sides in order: (keys, ref_idx, ref, target_idx, target)."""
    item = F.struct("idx", "text")
    return paragraphs.where(F.col("lang").isin(ref, target)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("lang") == ref, item))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("lang") == target, item))).alias("b"),
    ).select(*keys, F.col("a.idx").alias("ref_idx"), F.col("a.text").alias("ref"), F.col("b.idx").alias("target_idx"), F.col("b.text").alias("target"))


def align_pairs(chapters: DataFrame, keys: list[str], ref_lang: str = "zh", target_lang: str = "en", profile: str = "book") -> DataFrame:
    """(keys, pair, ref, target, ref_idx, target_idx, cost) in order.

    Both sides empty: no rows.  One side empty: a single row of cost 0 without indexes.  A
    chapter that can't be aligned: a single row with null cost that holds everything.
    """
    fields = {f.name: f.dataType.simpleString() for f in chapters.schema.fields}
    ddl = ", ".join(f"{k} {fields[k]}" for k in keys) + ", pair int, ref array<string>, target array<string>, ref_idx array<int>, target_idx array<int>, cost double"
    columns = [*keys, "pair", "ref", "target", "ref_idx", "target_idx", "cost"]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for row in b.itertuples(index=False):
                key, ref, target = [getattr(row, k) for k in keys], list(row.ref), list(row.target)
                if not len(ref) and not len(target):
                    continue
                if not len(ref) or not len(target):
                    out.append((*key, 1, ref, target, None, None, 0.0))
                    continue
                try:
                    steps = best_steps(
                        np.array([weight(t, ref_lang, profile) for t in ref]), np.array([weight(t, target_lang, profile) for t in target]), PAIRS,
                        _opens(ref), _closes(ref), _opens(target), _closes(target))
                except Unalignable:
                    out.append((*key, 1, ref, target, list(row.ref_idx), list(row.target_idx), None))
                    continue
                x = y = 0
                for k, (a, c, cost) in enumerate(steps, 1):
                    out.append((*key, k, ref[x : x + a], target[y : y + c], list(row.ref_idx[x : x + a]), list(row.target_idx[y : y + c]), cost))
                    x, y = x + a, y + c
            yield pd.DataFrame(out, columns=columns)

    return chapters.mapInPandas(run, ddl)


def share_out(ref_weights: list[float], unit_weights: list[float]) -> list[tuple[int, int]]:
    """The stretch of units for each row: cut where the running weight is nearest to the rows' share.

    The weights of units are positive, so what is nearest within bounds is the nearest at all,
    brought within the bounds: the cuts of all rows follow from one search.  Where there are
    enough units every row gets one.
    """
    rows, units = len(ref_weights), len(unit_weights)
    ref, sums = np.asarray(ref_weights, float), np.concatenate([[0], np.cumsum(unit_weights)])
    due = np.cumsum(max(sums[-1], 1.0) * (ref / max(ref.sum(), 1.0)))[:-1]
    above = np.searchsorted(sums, due).clip(1, units) if units else np.zeros(rows - 1, int)
    near = above - (due - sums[above - 1] <= sums[above] - due) if units else above
    row = np.arange(rows - 1)
    if units >= rows:
        cut = np.minimum(np.maximum.accumulate(np.maximum(near - row, 1)), units - rows + 1) + row
    else:
        cut = np.maximum.accumulate(near)
    ends = [0, *cut.tolist(), units]
    return list(zip(ends, ends[1:]))


def align_groups(chapters: DataFrame, keys: list[str], ref_lang: str, target_lang: str, profile: str = "quotes", split=None) -> DataFrame:
    """(keys, row, ref, target_idx, target, aligned): the targets of every row of the reference side.

    Without `split` each row of a group gets the whole group (D2).  With `split`, a function
    from a text to its sentences, the group's sentences are shared out among the rows (D3, D4).
    A target index is a pair (paragraph, sentence), sentence 0 for a whole paragraph.  In a chapter
    that can't be aligned, each row gets the whole other side, with and without `split`, and
    `aligned` is false.
    """
    fields = {f.name: f.dataType.simpleString() for f in chapters.schema.fields}
    ddl = ", ".join(f"{k} {fields[k]}" for k in keys) + ", row int, ref string, target_idx array<struct<paragraph:int,sentence:int>>, target array<string>, aligned boolean"
    columns = [*keys, "row", "ref", "target_idx", "target", "aligned"]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for row in b.itertuples(index=False):
                key, ref, target = [getattr(row, k) for k in keys], list(row.ref), list(row.target)
                if not len(ref):
                    continue
                if not len(target):
                    out += [(*key, k, t, [], [], True) for k, t in enumerate(ref, 1)]
                    continue
                weights = [weight(t, ref_lang, profile) for t in ref]
                try:
                    steps = best_steps(np.array(weights), np.array([weight(t, target_lang, profile) for t in target]), GROUPS)
                except Unalignable:
                    steps = [(len(ref), len(target), None)]
                x = y = 0
                for a, c, cost in steps:
                    group = [({"paragraph": int(i), "sentence": 0}, t) for i, t in zip(row.target_idx[y : y + c], target[y : y + c])]
                    parts = [group] * a
                    if split and a > 1 and cost is not None:
                        units = []
                        for at, text in group:
                            pieces = split(text)
                            units += [(at, text)] if len(pieces) <= 1 else [({"paragraph": at["paragraph"], "sentence": k}, s) for k, s in enumerate(pieces, 1)]
                        parts = [units[s:e] for s, e in share_out(weights[x : x + a], [weight(t, target_lang, profile) for _, t in units])]
                    for k, part in enumerate(parts):
                        out.append((*key, x + k + 1, ref[x + k], [i for i, _ in part], [t for _, t in part], cost is not None))
                    x, y = x + a, y + c
            yield pd.DataFrame(out, columns=columns)

    return chapters.mapInPandas(run, ddl)


def merge_empty(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without targets join the row before; those at the start join the first that has some.

    Islands by a running count; all leading rows are folded, not just one.
    """
    order = Window.partitionBy(*keys).orderBy("pair")
    filled = (F.size("target") > 0).cast("int")
    island = F.greatest(F.sum(filled).over(order), F.lit(1))
    items = pairs.withColumn("island", island).groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.struct("pair", "ref", "target"))).alias("rows"))
    return items.select(*keys, F.array_min("rows.pair").alias("pair"), F.flatten("rows.ref").alias("ref"), F.flatten("rows.target").alias("target"))


def unique_by_index(rows: DataFrame, keys: list[str], index: str, order: str) -> DataFrame:
    """The first row of each index."""
    w = Window.partitionBy(*keys, index).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
