"""Rebalancing of aligned rows by a semantic mapping.

The mapping comes from embeddings given as a column: `cosine_mapping` finds the nearest
target of each source.  Moving target texts between neighbouring rows depends on the moves
before, so a chapter is handled as one group in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A row is suspicious if its source is this short or its target this much longer.
SHORT_SOURCE, MOST_RATIO = 45, 8.0


#: Vectors of a side multiplied at once.
AT_ONCE = 2048


def cosine_mapping(source: DataFrame, target: DataFrame, block: str) -> DataFrame:
    """(block, source_id, target_id, cosine): the nearest target by cosine, the first of equals.

    Inputs have (block, id, embedding); only vectors of one block meet.  Both sides are cut into
    parts of about `AT_ONCE` vectors, and two parts meet as one product of matrices, so no task
    holds a block and no pair of vectors is a row.  A vector of length 0 has cosine 0 with all.
    """
    type_ = source.schema[block].dataType.simpleString()

    def parts(df: DataFrame, name: str) -> DataFrame:
        most = df.groupBy(block).count().agg(F.max("count")).first()[0] or 1
        part = F.pmod(F.xxhash64("id"), F.lit(-(-most // AT_ONCE))).alias("part")
        return df.where("embedding is not null").groupBy(block, part).agg(F.sort_array(F.collect_list(F.struct("id", "embedding"))).alias(name))

    pairs = parts(source, "s").join(parts(target, "t").drop("part"), block).select(block, F.col("s.id").alias("i"), F.col("s.embedding").alias("a"), F.col("t.id").alias("j"), F.col("t.embedding").alias("b"))

    def unit(vectors) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in vectors])
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for key, i, a, j, b in chunk.itertuples(index=False):
                cosine = unit(a) @ unit(b).T
                best = cosine.argmax(1)
                yield pd.DataFrame({block: key, "source_id": i, "target_id": np.asarray(j)[best], "cosine": cosine[np.arange(len(best)), best]})

    found = pairs.mapInPandas(run, f"{block} {type_}, source_id bigint, target_id bigint, cosine double")
    best = F.max(F.struct("cosine", (-F.col("target_id")).alias("neg")))
    return found.groupBy(block, "source_id").agg(best.alias("m")).select(block, "source_id", (-F.col("m.neg")).alias("target_id"), F.col("m.cosine").alias("cosine"))


@dataclass
class Row:
    source: int  # characters of the source side
    items: list[tuple[int, str]] = field(default_factory=list)  # (paragraph, text) of the target side


class Cuts:
    """A chapter's target items in one line, cut into rows: moving items moves a cut.

    Row k holds the live items from `at[k]` to `at[k + 1]`.  An item that no row may hold dies.
    """

    def __init__(self, rows: list[Row]) -> None:
        line = [x for r in rows for x in r.items]
        self.line, self.source = line, [max(r.source, 1) for r in rows]
        self.short = [r.source <= SHORT_SOURCE for r in rows]
        self.base = np.array([p for p, _ in line], np.int64)
        self.size = np.array([len(t) for _, t in line], np.int64)
        self.live = np.ones(len(line), bool)
        self.at = np.cumsum([0] + [len(r.items) for r in rows])

    def own(self, k: int) -> np.ndarray:
        """The positions of row k's live items; none beside the chapter."""
        if not 0 <= k < len(self.source):
            return np.zeros(0, np.int64)
        return np.arange(self.at[k], self.at[k + 1])[self.live[self.at[k] : self.at[k + 1]]]

    def ratio(self, k: int) -> float:
        own = self.own(k)
        return (int(self.size[own].sum()) + max(len(own) - 1, 0)) / self.source[k]

    def long(self, k: int) -> bool:
        return self.ratio(k) > MOST_RATIO

    def of(self, k: int, bases: set[int]) -> np.ndarray:
        own = self.own(k)
        return own[np.isin(self.base[own], list(bases))]

    def narrow(self, k: int, first: int, last: int) -> None:
        """Row k keeps what lies from `first` to `last`; what is outside goes to its neighbours, or dies at the rim."""
        for rim, gone in ((k == 0, slice(self.at[k], first)), (k == len(self.source) - 1, slice(last + 1, self.at[k + 1]))):
            if rim:
                self.live[gone] = False
        if k:
            self.at[k] = first
        if k + 1 < len(self.source):
            self.at[k + 1] = last + 1

    def split(self, k: int, wanted: set[int]) -> bool:
        """A row that is too long keeps what is wanted; what lies in between otherwise dies."""
        own, hits = self.own(k), self.of(k, wanted)
        if len(hits) == len(own):
            return False
        inner = own[(own > hits[0]) & (own < hits[-1])]
        self.live[np.setdiff1d(inner, hits)] = False
        self.narrow(k, hits[0], hits[-1])
        return True

    def take(self, k: int, side: int, wanted: set[int]) -> bool:
        """Row k gets what is wanted from the end of a neighbour that is next to it; its own items move on."""
        theirs, hits = self.own(k + side), self.of(k + side, wanted)
        n = len(hits)
        if not 0 < n < len(theirs) or not np.array_equal(hits, theirs[-n:] if side < 0 else theirs[:n]):
            return False
        if not 0 <= k - side < len(self.source):
            self.live[self.at[k] : self.at[k + 1]] = False
        if side < 0:
            moved = self.at[k]
            self.at[k] = hits[0]
            if k + 1 < len(self.source):
                self.at[k + 1] = moved
        else:
            moved = self.at[k + 1]
            self.at[k + 1] = hits[-1] + 1
            if k:
                self.at[k] = moved
        return True

    def settle(self, k: int, wanted: set[int]) -> bool:
        """The first of the moves that brings row k what it should hold."""
        if len(self.of(k, wanted)):
            return self.long(k) and self.split(k, wanted)
        return (not len(self.own(k)) or self.long(k)) and any(self.take(k, side, wanted) for side in (-1, 1))

    def give_back(self, k: int, expected: list[set[int]]) -> int:
        """What lies before or behind the items of row k, and belongs all to the neighbour there, moves to it."""
        hits = self.of(k, expected[k])
        moved = 0
        for side, outside in ((-1, lambda own: own[own < hits[0]]), (1, lambda own: own[own > hits[-1]])):
            if len(hits) and 0 <= k + side < len(self.source):
                extra = outside(self.own(k))
                if len(extra) and set(self.base[extra].tolist()) <= expected[k + side]:
                    self.at[k + (side > 0)] = hits[0] if side < 0 else hits[-1] + 1
                    moved += 1
        return moved


def rebalance_rows(rows: list[Row], expected: list[set[int]]) -> int:
    """Two passes over the rows that were suspicious at first, three of giving back; the moves made."""
    cuts = Cuts(rows)

    def settled(k: int) -> int:
        near = {int(p) for j in (k - 1, k, k + 1) for p in cuts.base[cuts.own(j)]}
        wanted = expected[k] & near
        return int(bool(wanted) and cuts.settle(k, wanted))

    doubtful = [k for k in range(len(rows)) if cuts.short[k] or cuts.long(k)]
    single = [k for k in range(len(rows)) if len(expected[k]) == 1]
    total = 0
    for passes, some, move in ((2, doubtful, settled), (3, single, lambda k: cuts.give_back(k, expected))):
        for _ in range(passes):
            made = sum(move(k) for k in some)
            total += made
            if not made:
                break
    for k, r in enumerate(rows):
        r.items = [cuts.line[i] for i in cuts.own(k)]
    return total


def rebalance(pairs: DataFrame, key: str) -> DataFrame:
    """(key, pair, target_idx, target, moves) of rows (key, pair, ref, target_idx, target, expected).

    `expected` has the target paragraphs that the mapping gives for the row's source.  One
    group is one chapter.
    """
    ddl = f"{key} {pairs.schema[key].dataType.simpleString()}, pair int, target_idx array<int>, target array<string>, moves int"

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pair")
        rows = [Row(len("".join(r)), list(zip(map(int, i), t))) for r, i, t in zip(b["ref"], b["target_idx"], b["target"])]
        moves = rebalance_rows(rows, [set(map(int, e)) for e in b["expected"]])
        return pd.DataFrame({key: b[key].to_numpy(), "pair": b["pair"].to_numpy(), "target_idx": [[p for p, _ in r.items] for r in rows], "target": [[t for _, t in r.items] for r in rows], "moves": moves})

    return pairs.groupBy(key).applyInPandas(run, ddl)
