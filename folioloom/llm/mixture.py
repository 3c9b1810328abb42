"""A mixture of sources whose tokens meet target shares, written as shuffled shards.

Method: multivariate-hypergeometric splitting tree.  The documents of a source, in a hashed
order and repeated as often as its quota needs, form a stream that is cut into blocks of
tokens.  The exact numbers of blocks by source are split recursively between the halves of
the output shards by draws without replacement, down to the numbers by shard and source.
Each shard draws that many blocks of a permutation of the source's blocks, so shards are
disjoint, and shuffles its documents.

Nothing of the size of the output is made in one place: a block's shard is found by walking
down the tree, whose draws every worker repeats from their seeds, and what a document's rank
and block are is computed where the document is.  A shard has about `SHARD_TOKENS`, however
many there are.

The last pass through a source ends at the document that doesn't fit; what is open then is
filled by the largest documents behind it that fit, until none does.

The size of the mixture is, unless given, the largest at which every source that has tokens
meets its share within its `max_repeats`.  A source without tokens can't contribute: its
share goes to the others in proportion, and the report says so.  With a given size, a source
whose quota exceeds what its repeats allow gives all it may, and the report shows the share
reached.

Defined results: documents without tokens, without a source or of sources without a target
aren't drawn; null or non-positive shares and repeats mean the source isn't drawn; repeated
targets count once; no targets or no documents give an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, ranked, table
from folioloom.llm.tokens import with_tokens

SHARD_TOKENS, BLOCKS_PER_SHARD = 200_000, 64


def quotas(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source."""
    usable = {s: w for s, w in shares.items() if w and w > 0 and available.get(s, 0) > 0 and (repeats.get(s) or 0) > 0}
    weight = sum(usable.values())
    if not usable:
        return {}
    if total is None:
        total = int(min(repeats[s] * available[s] / (w / weight) for s, w in usable.items()))
    return {s: min(int(round(total * w / weight)), repeats[s] * available[s]) for s, w in usable.items()}


@lru_cache(1 << 15)
def _left(first: int, n: int, have: tuple[int, ...], seed: int) -> tuple[int, ...]:
    """Blocks of each source for the first half of n shards that hold `have`, drawn without replacement."""
    total = sum(have)
    if not total:
        return have
    rng = np.random.default_rng([seed, first, n])
    # Shard k of the whole gets the blocks between two exact fractions of the total.
    return tuple(rng.multivariate_hypergeometric(np.array(have), total * (n // 2) // n, method="marginals").tolist())


def shard_of(source: np.ndarray, place: np.ndarray, blocks: tuple[int, ...], shards: int, seed: int) -> np.ndarray:
    """The shard of the block at each place of its source's permutation, by the splitting tree."""
    out = np.zeros(len(place), np.int64)
    todo = [(0, shards, blocks, np.arange(len(place)), place.astype(np.int64))]
    while todo:
        first, n, have, at, p = todo.pop()
        if n == 1:
            out[at] = first
            continue
        left = _left(first, n, have, seed)
        mine = np.array(left, np.int64)[source[at]]
        go = p < mine
        if go.any():
            todo.append((first, n // 2, left, at[go], p[go]))
        if not go.all():
            todo.append((first + n // 2, n - n // 2, tuple(h - x for h, x in zip(have, left)), at[~go], (p - mine)[~go]))
    return out


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of 0..n-1 puts each k: a Feistel network, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, n]).integers(1, 1 << 62, 4).astype(np.uint64)
    out = np.array(k, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for key in keys:
            h = (b + key) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


#: Documents of a source looked at in one pass that fills what is open, and the share of a quota that may stay open.
LOOKED_AT, CLOSE = 1000, 1e-4


def last_pass(stream: DataFrame, rest: dict[str, int]) -> tuple[dict[str, int], dict[str, dict[int, int]]]:
    """How the last, partial pass through each source ends: its first document left out, by rank, and the
    documents behind it that fill what is open, with the place of each.

    At most `LOOKED_AT` rows of each source come to the driver at a time; passes go on until hardly
    anything is open or nothing fits.
    """
    source = F.col("source")
    limit = F.create_map(*[x for s, r in rest.items() for x in (F.lit(s), F.lit(r))])[source]
    over = F.col("tokens_before") + F.col("tokens") > limit
    state = stream.groupBy("source").agg(F.min(F.when(over, F.col("rank"))).alias("cut"), F.max(F.when(~over, F.col("tokens_before") + F.col("tokens"))).alias("filled")).collect()
    cut = {r.source: r.cut for r in state if r.cut is not None}
    place = {r.source: r.filled or 0 for r in state if r.cut is not None}
    fillers: dict[str, dict[int, int]] = {s: {} for s in cut}
    least: dict[str, tuple[int, int]] = {}  # the last document looked at, in the order of tokens and id
    while open_ := [s for s in cut if rest[s] - place[s] > CLOSE * rest[s]]:
        room = F.create_map(*[x for s in open_ for x in (F.lit(s), F.lit(rest[s] - place[s]))])[source]
        first = F.create_map(*[x for s in open_ for x in (F.lit(s), F.lit(cut[s]))])[source]
        behind = stream.where(source.isin(open_) & (F.col("rank") >= first) & (F.col("tokens") <= room))
        for s, (t, d) in least.items():
            behind = behind.where((source != s) | (F.col("tokens") < t) | (F.col("tokens") == t) & (F.col("doc_id") < d))
        order = Window.partitionBy("source").orderBy(F.desc("tokens"), F.desc("doc_id"))
        rows = behind.select("source", "tokens", "doc_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LOOKED_AT).orderBy("source", "_n").collect()
        for s in open_:
            own = [r for r in rows if r.source == s]
            for r in own:
                if place[s] + r.tokens <= rest[s]:
                    fillers[s][r.doc_id] = place[s]
                    place[s] += r.tokens
                least[s] = (r.tokens, r.doc_id)
            if not own:
                place[s] = rest[s]  # nothing fits
    return cut, fillers


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """(shard, position, doc_id, source, copy, tokens): each document with each of its uses."""
    spark = sizes.sparkSession
    ddl = "shard int, position int, doc_id bigint, source string, copy int, tokens bigint"
    asked = bounded_rows(targets.where("source is not null").dropDuplicates(["source"]), 10_000, "mix_targets")
    names = [r.source for r in asked]
    sizes = sizes.select("doc_id", "source", "tokens")
    own = sizes.where(F.col("source").isin(names) & (F.col("tokens") > 0)) if names else sizes.where("false")
    have = {r.source: int(r.n) for r in own.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row for each target
    quota = quotas(have, {r.source: r.target_share for r in asked}, {r.source: r.max_repeats for r in asked}, total)
    if not quota or not sum(quota.values()):
        return spark.createDataFrame([], ddl)
    sources = sorted(quota)
    whole = sum(quota.values())
    shards = max(1, -(-whole // SHARD_TOKENS))
    block = max(1, whole // (shards * BLOCKS_PER_SHARD))
    blocks = tuple(-(-quota[s] // block) for s in sources)

    stream = cut_lineage(ranked(
        own.where(F.col("source").isin(sources)).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), ["source"], ["_h", "doc_id"], running="tokens"))
    cut, fillers = last_pass(stream, {s: quota[s] % have[s] for s in sources})
    shared = spark.sparkContext.broadcast((sources, quota, have, block, blocks, cut, fillers))  # a few rows for each source

    def draw(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources_, quota_, have_, block_, blocks_, cut_, fillers_ = shared.value
        for b in rows:
            parts = []
            for name, at in b.groupby("source").indices.items():
                i = sources_.index(name)
                before, n = b["tokens_before"].to_numpy(np.int64)[at], have_[name]
                tokens, doc, rank = b["tokens"].to_numpy(np.int64)[at], b["doc_id"].to_numpy()[at], b["rank"].to_numpy(np.int64)[at]
                final = quota_[name] // n
                for copy in range(final + (quota_[name] % n > 0)):
                    position, use = before + copy * n, np.ones(len(at), bool)
                    if copy == final:
                        use = rank < cut_.get(name, n + 1)
                        for k in np.flatnonzero(np.isin(doc, list(fillers_.get(name, {})))).tolist():
                            position[k], use[k] = copy * n + fillers_[name][doc[k]], True
                    place = permuted(position[use] // block_, blocks_[i], seed + i)
                    parts.append(pd.DataFrame({
                        "shard": shard_of(np.full(len(place), i), place, blocks_, shards, seed), "doc_id": doc[use],
                        "source": name, "copy": copy, "tokens": tokens[use]}))
            if parts:
                yield pd.concat(parts)

    drawn = stream.select("doc_id", "source", "tokens", "tokens_before", "rank").mapInPandas(draw, "shard int, doc_id bigint, source string, copy int, tokens bigint")
    # A shard's size is bounded, so its window is too.
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "copy", "doc_id"), "doc_id", "copy")
    return drawn.withColumn("position", F.row_number().over(order) - 1).select("shard", "position", "doc_id", "source", "copy", "tokens")


def report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For every target: what the source has, what was drawn, and the share reached."""
    asked = targets.where("source is not null").dropDuplicates(["source"]).select("source", "target_share", "max_repeats")
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    # Uses of a document are numbered from 0, so their number needs no shuffle by document.
    drawn = mixed.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    whole = F.sum("drawn").over(Window.partitionBy())  # a row for each target
    return (
        asked.join(F.broadcast(have.join(asked.select("source"), "source", "left_semi")), "source", "left").join(F.broadcast(drawn), "source", "left")
        .na.fill(0, ["documents", "available", "drawn", "uses", "most_uses"])
        .withColumn("share", F.coalesce(F.try_divide(F.col("drawn").cast("double"), whole), F.lit(0.0)))
        .withColumn("note", F.when(F.col("available") == 0, "no tokens; its share went to the others").when(
            F.col("drawn") == F.col("available") * F.col("max_repeats"), "used as often as allowed").otherwise(""))
        .select("source", "target_share", "max_repeats", "documents", "available", "drawn", "uses", "most_uses", "share", "note")
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(with_tokens(table(spark, sf_dir, "documents", "doc_id", "source", "text")))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return report(mix(sizes, targets), sizes, targets)


QUERIES = {"p7_mixture": p7_mixture, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
