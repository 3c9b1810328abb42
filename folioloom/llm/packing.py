"""Documents in containers of fixed capacity, with as little empty room as possible.

Method: bin completion by branch-and-bound.  The largest document left is completed with the
undominated fillings of the room beside it, those with the least waste first; a branch ends
where its waste alone needs more containers than the best solution so far.  Best-fit
decreasing gives the first solution.

A filling is dominated if another one can take its place: if a document left out fits where
some of the filling's documents (or the empty room) are, and is at least as large as they are.
Fillings are enumerated lazily, waste by waste, and all undominated ones of a node are tried,
each as often as the counts allow, then less often.  The search ends when nothing is left to
try, when the lower bound is met, or when it has taken its steps (`STEPS`, `NODE_STEPS`).

Documents of one size can stand for each other, so the search runs on the counts by size: at
most `capacity` numbers for each capacity, whatever the corpus, in one task a capacity.  The
result is a list of fillings; each document gets its container from its rank among the
documents of its size, so no task ever holds a group of documents.

A document over the capacity is cut into full containers and a rest, which is packed like any
other document.  Defined results: a document without tokens (null, empty or blank text) goes
to container 0 and takes no room; rows without doc_id or capacity are no documents and
containers; repeated capacities count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, ranked, table
from folioloom.llm.tokens import with_tokens

#: Steps of one search, and of the fillings of one node: an item put into a filling is a step,
#: or several where capacities are large, as a step's time grows with the capacity.
STEPS, NODE_STEPS, STEP_BITS = 400_000, 4_000, 1 << 16


@dataclass
class Filling:
    sizes: tuple[int, ...]  # decreasing
    times: int


@dataclass
class Packing:
    fillings: list[Filling] = field(default_factory=list)
    proved: bool = True  # no packing has fewer containers

    @property
    def containers(self) -> int:
        return sum(f.times for f in self.fillings)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by large items that can't share (L2)."""
    if not counts:
        return 0
    s = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(x)] for x in s], np.int64)
    number, volume = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], (s * n).cumsum()])
    half = int(np.searchsorted(s, capacity // 2, "right"))  # those from here on exceed half a container
    k = np.concatenate([[0], s[:half]])
    at_k, far = np.searchsorted(s, k, "left"), np.searchsorted(s, capacity - k, "right")
    alone, middle = number[-1] - number[far], number[far] - number[half]
    room = middle * capacity - (volume[far] - volume[half])
    small = volume[half] - volume[at_k]
    return int((alone + middle + np.maximum(0, -(-(small - room) // capacity))).max())


def _spread(sums: int, waste: int) -> int:
    """The bits of `sums` moved up by 1 to `waste`."""
    if not waste:
        return 0
    out, width = sums << 1, 1
    while width < waste:
        step = min(width, waste - width)
        out |= out << step
        width += step
    return out


def fillings(room: int, sizes: np.ndarray, counts: np.ndarray, slack: Callable[[], int], step: Callable[[], bool]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of `room` that waste at most `slack()`, by waste and then by larger items.

    Sets of sizes and of sums are integers with a bit for each.  A partial filling is given up
    as soon as it is dominated: later items are no larger than those it holds, so they can't
    change that.  Ends early if `step()` says so.
    """
    fit = (sizes <= room) & (counts > 0)
    sizes, counts = sizes[fit], counts[fit]
    left_of = dict(zip(sizes.tolist(), counts.tolist()))
    volume = np.concatenate([[0], (sizes * counts).cumsum()])
    bits = np.zeros(room + 1, np.uint8)
    bits[sizes] = 1
    free = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    if not free:
        if room <= slack():
            yield ()
        return
    waste = max(0, room - int(volume[-1]))
    while waste <= min(slack(), room - 1):
        chosen: list[int] = []
        frames: list[list[int]] = []  # what is left to fill, the next item to try, sums of one or more items, of two or more

        def enter(left: int, last: int, sums: int, sums2: int) -> None:
            top = (free & ((2 << min(last, left + waste)) - 1)).bit_length() - 1
            # An item left out that is as large as the rest takes its place, unless it is the rest.
            frames.append([left, top if top <= left else 0, sums, sums2])

        enter(room - waste, room, 0, 0)
        while frames:
            frame = frames[-1]
            left, y, sums, sums2 = frame
            if y <= 0 or int(volume[np.searchsorted(sizes, y, "right")]) < left:
                frames.pop()
                if chosen:
                    x = chosen.pop()
                    left_of[x] += 1
                    free |= 1 << x
                continue
            frame[1] = 0 if y == left else (free & ((1 << y) - 1)).bit_length() - 1
            if not step():
                return
            left_of[y] -= 1
            if not left_of[y]:
                free &= ~(1 << y)
            sums, sums2 = sums | sums << y | 1 << y, sums2 | sums << y
            if not (sums2 | _spread(sums, waste)) & free:
                if left > y:
                    chosen.append(y)
                    enter(left - y, y, sums, sums2)
                    continue
                if not free & ((2 << waste) - 1):
                    yield (*chosen, y)
            left_of[y] += 1
            free |= 1 << y
        waste += 1


def _most(have: dict[int, int], sizes: tuple[int, ...]) -> int:
    """How often the counts allow a filling."""
    need: dict[int, int] = {}
    for s in sizes:
        need[s] = need.get(s, 0) + 1
    return min(have[s] // k for s, k in need.items())


def greedy(sizes: np.ndarray, n: np.ndarray, room: int, upto: int) -> list[int]:
    """Items for `room`, always the largest that fits; `n` is what is left of sizes[: upto + 1]."""
    out, at = [], upto
    while True:
        at = min(at, int(np.searchsorted(sizes, room, "right")) - 1)
        while at >= 0 and n[at] <= 0:
            at -= 1
        if at < 0:
            return out
        take = min(int(n[at]), room // int(sizes[at]))
        out += [int(sizes[at])] * take
        room -= take * int(sizes[at])
        at -= 1


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Decreasing, each container completed by the largest item that fits: the first solution."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    out = Packing(proved=False)
    for k in range(len(sizes) - 1, -1, -1):
        while n[k] > 0:
            n[k] -= 1
            chosen = (int(sizes[k]), *greedy(sizes, n, capacity - int(sizes[k]), k))
            n[k] += 1
            at, need = np.unique(np.searchsorted(sizes, chosen), return_counts=True)
            times = int((n[at] // need).min())
            n[at] -= need * times
            out.fillings.append(Filling(chosen, times))
    return out


def complete(counts: dict[int, int], capacity: int, steps: int = STEPS, node_steps: int = NODE_STEPS) -> Packing:
    """Bin completion over the counts by size (0 < size <= capacity)."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return Packing()
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    sizes = np.array(sorted(counts), np.int64)
    have = dict(counts)
    total = sum(s * n for s, n in counts.items())
    price = 1 + capacity // STEP_BITS
    spent = used = waste = 0
    exact = True

    def slack() -> int:
        """Waste that still allows one container less than the best solution."""
        return (best.containers - 1) * capacity - total - waste

    def options(before: tuple[int, ...] | None) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings with the largest item left and how often: as often as possible first.

        `before` was used as often as it is to be used.
        """
        nonlocal spent, exact
        n = np.array([have[s] for s in sizes.tolist()], np.int64)
        k = int(np.flatnonzero(n)[-1])
        x = int(sizes[k])
        n[k] -= 1
        mine = 0

        def step() -> bool:
            nonlocal spent, mine
            mine += price
            spent += price
            return mine <= node_steps and spent <= steps

        found = False
        for f in fillings(capacity - x, sizes, n, slack, step):
            f = (x, *f)
            if f != before:
                for times in range(_most(have, f), 0, -1):
                    found = True
                    yield f, times
        if mine > node_steps or spent > steps:
            exact = False
            if not found:  # what best-fit would do
                f = (x, *greedy(sizes, n, capacity - x, k))
                yield f, _most(have, f)

    # Depth-first without recursion: a frame yields what is still to be tried at its node.
    path: list[Filling] = []
    frames: list[Iterator[tuple[tuple[int, ...], int]]] = [options(None)]
    dived = False  # the first descent goes to its end
    while frames and best.containers > bound and (spent <= steps or not dived):
        move = next(frames[-1], None) if slack() >= 0 else None
        if move is None:
            dived = True
            frames.pop()
            if path:
                f = path.pop()
                for s in f.sizes:
                    have[s] += f.times
                used -= f.times
                waste -= f.times * (capacity - sum(f.sizes))
            continue
        f = Filling(*move)
        for s in f.sizes:
            have[s] -= f.times
        path.append(f)
        used += f.times
        waste += f.times * (capacity - sum(f.sizes))
        if not any(have.values()):
            if used < best.containers:
                best = Packing(list(path), False)
            frames.append(iter(()))
        else:
            frames.append(options(f.sizes))
    best.proved = best.containers == bound or exact and not frames
    return best


# --- over DataFrames ---------------------------------------------------------------------


def items(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity, doc_id, piece, start, tokens): a document's pieces at each capacity."""
    caps = capacities.where("capacity_id is not null and capacity_tokens > 0").dropDuplicates(["capacity_id"])
    rows = bounded_rows(caps.orderBy("capacity_id"), 1000, "pack_capacity")
    pairs = F.array(*[F.struct(F.lit(r.capacity_id).alias("capacity_id"), F.lit(r.capacity_tokens).alias("capacity")) for r in rows])
    if not rows:
        pairs = F.expr("cast(array() as array<struct<capacity_id:string,capacity:int>>)")
    cut = sizes.select("doc_id", "tokens", F.explode(pairs).alias("cap")).select(
        "cap.capacity_id", "cap.capacity", "doc_id", "tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(tokens + cap.capacity - 1) div cap.capacity - 1"), F.lit(0)).cast("bigint"))).alias("piece"))
    return cut.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("size", F.least(F.col("tokens") - F.col("start"), F.col("capacity"))).drop("tokens")


def plans(tally: DataFrame) -> DataFrame:
    """(capacity_id, size, first, base, proved): where the documents of a size go, by their rank.

    `tally` is (capacity_id, capacity, size, n), at most `capacity` rows for each capacity.
    Documents of a size from rank `first` on fill the containers from `base` on, one each.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        packing = complete(dict(zip(own["size"].tolist(), own["n"].tolist())), int(own["capacity"].iloc[0]))
        base, taken, slots = 0, {}, []
        for f in packing.fillings:
            for s in f.sizes:
                slots.append((s, taken.get(s, 0), base))
                taken[s] = taken.get(s, 0) + f.times
            base += f.times
        return pd.DataFrame(slots, columns=["size", "first", "base"]).assign(capacity_id=own["capacity_id"].iloc[0], proved=packing.proved)[["capacity_id", "size", "first", "base", "proved"]]

    return tally.groupBy("capacity_id").applyInPandas(run, "capacity_id string, size bigint, first bigint, base bigint, proved boolean")


#: Slots sent to all executors, 24 bytes each; more of them are joined by stretches of `STRETCH` ranks.
MOST_SLOTS, STRETCH = 2_000_000, 16


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container, doc_id, piece, start_token, tokens, proved) of (doc_id, tokens).

    `proved`: no packing of that capacity has fewer containers.
    """
    every = items(sizes, capacities)
    places = cut_lineage(ranked(every.where("size > 0"), ["capacity_id", "capacity", "size"], ["doc_id", "piece"]))
    slots = cut_lineage(plans(places.groupBy("capacity_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))))
    own = places.select("capacity_id", "doc_id", "piece", "start", "size", "rank")
    if slots.count() <= MOST_SLOTS:
        placed = _place_by_table(own, slots.toPandas())
    else:
        placed = _place_by_join(own, slots)
    none = every.where("size <= 0").select(
        "capacity_id", F.lit(0).cast("bigint").alias("container"), "doc_id", "piece", F.col("start").alias("start_token"), F.lit(0).cast("bigint").alias("tokens"))
    # A capacity that holds only documents without tokens has nothing to prove.
    sure = slots.groupBy("capacity_id").agg(F.min("proved").alias("proved"))
    return placed.unionByName(none).join(F.broadcast(sure), "capacity_id", "left").withColumn("proved", F.coalesce("proved", F.lit(True)))


PLACED = "capacity_id string, container bigint, doc_id bigint, piece bigint, start_token bigint, tokens bigint"


def _place_by_table(places: DataFrame, slots: pd.DataFrame) -> DataFrame:
    tables = {}
    for name, own in slots.sort_values(["size", "first"]).groupby("capacity_id"):
        tables[name] = own["size"].to_numpy(np.int64), own["first"].to_numpy(np.int64), own["base"].to_numpy(np.int64)
    shared = places.sparkSession.sparkContext.broadcast(tables)

    def place(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            container = np.zeros(len(b), np.int64)
            for name, at in b.groupby("capacity_id").indices.items():
                size, first, base = shared.value[name]
                mine, rank = b["size"].to_numpy(np.int64)[at], b["rank"].to_numpy(np.int64)[at]
                # Among the slots and documents in the order of (size, rank), the last slot not behind a document.
                order = np.lexsort((np.repeat([0, 1], [len(size), len(at)]), np.concatenate([first, rank]), np.concatenate([size, mine])))
                is_slot = order < len(size)
                k = order[np.maximum.accumulate(np.where(is_slot, np.arange(len(order)), 0))][~is_slot]
                d = order[~is_slot] - len(size)
                container[at[d]] = base[k] + rank[d] - first[k]
            yield pd.DataFrame({"capacity_id": b["capacity_id"], "container": container, "doc_id": b["doc_id"], "piece": b["piece"], "start_token": b["start"], "tokens": b["size"]})

    return places.mapInPandas(place, PLACED)


def _place_by_join(places: DataFrame, slots: DataFrame) -> DataFrame:
    """The same without a table on every executor; a stretch of ranks meets at most as many slots."""
    following = Window.partitionBy("capacity_id", "size").orderBy("first")  # as many as fillings have a size, not as documents
    ranges = slots.withColumn("upto", F.lead("first").over(following)).withColumn(
        "last", F.coalesce(F.floor((F.col("upto") - 1) / STRETCH), F.floor(F.col("first") / STRETCH))).withColumn("open", F.col("upto").isNull())
    closed = ranges.where("not open").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / STRETCH), "last")))
    near = places.withColumn("stretch", F.floor(F.col("rank") / STRETCH)).join(closed.select("capacity_id", "size", "first", "upto", "base", "stretch"), ["capacity_id", "size", "stretch"]).where(
        "rank >= first and rank < upto")
    # The last slot of a size takes all the rest: one for each size.
    rest = places.join(ranges.where("open").select("capacity_id", "size", "first", "base"), ["capacity_id", "size"]).where("rank >= first")
    columns = ["capacity_id", (F.col("base") + F.col("rank") - F.col("first")).alias("container"), "doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("tokens")]
    return near.select(*columns).unionByName(rest.select(*columns))


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and fill by capacity, the containers that the volume alone needs, and whether fewer can't do."""
    return (
        packed.groupBy("capacity_id").agg(F.max("container").alias("last"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.min("proved").alias("proved"))
        .join(capacities.where("capacity_tokens > 0").dropDuplicates(["capacity_id"]).select("capacity_id", "capacity_tokens"), "capacity_id")
        .select("capacity_id", "capacity_tokens", "pieces", "tokens", (F.col("last") + 1).alias("containers"),
                F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("needed_by_volume"),
                (F.col("tokens") / ((F.col("last") + 1) * F.col("capacity_tokens"))).alias("fill"), "proved")
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(with_tokens(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "tokens"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = table(spark, sf_dir, "pack_capacity")
    return report(pack(_sizes(spark, sf_dir), caps), caps)


QUERIES = {"p6_containers": p6_containers, "p6_report": p6_report}
ORACLE: dict[str, str] = {}
