"""Items over a size limit, cut into ordered pieces at natural boundaries, with overlap.

Method: byte-range processing for giant files.  An item is a stretch of bytes in a file; it is
read in ranges of bytes, each with a halo before it, so that a boundary at its rim is seen
whole, and a halo of `limit` characters behind it, in which the next cut is found.

1. A worker finds the boundaries of its range, and for each place where a piece may have ended
   in the first `limit` characters, where the chain of cuts that goes on from there leaves the
   range and how many cuts it makes.  Only these tables leave the worker.
2. The tables of `FAN` neighbouring ranges are stitched to one, and so on, until there is one
   for each item; on the way back every range learns the cut at which the chain enters it, and
   by prefix sums the characters and the cuts before it.
3. The range is read again and the pieces that begin in it are emitted by their offsets.

Nothing holds an item or its boundaries as a whole.  Files are opened by URI (`file`, `hdfs`,
`s3`, ...; a path without a scheme is local), which all workers must see.  `split_items` writes
the long items of a table to such files first, in the session's `spark.checkpoint.dir`.

A piece starts `overlap` characters before the end of the piece before it, so consecutive
pieces share exactly that many.  A piece ends at the strongest boundary in the last part of
its window (paragraph, sentence, clause, blank, then a character of a grid with a step of at
most an eighth of the limit, never between a letter and its combining marks if another place
is there), and at the last one among equally strong ones.

Defined results: a null or empty text, or one within the limit, yields no piece (`split_files`:
one); a null or unknown language, and a null limit, mean no limit; an overlap that isn't below
the limit is an error, as pieces couldn't advance, a null or negative one means none; repeated
rows count once.  Positions are code points.  A run of marks and blanks longer than the halo
before a range counts from the halo on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, shared_folder, table

#: Bytes of a range, and of the halo before it.
RANGE, HALO = 1 << 22, 1 << 10
#: Ranges whose tables are stitched in one task.
FAN = 64
#: The part of a window in which a weaker boundary isn't preferred for being later.
LAST_PART = 0.5

# Boundaries by strength: a cut may be made after the match.
_CLOSE = "”’»」』）)】》〉\\]\"'"
STRENGTHS = (
    (4, re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+")),
    (3, re.compile(rf"(?:[。｡！？…؟۔।॥]+[{_CLOSE}]*|[.!?]+[{_CLOSE}]*(?=\s))\s*")),
    (2, re.compile(rf"(?:[，、；：]+[{_CLOSE}]*|[,;:—]+[{_CLOSE}]*(?=\s))\s*")),
    (1, re.compile(r"\s+")),
)
MARKS = re.compile(r"[\u0300-\u036f\u200c\u200d\u3099\u309a\ufe00-\ufe0f]")


def boundaries(text: str) -> dict[int, int]:
    """Offsets in `text` after which a cut is natural, with their strengths; -1 bars one."""
    best: dict[int, int] = {}
    for strength, pattern in STRENGTHS:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    for m in MARKS.finditer(text):
        best[m.start()] = -1
    return best


class Cuts:
    """Where pieces may end in text[lead:], and for each such place where the next piece ends.

    `text` begins with a halo of `lead` characters; with `last` it ends with the item.
    Positions count from the end of the halo, which lies `byte` bytes into the item.
    """

    def __init__(self, text: str, lead: int, byte: int, limit: int, overlap: int, last: bool) -> None:
        self.limit, self.overlap = limit, overlap
        code = np.frombuffer(text[lead:].encode("utf-32-le"), np.uint32)
        self.byte = byte + np.concatenate([[0], np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))])
        self.total = len(code) if last else None
        # The grid lies on the item's bytes, which every range knows: on the characters that begin a step.
        step = self.byte // max(1, min(limit // 8, limit - overlap))
        strength = np.full(len(code) + 1, -2, np.int8)
        strength[1:][step[1:] != step[:-1]] = 0
        found = [(p - lead, k) for p, k in boundaries(text).items() if p > lead]
        if found:
            at, k = np.array(found, np.int64).T
            strength[at] = k
        self.at = np.flatnonzero(strength > -2)
        self.by_strength = [(k, np.flatnonzero(strength == k)) for k in (4, 3, 2, 1, 0, -1)]

    def after(self, start: np.ndarray) -> np.ndarray:
        """The end of the piece that begins at each start; -1 for one that ends with the item."""
        lo, hi = start + max(self.overlap + 1, int(self.limit * LAST_PART)), start + self.limit
        out = np.full(len(start), -2, np.int64)
        for _, at in self.by_strength:
            if len(at):
                n = np.searchsorted(at, hi, "right")
                found = at[np.maximum(n - 1, 0)]
                out = np.where((out == -2) & (n > 0) & (found >= lo), found, out)
        return out if self.total is None else np.where(hi >= self.total, -1, out)

    def steps(self, size: int, from_begin: bool) -> dict[int, int]:
        """The next cut after each place in the first `size` characters; 0 is the item's begin."""
        at = self.at[(self.at <= size) & (self.at > 0)]
        out = dict(zip(at.tolist(), self.after(at - self.overlap).tolist()))
        if from_begin:
            out[0] = int(self.after(np.zeros(1, np.int64))[0])
        return out

    def chains(self, size: int, from_begin: bool) -> dict[int, tuple[int, int]]:
        """For each place where the chain of cuts may enter: where it leaves the first `size`
        characters (counted from their end; -1 if it ends there) and how many cuts it makes.
        """
        made: dict[int, tuple[int, int]] = {}
        after = self.steps(size, from_begin)
        for p in sorted(after, reverse=True):
            q, own = after[p], int(p > 0)
            if q == -1:
                made[p] = -1, own
            elif q > size:
                made[p] = q - size, own
            else:
                end, n = made[q]
                made[p] = end, n + own
        return {0: made[0]} if from_begin else {p: m for p, m in made.items() if p <= self.limit}


def _first(data: bytes, at: int) -> int:
    """The first byte from `at` on that begins a character of UTF-8."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


@lru_cache(8)
def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def local(path: str) -> str:
    """The path itself if its scheme is that of local files."""
    return re.sub(r"^file:/+", "/", path)


def range_cuts(path: str, start: int, n_bytes: int, first: int, size: int, limit: int, overlap: int) -> tuple[str, int, int, Cuts]:
    """(text, its characters before the range, those of the range, cuts) of one range.

    A character belongs to the range in which it begins.
    """
    before = min(first, HALO + 4 * limit + 3)
    behind = min(n_bytes - first - size, HALO + 4 * limit + 3)
    data = _opened(path).read_at(before + size + behind, start + first - before)
    ends = first + size + behind == n_bytes
    a, b = (_first(data, before) if first else 0), _first(data, before + size)
    y, z = (_first(data, 0) if before < first else 0), len(data)
    if not ends:  # the last character may be cut
        while data[z - 1] & 0xC0 == 0x80:
            z -= 1
        z -= 1
    ahead, own = data[y:a].decode(), data[a:b].decode()
    text = ahead + own + data[b:z].decode()
    # The halo for boundaries is as wide in every range, whatever the limit.
    lead = len(data[_first(data, max(y, a - HALO)) : a].decode())
    return text, len(ahead), len(own), Cuts(text[len(ahead) - lead :], lead, first - before + a, limit, overlap, ends)


def ranges(items: DataFrame) -> DataFrame:
    """A row for each range of items (path, start, n_bytes, limit, overlap, ...): also no, first, size, parts.

    A range holds at least four times the limit, so that no chain of cuts passes over one.
    """
    return (
        items.withColumn("_wide", F.greatest(F.lit(RANGE).cast("bigint"), F.col("limit").cast("bigint") * 16))
        .withColumn("parts", F.greatest(F.expr("(n_bytes - 1) div _wide + 1"), F.lit(1)))
        .withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .withColumn("first", F.col("no") * F.col("_wide")).withColumn("size", F.least(F.col("_wide"), F.col("n_bytes") - F.col("first"))).drop("_wide")
    )


KEY = ["path", "start"]
CHAINS = "path string, start bigint, no bigint, chars bigint, entry array<bigint>, leaves array<bigint>, cuts array<bigint>"
PLACE = "path string, start bigint, no bigint, at bigint, chars_before bigint, cuts_before bigint"


def look(parts: DataFrame) -> DataFrame:
    """The table of each range: its characters, and its chains of cuts by where they enter."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for path, start, n_bytes, limit, overlap, no, first, size in b.itertuples(index=False):
                _, _, own, cuts = range_cuts(path, start, n_bytes, first, size, limit, overlap)
                made = cuts.chains(own, no == 0)
                out.append((path, start, no, own, list(made), [m[0] for m in made.values()], [m[1] for m in made.values()]))
            yield pd.DataFrame(out, columns=[*KEY, "no", "chars", "entry", "leaves", "cuts"])

    return parts.select(*KEY, "n_bytes", "limit", "overlap", "no", "first", "size").mapInPandas(run, CHAINS)


def _stitch(group: pd.DataFrame) -> pd.DataFrame:
    """The tables of neighbouring ranges as that of one."""
    group = group.sort_values("no")
    tables = [dict(zip(e, zip(l, c))) for e, l, c in zip(group["entry"], group["leaves"], group["cuts"])]
    entry, leaves, cuts = [], [], []
    for e in tables[0]:
        at, n = e, 0
        for t in tables:
            if at != -1:
                at, more = t[at]
                n += more
        entry.append(e)
        leaves.append(at)
        cuts.append(n)
    one = group.iloc[0]
    return pd.DataFrame([(one["path"], one["start"], one["up"], int(group["chars"].sum()), entry, leaves, cuts)], columns=[*KEY, "no", "chars", "entry", "leaves", "cuts"])


def _descend(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain enters each of the ranges, from where it enters the first."""
    group = group.sort_values("no")
    at, chars, cuts = int(group["at"].iloc[0]), int(group["chars_before"].iloc[0]), int(group["cuts_before"].iloc[0])
    out = []
    for no, own, entry, leaves, made in zip(group["no"], group["chars"], group["entry"], group["leaves"], group["cuts"]):
        out.append((no, at, chars, cuts))
        chars += own
        if at != -1:
            k = list(entry).index(at)
            at, cuts = int(leaves[k]), cuts + int(made[k])
    return pd.DataFrame(out, columns=["no", "at", "chars_before", "cuts_before"]).assign(path=group["path"].iloc[0], start=group["start"].iloc[0])[[*KEY, "no", "at", "chars_before", "cuts_before"]]


def entries(parts: DataFrame) -> DataFrame:
    """Where the chain of cuts enters each range of the items with several (-1: it has ended before)."""
    several = parts.where("parts > 1")
    most = several.agg(F.max("parts")).first()[0]
    if most is None:
        return parts.sparkSession.createDataFrame([], PLACE)
    levels = [cut_lineage(look(several))]
    while most > 1:
        up = levels[-1].withColumn("up", F.expr(f"no div {FAN}"))
        levels.append(cut_lineage(up.groupBy(*KEY, "up").applyInPandas(_stitch, CHAINS)))
        most = -(-most // FAN)
    zero = F.lit(0).cast("bigint")
    placed = levels.pop().select(*KEY, "no", zero.alias("at"), zero.alias("chars_before"), zero.alias("cuts_before"))
    while levels:
        below = levels.pop().withColumn("up", F.expr(f"no div {FAN}")).join(placed.withColumnRenamed("no", "up"), [*KEY, "up"])
        placed = cut_lineage(below.groupBy(*KEY, "up").applyInPandas(_descend, PLACE))
    return placed


PIECE = "item_kind string, item_id bigint, path string, piece bigint, start_pos bigint, end_pos bigint, start_byte bigint, end_byte bigint, text string"


def cut_ranges(items: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of items (item_kind, item_id, path, start, n_bytes, limit, overlap), each emitted by the range it begins in.

    Bytes count from the begin of the item.
    """
    spark = items.sparkSession
    own = items.select("item_kind", "item_id", *KEY, "n_bytes", "limit", "overlap")
    # Few bytes tell of many: the number of tasks follows from what they will read.
    volume = own.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (16 * RANGE)))
    parts = cut_lineage(ranges(own).repartition(tasks, *KEY, "no"))
    single = parts.where("parts = 1").withColumns({c: F.lit(0).cast("bigint") for c in ("at", "chars_before", "cuts_before")})
    several = parts.where("parts > 1").join(entries(parts), [*KEY, "no"]).where("at >= 0")
    # The join of small rows leaves few partitions.
    placed = single.unionByName(several.repartition(tasks, *KEY, "no"))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for kind, item, path, start, n_bytes, limit, overlap, no, first, size, at, chars, piece in b.itertuples(index=False):
                text, lead, own_, cuts = range_cuts(path, start, n_bytes, first, size, limit, overlap)
                after = cuts.steps(own_, no == 0)
                while at != -1 and at <= own_:
                    s, e = max(0 if no == 0 else -lead, at - overlap) if at else 0, after[at]
                    z = len(text) - lead if e == -1 else e
                    body = text[lead + s : lead + z]
                    end = int(cuts.byte[z])
                    out.append((kind, item, path, piece + (at > 0), chars + s, chars + z, end - len(body.encode()), end, body if with_text else None))
                    piece += at > 0
                    at = e
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "path", "piece", "start_pos", "end_pos", "start_byte", "end_byte", "text"])

    return placed.select("item_kind", "item_id", *KEY, "n_bytes", "limit", "overlap", "no", "first", "size", "at", "chars_before", "cuts_before").mapInPandas(run, PIECE)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int) -> DataFrame:
    """(path, piece, start_pos, end_pos, start_byte, end_byte, text) of UTF-8 files; other bytes are an error."""
    from pyarrow import fs

    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} isn't below the limit {limit}")
    found = []
    for p in map(local, paths):
        system, name = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
        found.append(("file", None, p, 0, system.get_file_info(name).size, limit, overlap))
    items = spark.createDataFrame(found, "item_kind string, item_id bigint, path string, start bigint, n_bytes bigint, limit int, overlap int")
    return cut_ranges(items).drop("item_kind", "item_id")


# --- items of a table --------------------------------------------------------------------


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The items over the limit of their language, with limit and overlap."""
    rows = bounded_rows(limits.where("lang is not null and max_chars > 0").dropDuplicates(["lang"]), 10_000, "size_limits")
    if bad := [r.lang for r in rows if (r.overlap_chars or 0) >= r.max_chars]:
        raise ValueError(f"size_limits: an overlap isn't below the limit for {sorted(bad)}")
    if not rows:
        return items.where("false").withColumns({"limit": F.lit(0), "overlap": F.lit(0)})
    small = F.create_map(*[x for r in rows for x in (F.lit(r.lang), F.struct(F.lit(r.max_chars).alias("limit"), F.lit(max(r.overlap_chars or 0, 0)).alias("overlap")))])
    return (
        items.withColumn("_l", small[F.col("lang")])
        .where(F.length("text") > F.col("_l.limit"))
        .withColumns({"limit": F.col("_l.limit"), "overlap": F.col("_l.overlap")})
        .drop("_l")
    )


STORED = "item_kind string, item_id bigint, path string, start bigint, n_bytes bigint, limit int, overlap int"


def stored(items: DataFrame) -> DataFrame:
    """Texts written to files in the folder that all workers share, one for each task, and where each is."""
    folder = local(f"{shared_folder(items.sparkSession)}/items-{uuid.uuid4().hex}")

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        out, path, at = None, uuid.uuid4().hex, 0  # a task that runs again writes another file
        try:
            for b in rows:
                if len(b) and out is None:
                    system.create_dir(name)
                    out = system.open_output_stream(f"{name}/{path}")
                data = [t.encode() for t in b["text"]]
                for d in data:
                    out.write(d)
                n = np.array([len(d) for d in data], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield b[["item_kind", "item_id"]].assign(path=f"{folder}/{path}", start=start, n_bytes=n, limit=b["limit"], overlap=b["overlap"])
        finally:
            if out is not None:
                out.close()

    return cut_lineage(items.select("item_kind", "item_id", "text", "limit", "overlap").mapInPandas(run, STORED))


def split_items(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, piece, start_pos, end_pos[, text]) of the items over their limit."""
    kept = stored(oversized(items, limits).where("item_id is not null"))
    # A repeated row is told by where it was stored: no text moves.
    once = kept.groupBy("item_kind", "item_id").agg(F.min(F.struct("path", "start", "n_bytes", "limit", "overlap")).alias("o")).select("item_kind", "item_id", "o.*")
    return cut_ranges(once, with_text).select("item_kind", "item_id", "piece", "start_pos", "end_pos", *(["text"] if with_text else []))


def check(pieces: DataFrame, items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id, chars, in_limit, overlaps, digest): what the pieces keep.

    `overlaps`: consecutive pieces share exactly what they should; `digest`: of the text put
    together again from the pieces.
    """
    rows = bounded_rows(limits.where("lang is not null and max_chars > 0").dropDuplicates(["lang"]), 10_000, "size_limits")
    asked = items.where("item_id is not null").groupBy("item_kind", "item_id").agg(F.min("lang").alias("lang"))
    room = F.create_map(*[x for r in rows for x in (F.lit(r.lang), F.struct(F.lit(r.max_chars).alias("limit"), F.lit(max(r.overlap_chars or 0, 0)).alias("overlap")))])[F.col("lang")]
    own = pieces.groupBy("item_kind", "item_id").agg(F.sort_array(F.collect_list(F.struct("piece", "start_pos", "end_pos", "text"))).alias("p")).join(asked, ["item_kind", "item_id"]).withColumn("room", room)
    follow = F.expr("transform(sequence(1, size(p) - 1), i -> p[i - 1].end_pos - p[i].start_pos = room.overlap and right(p[i - 1].text, room.overlap) = left(p[i].text, room.overlap))")
    return own.select(
        "item_kind", "item_id", F.array_max("p.end_pos").alias("chars"),
        F.expr("forall(p, x -> length(x.text) <= room.limit and length(x.text) = x.end_pos - x.start_pos)").alias("in_limit"),
        F.when(F.size("p") > 1, F.forall(follow, lambda x: x)).otherwise(False).alias("overlaps"),
        F.md5(F.expr("concat(p[0].text, array_join(transform(slice(p, 2, size(p)), x -> substring(x.text, room.overlap + 1)), ''))")).alias("digest"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "paragraphs", "paragraph_id", "lang", "text").select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), "lang", "text")
    s = table(spark, sf_dir, "sentences", "sentence_id", "lang", "text").select(F.lit("sentence").alias("item_kind"), F.col("sentence_id").alias("item_id"), "lang", "text")
    return p.unionByName(s)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"), with_text=False).where("piece = 1").select("item_kind", "item_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, limits = _items(spark, sf_dir), table(spark, sf_dir, "size_limits")
    return check(split_items(items, limits), items, limits)


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_check": p3_check}
_LONG = """
  SELECT DISTINCT i.item_kind, i.item_id{} FROM (
    SELECT 'paragraph' AS item_kind, paragraph_id AS item_id, lang, text FROM paragraphs
    UNION ALL SELECT 'sentence', sentence_id, lang, text FROM sentences) i
  JOIN size_limits l ON i.lang = l.lang WHERE length(i.text) > l.max_chars
"""
ORACLE: dict[str, str] = {
    "p3_found": _LONG.format(""),
    "p3_check": _LONG.format(", length(i.text) AS chars, true AS in_limit, true AS overlaps, md5(i.text) AS digest"),
}
