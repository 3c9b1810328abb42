"""The joins that ordered text needs (J1-J17) and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators.facets import last_per_key


def last_target(source: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """(source, target): an inner join where a source keeps its last target, by (on, target)."""
    joined = source.join(target, on)
    return joined.groupBy("source").agg(F.max(F.struct(on, "target")).alias("m")).select("source", F.col("m.target").alias("target"))


def ranges(starts: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, toc, label, first, next, files): spine positions from a start to the next one.

    `starts` has (keys, toc, href, label), `spine` (keys, pos, href); starts that the spine lacks
    count neither as starts nor as ends.
    """
    found = starts.join(spine, [*keys, "href"])
    w = Window.partitionBy(*keys).orderBy("toc")
    cut = found.withColumn("next", F.lead("pos").over(w)).select(*keys, "toc", "label", F.col("pos").alias("first"), "next")
    inside = cut.join(spine.select(*keys, "pos"), keys).where((F.col("pos") >= F.col("first")) & (F.col("next").isNull() | (F.col("pos") < F.col("next"))))
    return inside.groupBy(*keys, "toc", "label", "first", "next").agg(F.count(F.lit(1)).alias("files"))


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order_a: str, order_b: str, check: bool = False) -> DataFrame:
    """Rows of two sides joined by their place within the key; `check` asks for equal numbers."""
    def placed(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

    if check:
        counts = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb")), keys, "full").where("not na <=> nb")
        if not counts.isEmpty():
            raise ValueError("the sides differ in number")
    return placed(a, order_a).join(placed(b, order_b), [*keys, "place"])


def left_last(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row of `a`, with the last row of `b` for its key if there is one."""
    return a.join(last_per_key(b, keys, order), keys, "left")


def lookup(a: DataFrame, b: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A left join with a default for what isn't found."""
    return a.join(b, keys, "left").na.fill(defaults)


def until(df: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """The rows before the first one that stops."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)).where("_s = 0").drop("_s")


def interleaved(pairs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """K5: (keys, place, side, text): first[0], second[0], first[1], ... to the longer one's end."""
    both = pairs.select(*keys, F.posexplode(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b"))).alias("place", "z"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("z.a").alias("text")), F.struct(F.lit(1).alias("side"), F.col("z.b").alias("text")))
    return both.select(*keys, "place", F.explode(sides).alias("s")).where("s.text is not null").select(*keys, "place", "s.side", "s.text")
