"""Faceted questions: filters, search, grouped counts, pivots, rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "all"


def facet(column: Column, value: str) -> Column:
    """equal to the value, which may stand for all."""
    return F.lit(True) if value == ALL else F.coalesce(column == value, F.lit(False))


def search(columns: Sequence[Column], query: str) -> Column:
    """the lower-cased fields, joined by blanks, hold the query as a plain substring."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q))


def counted(df: DataFrame, *keys: str, value: Column | None = None, name: str = "n") -> DataFrame:
    """A1, A2: rows, or a sum, by key."""
    return df.groupBy(*keys).agg((F.sum(value) if value is not None else F.count(F.lit(1))).alias(name))


def in_fixed_order(counts: DataFrame, key: str, values: Sequence[str], name: str = "n") -> DataFrame:
    """A row for every value in the order given, zero where nothing was counted."""
    spark = counts.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{key} string, position int")
    return order.join(counts, key, "left").na.fill(0, [name])


def position_in(column: Column, values: Sequence[str]) -> Column:
    """The place of a value in a list, from 0; -1 if it isn't there."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), column) - 1


def heat_map(df: DataFrame, row: str, column: str, columns: Sequence, value: Column | None = None) -> DataFrame:
    """A row for each value of `row`, a column for each of `columns`, zero where there is none."""
    agg = F.sum(value) if value is not None else F.count(F.lit(1))
    return df.groupBy(row).pivot(column, list(columns)).agg(agg).na.fill(0)


def share_of_most(df: DataFrame, value: str, floor: float, span: float) -> DataFrame:
    """Adds the share of the largest value, and how strongly it is shown (0 for 0).

    The largest value is one row, which joins every partition.
    """
    most = df.agg(F.max(value).alias("_most"))
    share = F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_most")), F.lit(0.0))
    return df.join(F.broadcast(most)).withColumn("share", share).withColumn(
        "intensity", F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.lit(floor) + F.col("share") * span)).drop("_most")


def top_by_text(df: DataFrame, by: str, key: str, count: str) -> DataFrame:
    """For each `by` the key with the largest count; of equals the smallest as text."""
    w = Window.partitionBy(by).orderBy(F.desc(count), F.col(key).cast("string"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranking(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows with their rank; a top-k, never a full sort."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def peaks(counts: Column) -> list[Column]:
    """Total, largest value, its first position, first and last position with a count (from 1; 0 if none)."""
    places = F.filter(F.transform(counts, lambda x, i: F.when(x > 0, i + 1)), lambda p: p.isNotNull())
    most = F.array_max(counts)
    return [
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), most.alias("peak_value"),
        F.array_position(counts, most).cast("int").alias("peak"), F.coalesce(F.array_min(places), F.lit(0)).cast("int").alias("first"), F.coalesce(F.array_max(places), F.lit(0)).cast("int").alias("last"),
    ]


def keep_nested(df: DataFrame, array: str, keep) -> DataFrame:
    """rows of an array that pass, and only parents that have some."""
    return df.withColumn(array, F.filter(array, keep)).where(F.size(array) > 0)


def selected(df: DataFrame, flag: Column, key: str, wanted, *order: Column) -> DataFrame:
    """the wanted row if it passes, else the first that passes, else the first."""
    rank = F.when(flag & (F.col(key) == wanted), 0).when(flag, 1).otherwise(2)
    return df.withColumn("_r", rank).orderBy("_r", *order).limit(1).drop("_r")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by a partial maximum instead of a sort of all rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    m = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return m.select(*keys, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    m = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return m.select(*keys, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """The rows of all parts, each with its part's name."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def with_fallback(first: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """The first rows, and the second as well if the first are fewer than `least`."""
    short = first.limit(least).agg((F.count(F.lit(1)) < least).alias("_short"))
    return first.unionByName(second.join(F.broadcast(short), F.col("_short")).drop("_short"))


def value_at(values: Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values, at most the last; 0 if there are none."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(float(share))).cast("int"))
    return F.when(n > 0, F.array_sort(values)[at]).otherwise(F.lit(0))


def length_summary(df: DataFrame, key: str, length: str) -> DataFrame:
    """A7 for every key: min, median (cut down), 90, 95 and 99 % and max of a length.

    Lengths are counted first, so a key's array has its different lengths, not its rows.
    """
    counts = df.groupBy(key, length).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key).orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    run = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(whole))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(length)))

    n = F.col("_n")
    def share(s: float) -> Column:
        return at(F.least(n - 1, F.floor(n * F.lit(s))))

    mid = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return run.groupBy(key).agg(
        F.max("_n").alias("n"), F.min(length).alias("min"), mid.cast("int").alias("median"),
        share(0.90).alias("p90"), share(0.95).alias("p95"), share(0.99).alias("p99"), F.max(length).alias("max"))
