"""Votes of quiz sessions: counters, preference rates, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "session string, ord int, question string, chosen string, appeared array<string>"


def last_answers(events: DataFrame) -> DataFrame:
    """Going back and choosing again replaces the answer: the last by (session, question)."""
    from folioloom.operators.facets import last_per_key

    return last_per_key(events, ["session", "question"], ["ord"])


def counters(answers: DataFrame) -> DataFrame:
    """(question, version, votes, appearances), with one pass over the answers."""
    seen = answers.select("question", F.explode(F.array_distinct(F.concat(F.array("chosen"), "appeared"))).alias("version"), "chosen", "appeared")
    return seen.where("version is not null").groupBy("question", "version").agg(
        F.count_if(F.col("version") == F.col("chosen")).alias("votes"), F.count_if(F.array_contains("appeared", F.col("version"))).alias("appearances"))


def completed(stats: DataFrame) -> DataFrame:
    """Older statistics lack appearances: there are at least as many as votes."""
    return stats.withColumn("votes", F.coalesce("votes", F.lit(0))).withColumn("appearances", F.greatest(F.coalesce("appearances", F.lit(0)), F.col("votes")))


def preference_rates(stats: DataFrame, versions: DataFrame) -> DataFrame:
    """A row for every version: votes, appearances, and the rounded share in percent."""
    total = stats.groupBy("version").agg(F.sum("votes").alias("votes"), F.sum("appearances").alias("appearances"))
    seen = F.greatest("appearances", "votes")
    return versions.join(total, "version", "left").na.fill(0, ["votes", "appearances"]).select(
        "version", "votes", seen.alias("appearances"), F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("votes"), seen)), F.lit(0.0)).cast("int").alias("rate"))


def usable(options: Column) -> Column:
    """The options that are aligned."""
    return F.filter(options, lambda o: o["status"] == "aligned")


def drawn(df: DataFrame, seed: str, most: int, *by: str, key: str) -> DataFrame:
    """A sample without replacement, by group if asked; the same for the same seed.

    The order is that of a hash of seed and key, so any engine can draw the same rows.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    if not by:
        return df.orderBy(order, key).limit(most)
    w = Window.partitionBy(*by).orderBy(order, key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
