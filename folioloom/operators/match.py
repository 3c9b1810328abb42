"""Matching of short passages against other texts, and the classes of the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import measures as M
from folioloom.functions import text as N


def spans(rows: DataFrame, keys: list[str], order: str, text: str, most: int, sep: str = "") -> DataFrame:
    """(keys, start, end, text) of 1..most consecutive rows, end exclusive, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = rows.withColumn("start", F.row_number().over(w) - 1).withColumn("_ahead", F.collect_list(text).over(w.rowsBetween(0, most - 1)))
    each = at.select(*keys, "start", "_ahead", F.explode(F.sequence(F.lit(1), F.size("_ahead"))).alias("_k"))
    return each.select(*keys, "start", (F.col("start") + F.col("_k")).alias("end"), F.array_join(F.slice("_ahead", F.lit(1), F.col("_k")), sep).alias("text"))


def best_span(quotes: DataFrame, spans_: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """The span that contains most of a quote; the first of equals.

    `quotes` has (quote_id, keys, quote), `spans_` (keys, start, end, text), both as match keys.
    An empty quote has the span (0, 1) with score 0.  The score includes the penalty for the
    span's length.
    """
    score = M.containment(F.col("quote"), F.col("text")) - (F.col("end") - F.col("start") - 1) * penalty
    asked = quotes.where("quote <> ''").join(spans_, keys).withColumn("score", score)
    best = asked.groupBy("quote_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))).alias("m")).select(
        "quote_id", (-F.col("m.s")).alias("start"), (-F.col("m.e")).alias("end"), F.greatest(F.col("m.score"), F.lit(0.0)).alias("score"))
    empty = quotes.where("quote = ''").select("quote_id", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.0).alias("score"))
    return best.unionByName(empty)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """J15."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def select_by_ratio(sentences: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(window_id, text, idx): the sentences that a window of relative positions covers.

    `sentences` has (keys, idx, text, start_ratio, end_ratio), `windows` (window_id, keys, w_start,
    w_end, most).  The `most` largest overlaps, in order; without any, the nearest sentence.
    """
    joined = windows.join(sentences, keys).withColumn("_o", overlap(F.col("start_ratio"), F.col("end_ratio"), F.col("w_start"), F.col("w_end"))).withColumn(
        "_d", F.abs((F.col("start_ratio") + F.col("end_ratio")) / 2 - (F.col("w_start") + F.col("w_end")) / 2))
    w = Window.partitionBy("window_id")
    ranked = joined.withColumn("_any", F.max("_o").over(w)).withColumn(
        "_n", F.row_number().over(w.orderBy(F.when(F.col("_any") > 0, -F.col("_o")).otherwise(F.col("_d")), "idx")))
    keep = F.when(F.col("_any") > 0, (F.col("_o") > 0) & (F.col("_n") <= F.col("most"))).otherwise(F.col("_n") == 1)
    return ranked.where(keep).groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("s")).select(
        "window_id", F.array_join("s.text", "\n").alias("text"), F.col("s.idx").alias("idx"))


#: Characters of a stretch in which anchors look for sentences.
BAND = 1200


def band_candidates(anchors: DataFrame, sentences: DataFrame, keys: list[str], nearest: int = 12) -> DataFrame:
    """(anchor_id, idx): sentences whose middle is in the anchor's band, else the nearest ones.

    `anchors` has (anchor_id, keys, target, window), `sentences` (keys, idx, start, end).  An
    anchor meets the sentences of the stretches that its band touches.  One without any is put
    among the sentences in order, and meets those on both sides of its place.
    """
    mid = ((F.col("start") + F.col("end")) / 2).alias("_mid")
    own = sentences.select(*keys, "idx", mid)
    reach = F.sequence(F.floor((F.col("target") - F.col("window")) / BAND), F.floor((F.col("target") + F.col("window")) / BAND))
    asked = anchors.select("anchor_id", *keys, "target", "window").withColumn("_band", F.explode(reach))
    hits = asked.join(own.withColumn("_band", F.floor(F.col("_mid") / BAND)), [*keys, "_band"]).where(F.abs(F.col("_mid") - F.col("target")) <= F.col("window")).select("anchor_id", "idx")
    missed = anchors.select("anchor_id", *keys, "target").join(hits.select("anchor_id").distinct(), "anchor_id", "left_anti")
    order = Window.partitionBy(*keys)
    placed = own.withColumn("_r", F.row_number().over(order.orderBy("_mid", "idx")))
    line = placed.select(*keys, F.col("_mid").alias("_p"), F.lit(1).alias("_s"), F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id")).unionByName(
        missed.select(*keys, F.col("target").cast("double").alias("_p"), F.lit(0).alias("_s"), "anchor_id"))
    before = line.withColumn("_b", F.sum("_s").over(order.orderBy("_p").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("_s = 0")
    around = before.select("anchor_id", *keys, F.col("_p").alias("target"), F.explode(F.sequence(F.col("_b") - nearest + 1, F.col("_b") + nearest)).alias("_r"))
    near = around.join(placed.withColumn("_r", F.col("_r").cast("bigint")), [*keys, "_r"]).withColumn("_d", F.abs(F.col("_mid") - F.col("target")))
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("anchor_id").orderBy("_d", "idx"))).where(F.col("_n") <= nearest)
    return hits.unionByName(best.select("anchor_id", "idx"))


def promising(rows: DataFrame, parts: Column, weight: float, most: int) -> DataFrame:
    """The rows that can be among the `most` best of each anchor, with `parts`, the score without the sequence ratio.

    The ratio is dear, so it isn't computed for rows whose score would stay below the
    `most`-th best even with all letters they share in order: a bound, so no row that counts is
    lost.  Rows are few and their scoring is long, so they are spread over all partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounded = rows.repartition(n).withColumn("parts", parts).withColumn("upper", F.col("parts") + weight * M.sequence_part("anchor", "text", M.sequence_bound))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("parts"))
    floor = F.min(F.when(F.col("_r") <= most, F.col("parts"))).over(Window.partitionBy("anchor_id"))
    kept = bounded.withColumn("_r", F.row_number().over(w)).withColumn("_floor", floor).where(F.col("upper") >= F.col("_floor") - 1e-9)
    return kept.drop("_r", "_floor", "upper").repartition(n)


def top_content(anchors: DataFrame, sentences: DataFrame, keys: list[str], most: int = 24) -> DataFrame:
    """D16, step 3: (anchor_id, idx): the sentences most like the anchor over its whole chapter.

    Both sides have their keys (`measures.with_keys`) under the prefixes anchor and text.
    """
    kept = promising(anchors.join(sentences, keys), M.content_parts("anchor", "text"), M.SEQUENCE_WEIGHT, most)
    scored = kept.withColumn("_s", F.col("parts") + M.SEQUENCE_WEIGHT * M.sequence_part("anchor", "text"))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("_s"), "idx")
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("anchor_id", "idx")


def excerpt_windows(candidates: DataFrame, anchors: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(anchor_id, first, last, text, mid): windows of 1..4 sentences around the candidates.

    A window grows as long as its text before the last sentence is within the anchor's limit.
    """
    starts = candidates.join(anchors, "anchor_id").select("anchor_id", *keys, "anchor", F.explode(F.array(F.col("idx") - 2, F.col("idx") - 1, F.col("idx"))).alias("first")).distinct()
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, 3)
    ahead = sentences.select(*keys, F.col("idx").alias("first"), F.collect_list(F.struct("idx", "text", "start", "end")).over(w).alias("a"))
    grown = starts.join(ahead, [*keys, "first"]).select("anchor_id", "anchor", "first", "a", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("k"))
    limit = F.greatest(F.lit(90), F.least(F.lit(280), F.ceil(F.length("anchor") * 2.35)))
    part = F.slice("a", F.lit(1), F.col("k"))
    whole = N.visible(F.array_join(F.transform(part, lambda s: s["text"]), ""))
    # Text only gets longer, so a window is out as soon as one of its starts is too long.
    return grown.withColumn("text", whole).where((F.col("k") == 1) | (F.length(whole) <= limit)).select(
        "anchor_id", "first", (F.col("first") + F.col("k") - 1).alias("last"), "text",
        ((F.col("a")[0]["start"] + F.element_at(part, -1)["end"]) / 2).alias("mid"))


def match_excerpts(anchors: DataFrame, sentences: DataFrame, keys: list[str], common: str = "") -> DataFrame:
    """The best excerpt for each anchor.

    `anchors` has (anchor_id, keys, anchor, target, chars); the result (anchor_id, first, last,
    excerpt, confidence, recall, length_ratio, position_delta).  An anchor whose chapter has no
    sentences has an empty excerpt of confidence 0.
    """
    wide = M.with_keys(anchors.withColumn("window", F.greatest(F.lit(1200.0), F.col("chars") * 0.1)), "anchor", "anchor", common)
    keyed = M.with_keys(sentences, "text", "text", common)
    candidates = band_candidates(wide, sentences, keys).unionByName(top_content(wide, keyed, keys)).distinct()
    windows = M.with_keys(excerpt_windows(candidates, wide, sentences, keys), "text", "text", common).join(wide.drop(*keys), "anchor_id")
    recall = M.keyword_recall(F.col("anchor"), F.col("text"), common)
    lengths = M.length_similarity(F.length("anchor"), F.length("text"))
    place = M.position_score(F.col("mid"), F.col("target"), F.col("window"))
    kept = promising(windows, M.window_score(M.content_parts("anchor", "text"), recall, lengths, place), 0.58 * M.SEQUENCE_WEIGHT, 1)
    scored = kept.withColumn("score", F.col("parts") + 0.58 * M.SEQUENCE_WEIGHT * M.sequence_part("anchor", "text")).withColumn("recall", recall)
    best = scored.groupBy("anchor_id").agg(F.max(F.struct("score", (-F.col("first")).alias("f"), (-F.col("last")).alias("l"), "text", "mid", "recall", "anchor", "target", "chars")).alias("m"))
    m = F.col("m")
    found = best.select(
        "anchor_id", (-m["f"]).alias("first"), (-m["l"]).alias("last"), m["text"].alias("excerpt"),
        M.confidence(m["score"] * M.length_guard(F.length(m["anchor"]), F.length(m["text"]))).alias("confidence"), m["recall"].alias("recall"),
        M.safe_ratio(F.length(m["text"]), F.length(m["anchor"])).alias("length_ratio"), (F.abs(m["mid"] - m["target"]) / F.greatest(m["chars"], F.lit(1))).alias("position_delta"))
    return anchors.select("anchor_id").join(found, "anchor_id", "left").na.fill({"excerpt": "", "confidence": 0.0, "recall": 0.0, "length_ratio": 0.0, "position_delta": 1.0})


def option_warnings(text: Column, confidence: Column, recall: Column, length_ratio: Column, position_delta: Column) -> Column:
    """What is weak about a match; an empty one has that warning alone."""
    tests = (
        ("low_confidence", confidence < 0.28), ("low_keyword_recall", recall < 0.24),
        ("length_ratio_outlier", (length_ratio < 0.36) | (length_ratio > 2.35)), ("position_delta_outlier", position_delta > 0.28))
    return F.when(text == "", F.array(F.lit("empty_match"))).otherwise(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


def option_status(text: Column, confidence: Column, recall: Column, warnings: Column) -> Column:
    """C1."""
    return F.when(text == "", "unusable").when((confidence < 0.18) | (recall < 0.16), "unusable").when(F.size(warnings) > 0, "needs_review").otherwise("aligned")


def question_status(options: DataFrame, question: str, anchor: Column) -> DataFrame:
    """(question, status, min_confidence, warnings) from options (status, text, confidence, warnings, version)."""
    flat = F.when(anchor, F.expr("cast(array() as array<string>)")).otherwise(F.transform("warnings", lambda w: F.concat(w, F.lit(":"), F.col("version"))))
    return options.withColumn("_w", flat).groupBy(question).agg(
        F.count_if(F.col("status") == "aligned").alias("aligned"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("status") != "aligned").alias("other"),
        F.min(F.when(~anchor, F.col("confidence"))).alias("min_confidence"), F.array_sort(F.flatten(F.collect_list("_w"))).alias("warnings"),
    ).select(question, F.when((F.col("aligned") < 3) | (F.col("empty") > 0), "disabled").when((F.col("other") > 0) | (F.size("warnings") > 0), "review").otherwise("ready").alias("status"), "min_confidence", "warnings")


def extended(anchor: Column, center: Column, following: Column) -> Column:
    """A sentence that is short for its anchor takes the one after it; at most 240 characters."""
    room = F.greatest(F.lit(90), F.least(F.lit(220), F.ceil(F.length(anchor) * 1.85)))
    takes = following.isNotNull() & (F.length(center) < F.length(anchor) * 0.75) & (F.length(center) + F.length(following) <= room)
    whole = N.visible(F.when(takes, F.concat(center, following)).otherwise(center))
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, 238), "[，,、；;]+$", ""), F.lit("。"))
    return F.when(F.length(whole) > 240, cut).otherwise(whole)
