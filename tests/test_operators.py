from pyspark.sql import functions as F

from folioloom.operators import facets as O
from folioloom.operators import match as X
from folioloom.operators import ranks
from folioloom.operators import relational as R
from folioloom.operators import votes as V
from tests.conftest import rows


def test_percentile_is_by_place(spark):
    df = spark.createDataFrame([("a", n) for n in range(1, 11)] + [("b", 5)], "k string, n int")
    got = {r.k: r for r in O.length_summary(df, "k", "n").collect()}
    assert (got["a"].p90, got["a"].median, got["a"].max) == (10, 5, 10) and (got["b"].p99, got["b"].n) == (5, 1)
    assert spark.range(1).select(O.value_at(F.expr("sequence(1, 10)"), 0.9).alias("v"), O.value_at(F.expr("cast(array() as array<int>)"), 0.5).alias("e")).first() == (10, 0)


def test_first_and_last_by_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert rows(O.first_per_key(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 1, None)]
    assert rows(O.last_per_key(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 1, None)]


def test_search_is_a_plain_substring(spark):
    df = spark.createDataFrame([("A.b", None), ("axb", "é")], "x string, y string")
    assert df.where(O.search([F.col("x"), F.col("y")], " a.B ")).count() == 1
    assert df.where(O.search([F.col("x")], "  ")).count() == 2


def test_peaks_of_nothing(spark):
    got = spark.range(1).select(*O.peaks(F.expr("array(0L, 0L)"))).first()
    assert (got.total, got.peak, got.first, got.last) == (0, 1, 0, 0)


def test_selection_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, k string")
    assert O.selected(df, F.col("k") == "b", "id", 1, F.col("id")).first().id == 2
    assert O.selected(df, F.col("k") == "z", "id", 9, F.col("id")).first().id == 1


def test_votes(spark):
    a = spark.createDataFrame([("s", 1, "q", "A", ["A", "B"]), ("s", 2, "q", "B", ["A", "B"]), ("t", 1, "q", "A", ["A"])], V.ANSWER)
    stats = V.counters(V.last_answers(a))
    assert rows(stats) == [("q", "A", 1, 2), ("q", "B", 1, 1)]
    rates = V.preference_rates(stats, spark.createDataFrame([("A",), ("B",), ("C",)], "version string"))
    assert rows(rates) == [("A", 1, 2, 50), ("B", 1, 1, 100), ("C", 0, 0, 0)]


def test_ranks_over_one_hot_key(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.lit(999) - F.col("id")).alias("o"))
    got = ranks.placed(df, ["k"], ["o"], "r")
    assert got.where("r <> o + 1").count() == 0 and got.count() == 1000


def test_best_span_and_ties(spark):
    r = spark.createDataFrame([(1, k, t) for k, t in enumerate(["abcd", "efgh", "abcd"])], "c int, k int, t string")
    q = spark.createDataFrame([(1, 1, "abcd"), (2, 1, "cdef"), (3, 1, ""), (4, 1, "zzzz")], "quote_id int, c int, quote string")
    got = {x.quote_id: (x.start, x.end, round(x.score, 3)) for x in X.best_span(q, X.spans(r, ["c"], "k", "t", 3), ["c"], 0.015).collect()}
    assert got == {1: (0, 1, 1.0), 2: (0, 2, 0.985), 3: (0, 1, 0.0), 4: (0, 1, 0.0)}


def test_match_excerpts_of_a_chapter_without_sentences(spark):
    a = spark.createDataFrame([(1, 1, "河水改道了", 10.0, 100), (2, 9, "河水改道了", 10.0, 100)], "anchor_id int, c int, anchor string, target double, chars int")
    s = spark.createDataFrame([(1, 0, "天下雨。", 0, 4), (1, 1, "河水改道了。", 4, 10), (1, 2, "他走了。", 10, 14)], "c int, idx int, text string, start int, end int")
    got = {r.anchor_id: r for r in X.match_excerpts(a, s, ["c"]).collect()}
    assert got[1].excerpt == "河水改道了。" and got[1].recall == 1.0 and got[2].excerpt == "" and got[2].position_delta == 1.0


def test_bound_loses_no_excerpt(spark):
    import random

    from folioloom.functions import measures as M

    rng = random.Random(5)
    texts = ["".join(rng.choices("甲乙丙丁戊己庚辛", k=rng.randint(4, 20))) for _ in range(60)]
    s = M.with_keys(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "c int, idx int, text string"), "text", "text", "甲")
    a = M.with_keys(spark.createDataFrame([(i, 1, texts[i][::-1]) for i in range(5)], "anchor_id int, c int, anchor string"), "anchor", "anchor", "甲")
    got = set(rows(X.top_content(a, s, ["c"], 7)))
    scored = a.join(s, "c").withColumn("v", M.content_similarity("anchor", "text")).collect()
    for i in range(5):
        best = sorted((r for r in scored if r.anchor_id == i), key=lambda r: (-r.v, r.idx))[:7]
        assert {(i, r.idx) for r in best} == {g for g in got if g[0] == i}


def test_interleaving_goes_to_the_longer_end(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"])], "k int, p array<string>, q array<string>")
    assert rows(R.interleaved(df, ["k"], "p", "q"), "place", "side") == [(1, 0, 0, "a"), (1, 0, 1, "x"), (1, 1, 0, "b")]


def test_unequal_sides_are_an_error(spark):
    import pytest

    a, b = spark.createDataFrame([(1, 1), (1, 2)], "k int, o int"), spark.createDataFrame([(1, 1)], "k int, p int")
    with pytest.raises(ValueError):
        R.zipped(a, b, ["k"], "o", "p", check=True)


def test_fallback_rows(spark):
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,)], "v int")
    assert rows(O.with_fallback(a, b, 2)) == [(1,), (2,)] and rows(O.with_fallback(a, b, 1)) == [(1,)]
