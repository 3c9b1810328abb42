import pytest
from pyspark.sql import functions as F

from folioloom.functions import measures as M
from folioloom.functions import segment as S
from folioloom.functions import text as N


def value(spark, make, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v


@pytest.mark.parametrize("make, text, want", [
    (N.squeeze, " a　 b\n c ", "a b c"),
    (N.squeeze, None, None),
    (lambda t: N.from_markup(t, ["[插图]"]), "[插图] &lt;a&gt; &amp;&#65; b", "<a> &A b"),
    (N.keep_lines, " a \t b\n\n\n c ", "a b\n c"),
    (N.visible, "甲\n乙\nb 「丙」．丁​", "甲乙 b “丙”·丁"),
    (N.tidy_punctuation, "a , b “ c ” .", "a, b “c”."),
    (N.match_key, " Ábc, 一二！_ ", "ábc一二_"),
    (lambda t: N.comparable(t, "的"), "我的 Name，是！", "我Name是"),
    (lambda t: N.replace_names(t, [("安", "A"), ("安娜", "B")]), "安娜和安", "B和A"),
    (lambda t: N.join_names(t, [("安娜", "洛佩")]), "安娜。 洛佩来了", "安娜·洛佩来了"),
    (N.regional, "他看著名著，坐著的妳", "他看著名着，坐着的你"),
    (lambda t: N.repair_pages(t, ["水印"]), "第 三 章 水印甲 乙①注一条。丙", "第三章甲乙丙"),
    (N.chapter_number, " 第 二十一 章", 21),
    (N.chapter_number, "第10章", 10),
    (N.chapter_number, "第百章", None),
    (N.chapter_number, "第三回", None),
    (N.escape_html, '<a & "b">', "&lt;a &amp; &quot;b&quot;&gt;"),
    (N.quote_style, " “甲”乙 ", "「『甲』乙」"),
    (N.percent_encoded, "a b/é", "a%20b%2F%C3%A9"),
    (S.east_sentences, "“走吧！”他说。没有句号", ["“走吧！”", "他说。", "没有句号"]),
    (S.east_sentences, "   ", []),
    (S.west_sentences, "One. Two? “Three.” four. Five", ["One.", "Two?", "“Three.” four.", "Five"]),
    (S.western_sentences, "El Sr. Paz vino. ¿Sí? (Claro.) Fin", ["El Sr. Paz vino.", "¿Sí?", "(Claro.)", "Fin"]),
    (lambda t: S.quote_sentences(t, F.lit("en")), "It cost 3.5 pesos. Dr. No left! Bye", ["It cost 3.5 pesos.", "Dr. No left!", "Bye"]),
    (lambda t: S.quote_sentences(t, F.lit("zh")), "真的吗？！走。", ["真的吗？", "！", "走。"]),
    (lambda t: S.slices(t, 2), "甲乙丙", ["甲乙", "丙"]),
    (lambda t: S.slices(t, 2), "", []),
    (lambda t: S.words_packed(t, 5), "aa bb cccccc d", ["aa bb", "cccccc", "d"]),
    (lambda t: S.within(t, "zh", 4, "，"), "甲乙，丙，丁戊己庚辛，", ["甲乙，", "丙，", "丁戊己庚", "辛，"]),
    (lambda t: M.ngrams(t, 2), "aaab", ["aa", "ab"]),
    (lambda t: M.ngrams(t, 4), "ab", ["ab"]),
    (lambda t: M.ngrams(t, 2), "", []),
    (lambda t: M.weight(t, "zh"), "甲乙。a", 2 * 1.85 + 1.5 + 0.25),
    (lambda t: M.weight(t, "en"), "", 1.0),
])
def test_function(spark, make, text, want):
    got = value(spark, make, text)
    got = [x for x in got] if isinstance(want, list) else got
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize("a, b, want", [("abcdef", "xabcdefx", 1.0), ("abcdef", "abc", 0.5), ("", "a", 0.0), ("abcd", "", 0.0), ("abcde", "abcdx", 0.5)])
def test_containment(spark, a, b, want):
    assert value(spark, M.containment, a, b) == want


def test_keyword_recall_of_nothing_is_one(spark):
    assert value(spark, lambda a, b: M.keyword_recall(a, b, ""), "。", "甲") == 1.0
    assert value(spark, lambda a, b: M.keyword_recall(a, b, ""), "甲乙", "甲") == 0.5


def test_sequence_bound_is_a_bound(spark):
    pairs = [("abcabc", "cbacba"), ("一二三四", "二三"), ("", ""), ("a", ""), ("kitten sitting", "sitting kitten")]
    for a, b in pairs:
        assert value(spark, M.sequence_bound, a, b) >= value(spark, M.sequence_ratio, a, b)


def test_spans_cover_the_text(spark):
    text = "第一句。第二句！\n 尾巴"
    spans = value(spark, S.span_sentences, text)
    assert [(s.start, s.end) for s in spans] == [(0, 4), (4, 8), (8, 12)]


def test_long_sentence_parts(spark):
    text = "，".join(["很长的分句" * 6] * 8)
    parts = value(spark, S.sentence_parts, text)
    assert len(parts) > 1 and all(p.endswith("。") for p in parts[:-1]) and all(len(p) <= 141 for p in parts)


def test_length_flags(spark):
    df = spark.createDataFrame([(1000, 200, 200), (100, 100, 100), (950, 950, 10)], "en int, es int, ja int")
    flags = [r.f for r in df.select(M.length_flags(F.col("en"), F.col("es"), F.col("ja")).alias("f")).collect()]
    assert flags == [["western_length_mismatch", "single_language_outlier", "single_western_long_sentence"], [], ["long_western_source_sentence"]]
