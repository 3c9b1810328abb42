"""Weights and similarities of texts, as expressions on columns."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.functions.text import comparable

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[’'][A-Za-zÀ-ÖØ-öø-ÿ]+)?"
HAN, HAN_KANA = "[一-鿿]", "[一-鿿ぁ-ゟ゠-ヿ]"
EAST_MARKS, BOOK_MARKS, WEST_MARKS = "[。！？；、，,.!?;:]", "[。！？；：，、,.!?;:]", "[.!?;:]"

# Weight of a character or word by profile and language.
PROFILES = {
    "book": {"zh": (HAN, 1.85, BOOK_MARKS), "en": (WORD, 5.25, WEST_MARKS)},
    "quotes": {"zh": (HAN_KANA, 1.8, EAST_MARKS), "ja": (HAN_KANA, 1.65, EAST_MARKS), "en": (WORD, 5.2, WEST_MARKS), "es": (WORD, 5.2, WEST_MARKS)},
    "spanish": {"zh": (HAN, 1.8, EAST_MARKS), "en": (WORD, 5.25, WEST_MARKS), "es": (WORD, 5.2, WEST_MARKS)},
    "japanese": {"zh": (HAN_KANA, 1.8, EAST_MARKS), "ja": (HAN_KANA, 1.65, EAST_MARKS)},
}


def weight(text: Column, lang: str, profile: str = "book") -> Column:
    """M1: what a text weighs in an alignment; at least 1."""
    unit, each, marks = PROFILES[profile][lang]
    total = F.regexp_count(text, F.lit(unit)) * F.lit(each) + F.regexp_count(text, F.lit(marks)) * F.lit(0.25 if lang in ("zh", "ja") else 0.35)
    if profile == "book" and lang == "zh":
        total = F.regexp_count(text, F.lit(unit)) * F.lit(each) + F.regexp_count(text, F.lit("[A-Za-z]+")) * F.lit(1.5) + F.regexp_count(text, F.lit(marks)) * F.lit(0.25)
    return F.greatest(F.lit(1.0), total)


def ngrams(text: Column, size: int = 2) -> Column:
    """The set of n-grams; a shorter text is its own, an empty one has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))))


def jaccard(a: Column, b: Column) -> Column:
    """M4 of two sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(needle: Column, hay: Column) -> Column:
    """M3: how much of the needle the hay holds."""
    grams = ngrams(needle, 4)
    hits = F.size(F.filter(grams, lambda g: F.instr(hay, g) > 0))
    return (
        F.when((F.coalesce(needle, F.lit("")) == "") | (F.coalesce(hay, F.lit("")) == ""), F.lit(0.0))
        .when(F.instr(hay, needle) > 0, F.lit(1.0))
        .when(F.instr(needle, hay) > 0, F.length(hay) / F.length(needle))
        .otherwise(hits / F.size(grams))
    )


def length_similarity(a: Column, b: Column) -> Column:
    """M6 of two lengths."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(1 - F.abs(a - b) / F.greatest(a, b))


def safe_ratio(a: Column, b: Column) -> Column:
    """M20."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def characters(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def distinctive(text: Column, common: str) -> Column:
    """M8: the characters that aren't common, if there are eight; else all."""
    every = characters(comparable(text))
    rare = F.filter(every, lambda c: F.instr(F.lit(common), c) == 0)
    return F.when(F.size(rare) >= 8, rare).otherwise(every)


def keyword_recall(anchor: Column, candidate: Column, common: str) -> Column:
    """M8: the share of the anchor's distinctive characters found; 1 if it has none."""
    asked = distinctive(anchor, common)
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(asked, characters(comparable(candidate)))) / F.size(asked))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """M5: Ratcliff-Obershelp over the first 180 characters of each."""
    return pd.Series([SequenceMatcher(None, (x or "")[:180], (y or "")[:180]).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def sequence_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """At least M5, from the letters both have, wherever they stand."""
    out, left = [], {}
    for x, y in zip(a, b):
        x, y = (x or "")[:180], (y or "")[:180]
        if x not in left:
            left = {x: Counter(x)}
        shared = sum((left[x] & Counter(y)).values())
        out.append(2.0 * shared / (len(x) + len(y)) if x or y else 1.0)
    return pd.Series(out)


SEQUENCE_WEIGHT = 0.22


def with_keys(df: DataFrame, text: str, prefix: str, common: str) -> DataFrame:
    """Adds what M7 compares of a text: its key, the key without common characters, the bigrams of both.

    They are columns of their own, so that they are computed once a row: inside the lambda that
    makes n-grams an expression would be computed for each of them.
    """
    keys = df.withColumns({f"{prefix}_key": comparable(F.col(text)), f"{prefix}_rare": comparable(F.col(text), common)})
    return keys.withColumns({f"{prefix}_grams": ngrams(F.col(f"{prefix}_key")), f"{prefix}_rare_grams": ngrams(F.col(f"{prefix}_rare"))})


def content_parts(a: str, b: str) -> Column:
    """M7 without the sequence ratio, over the keys with these prefixes; `b` is the candidate."""
    mix = (
        0.40 * jaccard(F.col(f"{a}_grams"), F.col(f"{b}_grams")) + 0.32 * jaccard(F.col(f"{a}_rare_grams"), F.col(f"{b}_rare_grams"))
        + 0.06 * length_similarity(F.length(f"{a}_key"), F.length(f"{b}_key")))
    return F.when(F.length(f"{b}_key") == 0, F.lit(0.0)).otherwise(mix)


def sequence_part(a: str, b: str, measure=None) -> Column:
    """The sequence ratio over the keys, or another measure of them; 0 for an empty candidate."""
    return F.when(F.length(f"{b}_key") == 0, F.lit(0.0)).otherwise((measure or sequence_ratio)(F.col(f"{a}_key"), F.col(f"{b}_key")))


def content_similarity(a: str, b: str) -> Column:
    """M7, over the keys with these prefixes."""
    return content_parts(a, b) + SEQUENCE_WEIGHT * sequence_part(a, b)


def position_score(mid: Column, target: Column, window: Column) -> Column:
    """M9."""
    return F.greatest(F.lit(0.0), 1 - F.abs(mid - target) / F.greatest(F.lit(1.0), window * 2.2))


def window_score(content: Column, recall: Column, lengths: Column, position: Column) -> Column:
    """M10."""
    return 0.58 * content + 0.20 * recall + 0.12 * lengths + 0.10 * position


def length_guard(anchor_length: Column, length: Column) -> Column:
    """M12."""
    r = safe_ratio(length, anchor_length)
    return F.when(r.between(0.45, 1.9), F.lit(1.0)).when((r < 0.25) | (r > 3.0), F.lit(0.55)).otherwise(F.lit(0.78))


def confidence(score: Column) -> Column:
    """M13, unrounded."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), (score - 0.06) / 0.36))


def anchor_position(row: Column, rows: Column, ratio: Column) -> Column:
    """Where an anchor stands in its chapter, from its row and its range."""
    by_row = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (row - 0.5) / rows))
    return F.when(F.coalesce(row, F.lit(0)) == 0, ratio).when(F.abs(by_row - ratio) > 0.18, 0.72 * by_row + 0.28 * ratio).otherwise(0.45 * by_row + 0.55 * ratio)


def quoted(text: Column) -> Column:
    return text.rlike("^[“\"'‘]") | text.rlike("[”\"'’]$")


def quote_penalty(a: Column, b: Column) -> Column:
    """M17."""
    return F.when(quoted(a) != quoted(b), F.lit(0.04)).otherwise(F.lit(0.0))


def length_flags(en: Column, es: Column, ja: Column) -> Column:
    """What is odd about the lengths of three renderings."""
    mid = F.array_sort(F.array(en, es, ja))[1]
    most, least = F.greatest(en, es, ja), F.least(en, es, ja)
    west = F.greatest(en, es)
    tests = (
        ("western_length_mismatch", (west > 260) & (west / F.greatest(F.lit(1), F.least(en, es)) > 2.5)),
        ("single_language_outlier", (most > 320) & (most / F.greatest(F.lit(1), mid) > 2.8)),
        ("long_western_source_sentence", (en > 900) & (es > 900)),
        ("single_western_long_sentence", (en > 900) != (es > 900)),
        ("japanese_length_outlier", (ja > 350) & (ja / F.greatest(F.lit(1), mid) > 2.8)),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
