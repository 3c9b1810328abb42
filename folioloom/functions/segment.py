"""Sentences and chunks of texts, as expressions on columns where a pattern can tell them.

What needs to look back over what has been cut already runs in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.functions.text import squeeze, visible

CLOSERS_BOOK = "”’」』）)"
EAST_SENTENCE = f".+?[。！？；]+[{CLOSERS_BOOK}]*|.+$"
WEST_BREAK = "(?<=[.!?;])(?U:\\s+)(?=[“\"'‘A-ZÚÉÍÓÁÑ])"
SPAN_SENTENCE = "(?s)[^。！？!?；;]*[。！？!?；;]+[”’」』）】》]*|[^。！？!?；;]+$"

# Words that a point doesn't end.
ABBREVIATIONS = {
    "western": "sr sra srta dr dra ud uds etc",
    "quotes": "mr mrs ms dr st sr jr prof rev fr etc ud uds srta sra",
}
_LAST_WORD = re.compile(r"([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)\s*$")


def east_sentences(text: Column) -> Column:
    """Pieces up to a terminal and its closers, and the tail."""
    pieces = F.regexp_extract_all(squeeze(text), F.lit(EAST_SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def west_sentences(text: Column) -> Column:
    """Cut at blanks after a terminal where a quote or capital follows."""
    return F.filter(F.transform(F.split(squeeze(text), WEST_BREAK), lambda p: F.trim(p)), lambda p: p != "")


def shortened(text: str, dot: int, words: frozenset[str]) -> bool:
    m = _LAST_WORD.search(text[max(0, dot - 40) : dot])
    return bool(m) and (len(m.group(1)) == 1 or m.group(1).lower() in words)


def closed_pieces(text: str, terminals: str, closers: str, words: frozenset[str], anywhere: bool, decimals: bool) -> list[str]:
    """Pieces that end at a terminal with its closers, where a blank or the end follows (or anywhere)."""
    out, start, i = [], 0, 0
    while i < len(text):
        c = text[i]
        i += 1
        if c not in terminals:
            continue
        if c == "." and (shortened(text, i - 1, words) or decimals and text[i - 2 : i - 1].isdigit() and text[i : i + 1].isdigit()):
            continue
        end = i
        while end < len(text) and text[end] in closers:
            end += 1
        if anywhere or end == len(text) or text[end].isspace():
            out.append(text[start:end])
            while end < len(text) and text[end].isspace():
                end += 1
            start = i = end
    out.append(text[start:])
    return [p for p in (" ".join(x.split()) for x in out) if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def western_sentences(text: pd.Series) -> pd.Series:
    """Terminals . ! ? before a blank, but not after an abbreviation."""
    words = frozenset(ABBREVIATIONS["western"].split())
    return text.map(lambda t: [] if t is None else closed_pieces(" ".join(t.split()), ".!?", "”’»\"')）]", words, False, False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def quote_sentences(text: pd.Series, lang: pd.Series) -> pd.Series:
    """T4: by language; a decimal point ends nothing."""
    words = frozenset(ABBREVIATIONS["quotes"].split())
    out = []
    for t, code in zip(text, lang):
        west = code in ("en", "es")
        out.append([] if t is None else closed_pieces(" ".join(t.split()), "。！？!?" + ("." if west else ""), "”’»」』\"')）]", words, code in ("zh", "ja"), True))
    return pd.Series(out)


def span_sentences(text: Column) -> Column:
    """T5: array of (text, start, end), offsets in code points of the text as given."""
    pieces = F.regexp_extract_all(text, F.lit(SPAN_SENTENCE), F.lit(0))
    zero = F.struct(F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        return F.struct(F.concat(acc["out"], F.array(F.struct(piece.alias("text"), acc["at"].alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    spans = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    return F.filter(F.transform(spans, lambda s: F.struct(visible(s["text"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"))), lambda s: s["text"] != "")


def packed(pieces: Column, most: Column | int, sep: str = "") -> Column:
    """Neighbouring pieces joined as long as they stay within `most` characters."""
    most = most if isinstance(most, Column) else F.lit(most)
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.trim(F.when(acc["now"] == "", piece).otherwise(F.concat(acc["now"], F.lit(sep), piece)))
        full = (acc["now"] != "") & (F.length(joined) > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, piece).otherwise(joined).alias("now"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def slices(text: Column, size: int) -> Column:
    """T8, east: fixed stretches."""
    n = F.ceil(F.length(text) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i * size + 1, F.lit(size)))), lambda p: p != "")


def words_packed(text: Column, size: int) -> Column:
    """T8, west: whole words up to the size."""
    return packed(F.filter(F.split(squeeze(text), " "), lambda w: w != ""), size, " ")


def within(text: Column, lang: str, most: int, marks: str) -> Column:
    """A sentence over the limit is cut at clause marks, and what is still over by length."""
    sep = "" if lang in ("zh", "ja") else " "
    by_length = slices if not sep else words_packed
    clauses = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f".+?[{marks}]+|.+$"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    cut = F.flatten(F.transform(packed(clauses, most, sep), lambda c: F.when(F.length(c) > most, by_length(c, most)).otherwise(F.array(c))))
    return F.when(F.length(text) <= most, F.array(text)).when(F.size(clauses) <= 1, by_length(text, most)).otherwise(cut)


def sentence_parts(text: Column, over: int = 180, pack: int = 140) -> Column:
    """A long sentence in parts at commas; all but the last end with a full stop."""
    pieces = F.split(text, "(?<=[，,、：:])")
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(piece) > pack)
        ended = F.concat(F.regexp_replace(acc["now"], "[，,、：:]+$", ""), F.lit("。"))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(ended))).otherwise(acc["done"]).alias("done"), F.when(full, piece).otherwise(F.concat(acc["now"], piece)).alias("now"))

    cut = F.aggregate(pieces, zero, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.expr("cast(array() as array<string>)")).when(F.length(text) <= over, F.array(text)).otherwise(cut)


def soft_limit(total: Column, target: Column, floor: int) -> Column:
    """The length at which a chunk is full."""
    return F.greatest(F.lit(floor), F.ceil(total / target * 1.12)).cast("int")


def balanced_target(paragraphs: list[Column], lengths: list[tuple[Column, int]]) -> Column:
    """Into how many chunks both sides are cut."""
    return F.greatest(F.lit(1), *paragraphs, *[F.ceil(n / each).cast("int") for n, each in lengths])
