"""Normalisation of text, as expressions on columns.

All of it stays in the JVM; only entities are decoded in Python, and only where a text has an
ampersand.  A null text gives null throughout.
"""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's \s is ASCII only; (?U) makes it Unicode's, as the semantics ask.
SPACES = r"(?U)\s+"
HAN = "㐀-鿿"

# Words in which 著 is not the particle.
ZHU_WORDS = ("著名", "著作", "著书", "著述", "执著", "名著", "巨著", "土著", "原著")
# Marks brought to one form.
MARKS_FROM, MARKS_TO = "「」『』．", "“”“”·"
# Numerals of chapter headings.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def squeeze(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), "^ | $", "")


@F.pandas_udf(T.StringType())  # a type, as a worker has no session to parse a name
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references decoded; texts without an ampersand don't leave the JVM."""
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)


def from_markup(text: Column, drop: Sequence[str] = ()) -> Column:
    """References decoded, placeholders dropped, blanks squeezed."""
    out = unescape(text)
    for x in drop:
        out = F.replace(out, F.lit(x))
    return squeeze(out)


def keep_lines(text: Column) -> Column:
    """Blanks squeezed within lines, and empty lines dropped."""
    out = F.regexp_replace(F.translate(text, "\u00a0", " "), "[ \t\r\f\u000b]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n+", "\n"), r"(?U)^\s+|\s+$", "")


def visible(text: Column) -> Column:
    """One form of quotes and name dots; line breaks between ideographs fall away."""
    out = F.translate(F.translate(F.replace(text, F.lit("\u200b")), "\u00a0\u3000", "  "), MARKS_FROM, MARKS_TO)
    out = F.regexp_replace(out, f"(?<=[{HAN}])\n+(?=[{HAN}])", "")
    out = F.regexp_replace(F.regexp_replace(out, "\n+", " "), "[ \t\r\f\u000b]+", " ")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def tidy_punctuation(text: Column) -> Column:
    """No blank before a mark or after an opening quote."""
    out = F.regexp_replace(text, r"(?U)\s+([,.;:!?”’])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)([“‘])\s+", "$1"), r"(?U)^\s+|\s+$", "")


def match_key(text: Column) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(squeeze(text)), "(?U)[^\\p{L}\\p{M}\\p{N}_]+", "")


def comparable(text: Column, common: str = "") -> Column:
    """Ideographs, Latin letters and digits, without the characters in `common`."""
    out = F.regexp_replace(text, f"[^{HAN}A-Za-z0-9]+", "")
    return F.translate(out, common, "") if common else out


def replace_characters(text: Column, pairs: Mapping[str, str]) -> Column:
    """One character for another, by a table given as a parameter."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def replace_names(text: Column, names: Sequence[tuple[str, str]]) -> Column:
    """Variants become canonical names, the longest first; (variant, canonical) in order."""
    out = text
    for variant, canonical in sorted(names, key=lambda p: -len(p[0])):
        if variant and variant != canonical:
            out = F.replace(out, F.lit(variant), F.lit(canonical))
    return out


def join_names(text: Column, parts: Sequence[tuple[str, str]], marks: str = "，,、。.") -> Column:
    """Two parts of a name torn apart by a mark are joined by a name dot."""
    out = text
    for a, b in parts:
        out = F.regexp_replace(out, f"{a}[{marks}](?U:\\s*){b}", f"{a}·{b}")
    return out


def regional(text: Column) -> Column:
    """妳 and the particle 著 in their usual form; words that hold 著 stay."""
    # Words are taken out in their order, so of two that overlap the first one counts.
    out = text
    for k, w in enumerate(ZHU_WORDS):
        out = F.replace(out, F.lit(w), F.lit(chr(0xE000 + k)))
    out = F.translate(out, "妳著", "你着")
    for k, w in enumerate(ZHU_WORDS):
        out = F.replace(out, F.lit(chr(0xE000 + k)), F.lit(w))
    return out


def repair_pages(text: Column, watermarks: Sequence[str] = ()) -> Column:
    """Blanks between ideographs, watermarks and circled notes of printed pages."""
    out = F.regexp_replace(text, f"(?U)(?<=[{HAN}])\\s+(?=[{HAN}])", "")
    for x in watermarks:
        out = F.replace(out, F.lit(x))
    out = F.regexp_replace(out, "[①-⑩][^。\n]{0,90}。", "")
    return F.regexp_replace(out, f"(?U)第\\s*([{''.join(NUMERALS)}百0-9]+)\\s*章", "第$1章")


def chinese_number(raw: Column) -> Column:
    """0 to 99 by 十; null for anything else."""
    digit = F.create_map(*[x for k, v in NUMERALS.items() for x in (F.lit(k), F.lit(v))])
    left, right = F.substring_index(raw, "十", 1), F.regexp_replace(raw, "^[^十]*十", "")
    tens = F.when(left == "", F.lit(1)).otherwise(digit[left])
    ones = F.when(right == "", F.lit(0)).otherwise(digit[right])
    return F.when(F.length(raw) == 1, digit[raw]).when(raw.contains("十"), tens * 10 + ones)


def chapter_number(text: Column) -> Column:
    """The number of a heading, in digits or numerals."""
    raw = F.regexp_extract(F.regexp_replace(keep_lines(text), SPACES, ""), f"^第([{''.join(NUMERALS)}百0-9]+)章$", 1)
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).when(raw != "", chinese_number(raw))


def title_of(blocks: Column, path: Column) -> Column:
    """The first of five blocks with at most 80 characters, else the file's name."""
    short = F.filter(F.slice(blocks, 1, 5), lambda b: F.length(b) <= 80)
    return F.coalesce(F.try_element_at(short, F.lit(1)), F.substring_index(path, "/", -1))


def chapter_of(blocks: Column, path: Column) -> Column:
    """The number told by the first three blocks, else by the path."""
    def told(b: Column) -> Column:
        return F.coalesce(chapter_number(b), F.when(b.rlike("^[0-9]+$"), b.try_cast("int")))

    numbers = F.filter(F.transform(F.slice(blocks, 1, 3), told), lambda n: n.isNotNull() & (n != 0))
    from_path = F.regexp_extract(F.lower(path), r"chapter[_-]?([0-9]{1,2})(?:\.x?html?$)", 1)
    return F.coalesce(F.try_element_at(numbers, F.lit(1)), from_path.try_cast("int"))


def parse_range(value: Column) -> Column:
    """N17: "start-end" as a struct of two integers."""
    return F.struct(F.split(value, "-", 2)[0].try_cast("int").alias("start"), F.try_element_at(F.split(value, "-", 2), F.lit(2)).try_cast("int").alias("end"))


def question_id(chapter: Column, rank: Column) -> Column:
    """N18."""
    return F.format_string("ch%02d-%03d", chapter, rank)


def escape_html(text: Column, apostrophe: bool = False) -> Column:
    """The ampersand comes first."""
    out = F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#39;")) if apostrophe else out


def quote_style(text: Column) -> Column:
    """Inner quotes become white corner brackets, the whole stands in corner brackets."""
    return F.concat(F.lit("「"), F.translate(F.trim(text), "“”", "『』"), F.lit("」"))


def percent_encoded(text: Column) -> Column:
    """As browsers encode a component; a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


# --- predicates --------------------------------------------------------------------------


def is_furniture(text: Column) -> Column:
    """what a book prints around its text: headings, contents, the end, lone marks."""
    return (
        (text == "") | text.rlike(r"(?i)^Chapter\s+\d+$") | text.isin("Table of Contents", "Contents") | text.rlike(r"(?i)^THE\s+END\.?$")
        | text.rlike(r"^第\s*\d+\s*章$") | ((F.length(text) <= 2) & ~text.rlike("[一-鿿A-Za-z]"))
    )


def is_prose(text: Column) -> Column:
    """at least two characters, and no heading."""
    return (F.length(text) >= 2) & ~text.rlike(r"(?i)^(Cap[ií]tulo|Chapter)\s+\d+$") & ~text.rlike(r"^(第\s*)?\d+\s*章$")


def is_page_noise(text: Column) -> Column:
    """page numbers, dates and roman numerals of a printed page."""
    return text.rlike(r"^(\d{1,4}|20\d{6}|[IVXLCDM]{1,8})$")


#: Names of documents within archives, in lower case.
MARKUP_FILE = r"\.(html|xhtml|htm)$"


def is_markup_file(name: Column) -> Column:
    """F6."""
    return F.lower(name).rlike(MARKUP_FILE)
