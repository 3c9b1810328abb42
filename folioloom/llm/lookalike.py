"""One consistent form for blocks that look the same but are stored in different characters.

Method: script-aware repair.  Characters are first brought to one code (width, composition,
invisible characters, blanks, hyphens, name dots, ideographs of the same look, letters of
mathematical alphabets).  Then tokens that mix scripts are rewritten in their dominant script
(or else in another one they hold, or in that of their block), if all foreign letters have a
look-alike there and the rewritten token occurs in the vocabulary of the corpus, which has the
words of every script.  At the end traditional characters become simplified ones where the
version asks for it.

A token made up only of look-alike letters of one script (a single Cyrillic letter, for
instance) has no dominant script of its own.  It takes that of its block, unless the block
really uses the token's script, having a letter of it that looks like none of the other's.

Defined results: a null block has a null form and appears in no pair; an empty block and a
block of blanks keep that form; repeated rows of `text_documents` count once; a null
`normalization`, or a version without a row in `versions`, means no conversion.  Forms and
stored characters are compared by digests of 128 bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, once, table

# Latin letters and the Cyrillic and Greek letters of the same look.
CYRILLIC_AS_LATIN = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԌԚԜһаеорсухѕіјԁԛԝӏѵ",
    "ABESIJKMHOPCTYXYGQWhaeopcyxsijdqwlv"))
GREEK_AS_LATIN = dict(zip(
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿνορυχικαϲϳ",
    "ABEZHIKMNOPTYXCJvopuxikacj"))
# Radicals that have a code of their own beside the ideograph of the same look.
RADICALS = dict(zip(
    "⺁⺈⺌⺕⺟⺠⺩⺪⺬⺮⺯⺶⺷⺼⻁⻄⻅⻆⻈⻉⻋⻌⻓⻔⻗⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
    "厂刀小彐母民王疋示竹糸羊羊月虎西见角讠贝车辶长门雨青韦页风飞食马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟"))
# Hyphens and name dots of the same look.
HYPHENS = "‐‑⁃˗−﹣－"
NAME_DOTS = "··•‧∙⋅・･"
# Invisible characters that aren't of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"

#: Matches what a stored block may hold without needing any work.
PLAIN = re.compile(r"[\x20-\x7e¡-¬®-¶¸-ɏ—-”…、-〩ぁ-ゖ゠-ヺー-ヿ一-鿿]*")
#: A word of the three scripts with the marks that belong to its letters.
TOKEN = re.compile(r"(?:[A-Za-zÀ-ɏͰ-ϿЀ-ԯ][̀-ͯ]*)+")
#: Words of one script in Java's syntax, for the vocabulary.
JAVA_WORDS = r"(?<![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}])(?:[\p{IsLatin}\p{M}]+|[\p{IsCyrillic}\p{M}]+|[\p{IsGreek}\p{M}]+)(?![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}])"
FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ]")


def one_code(c: str) -> str:
    """The code that stands for all characters of the look of `c`; an accent stays for composition."""
    if c in HYPHENS:
        return "-"
    if c in NAME_DOTS:
        return "·"
    if c in RADICALS:
        return RADICALS[c]
    kind = unicodedata.category(c)
    if kind == "Cf" or c in INVISIBLE or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if kind == "Zs" or c == "\t":
        return " "
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>")):
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 else chr(int(how.split()[1], 16))
    if how.startswith("<font>"):
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isalpha() else c  # a letter of a mathematical alphabet
    if how.startswith("<compat>"):
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain.isalpha() else c  # ligatures and radicals, but no points or fractions
    if how and not how.startswith("<") and " " not in how:
        return unicodedata.normalize("NFC", c)  # one character for another: compatibility ideographs
    return c


class _Codes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = made = one_code(chr(code))
        return made


_CODES = _Codes()


def uniform(text: str) -> str:
    """`text` in one code per look, composed."""
    if PLAIN.fullmatch(text):
        return text
    return unicodedata.normalize("NFC", text.translate(_CODES))


def script(c: str) -> str:
    """Latin, Cyrillic, Greek or other."""
    if "Ͱ" <= c <= "Ͽ":
        return "Greek"
    if "Ѐ" <= c <= "ԯ":
        return "Cyrillic"
    return "Latin" if c.isalpha() and c < "ɐ" else "other"


_TO = {
    ("Cyrillic", "Latin"): CYRILLIC_AS_LATIN,
    ("Greek", "Latin"): GREEK_AS_LATIN,
    ("Latin", "Cyrillic"): {v: k for k, v in reversed(CYRILLIC_AS_LATIN.items())},
    ("Latin", "Greek"): {v: k for k, v in reversed(GREEK_AS_LATIN.items())},
}


def scripts(text: str) -> dict[str, int]:
    """How many letters each script has, most first; Latin wins a tie, as the others look alike with it."""
    count = Counter(s for c in unicodedata.normalize("NFD", text) if (s := script(c)) != "other")
    return dict(sorted(count.items(), key=lambda x: (-x[1], x[0] != "Latin", x[0])))


def written_in(token: str, target: str) -> str | None:
    """The token with its look-alikes in one script, or None if a letter has none there."""
    out = []
    for c in unicodedata.normalize("NFD", token):  # an accent keeps no letter from being replaced
        s = script(c)
        made = c if s in ("other", target) else _TO.get((s, target), {}).get(c)
        if made is None:
            return None
        out.append(made)
    return unicodedata.normalize("NFC", "".join(out))


def candidates(token: str, block: str) -> list[str]:
    """The token in other scripts, the likeliest first: see the module's docstring."""
    own, around = list(scripts(token)), scripts(block)
    if len(own) > 1:
        targets = own + list(around)[:1]
    else:
        targets = [t for t in list(around)[:1] if t not in own and not really_used(block, own[0], t)] if own else []
    found = [written_in(token, t) for t in dict.fromkeys(targets)]
    return [made for made in dict.fromkeys(found) if made and made != token]


def really_used(text: str, used: str, beside: str) -> bool:
    """Whether a text has letters of a script that look like none of another's."""
    return any(script(c) == used and c not in _TO.get((used, beside), {}) for c in unicodedata.normalize("NFD", text))


def suspects(text: str) -> list[tuple[str, str, int]]:
    """(token, candidate, its rank) for the tokens of a uniform text that may hold look-alikes."""
    if not FOREIGN.search(text):
        return []
    tokens = dict.fromkeys(m.group() for m in TOKEN.finditer(text) if FOREIGN.search(m.group()) or len(scripts(m.group())) > 1)
    return [(token, made, k) for token in tokens for k, made in enumerate(candidates(token, text))]


def repaired(text: str, known: dict[str, str]) -> str:
    return TOKEN.sub(lambda m: known.get(m.group(), m.group()), text)


def normalise_blocks(blocks: DataFrame) -> DataFrame:
    """Adds `form` to blocks of (textdoc_id, block, raw, to_simplified), without simplification."""

    def first(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            b["form"] = [uniform(x) if x is not None else None for x in b["raw"]]
            b["suspects"] = [[{"token": t, "made": m, "rank": k} for t, m, k in suspects(x)] if x else [] for x in b["form"]]
            yield b

    ddl = "textdoc_id bigint, block int, raw string, to_simplified boolean, form string, suspects array<struct<token:string, made:string, rank:int>>"
    base = cut_lineage(blocks.mapInPandas(first, ddl))  # read several times below
    odd = base.where(F.size("suspects") > 0)
    asked = odd.select(F.explode("suspects").alias("s")).select(F.lower("s.made").alias("word")).distinct()
    words = F.expr(f"regexp_extract_all(form, '{JAVA_WORDS.replace(chr(92), chr(92) * 2)}', 0)")
    vocabulary = base.select(F.explode(words).alias("word")).select(F.lower("word").alias("word")).join(asked, "word", "left_semi").distinct()
    # One block may write a token otherwise than another does: the choice is made in each block.
    known = (
        odd.select("textdoc_id", "block", F.explode("suspects").alias("s")).select("textdoc_id", "block", "s.*").distinct()
        .withColumn("word", F.lower("made")).join(vocabulary, "word")
        .groupBy("textdoc_id", "block", "token").agg(F.min(F.struct("rank", "made")).alias("best"))
        .groupBy("textdoc_id", "block").agg(F.collect_list(F.struct("token", "best.made")).alias("known"))
    )

    def second(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            b["form"] = [
                unicodedata.normalize("NFC", repaired(x, {k["token"]: k["made"] for k in ks})) if ks is not None and len(ks) else x
                for x, ks in zip(b["form"], b["known"])
            ]
            yield b[["textdoc_id", "block", "raw", "to_simplified", "form"]]

    mended = odd.drop("suspects").join(known, ["textdoc_id", "block"], "left").mapInPandas(second, "textdoc_id bigint, block int, raw string, to_simplified boolean, form string")
    return base.where(F.size("suspects") == 0).drop("suspects").unionByName(mended)


def simplified(form, script_map: DataFrame):
    """`form` with every traditional character replaced; the map has one row per character."""
    rows = bounded_rows(script_map.where("trad is not null and simp is not null").dropDuplicates(["trad"]), 200_000, "script_map")
    trad, simp = "".join(r.trad for r in rows), "".join(r.simp for r in rows)
    return F.translate(form, trad, simp) if trad else form


def canonical_blocks(documents: DataFrame, versions: DataFrame, script_map: DataFrame, repeated: bool = False) -> DataFrame:
    """(textdoc_id, block, raw, form) for every block; `form` is equal for blocks that read the same.

    With `repeated`, rows that were delivered again come again: no text moves to tell them.
    """
    flags = versions.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("version_id")).agg(
        F.max(F.coalesce(F.col("normalization.traditional_to_simplified"), F.lit(False))).alias("to_simplified")
    )
    own = documents.select("textdoc_id", "version_id", "blocks").where("textdoc_id is not null")
    blocks = (
        (own if repeated else once(own, "textdoc_id"))
        .join(flags, "version_id", "left")
        .select("textdoc_id", F.coalesce("to_simplified", F.lit(False)).alias("to_simplified"), F.posexplode("blocks").alias("block", "raw"))
        .select("textdoc_id", "block", "raw", "to_simplified")
    )
    made = normalise_blocks(blocks)
    return made.withColumn(
        "form", F.when(F.col("to_simplified"), simplified(F.col("form"), script_map)).otherwise(F.col("form"))
    ).drop("to_simplified")


def same_reading_pairs(canonical: DataFrame) -> DataFrame:
    """Pairs of blocks with one form and different stored characters.

    The ways of storing a form are paired first, and only then the blocks stored so: copies of
    the same bytes never meet each other, however many there are.  Only digests move.
    """
    digest = lambda c: F.unhex(F.md5(c))
    forms = cut_lineage(canonical.where(F.col("raw").isNotNull()).select(
        digest("form").alias("form"), digest("raw").alias("way"), "textdoc_id", "block")).dropDuplicates(["textdoc_id", "block"])
    varied = forms.groupBy("form").agg(F.min("way").alias("lo"), F.max("way").alias("hi")).where("lo <> hi").select("form")
    hit = cut_lineage(forms.join(varied, "form", "left_semi").withColumn("at", F.struct("textdoc_id", "block")).drop("textdoc_id", "block"))
    ways = hit.select("form", "way").distinct()
    pairs = ways.withColumnRenamed("way", "way_a").join(ways.withColumnRenamed("way", "way_b"), "form").where("way_a < way_b")
    a = hit.select("form", F.col("way").alias("way_a"), F.col("at").alias("a"))
    b = hit.select("form", F.col("way").alias("way_b"), F.col("at").alias("b"))
    both = pairs.join(a, ["form", "way_a"]).join(b, ["form", "way_b"])
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return both.select(
        lo["textdoc_id"].alias("textdoc_a"), lo["block"].alias("block_a"), hi["textdoc_id"].alias("textdoc_b"), hi["block"].alias("block_b"))


def _canonical(spark: SparkSession, sf_dir: str, repeated: bool) -> DataFrame:
    return canonical_blocks(table(spark, sf_dir, "text_documents"), table(spark, sf_dir, "versions"), table(spark, sf_dir, "script_map"), repeated)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_reading_pairs(_canonical(spark, sf_dir, True))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its consistent form."""
    return _canonical(spark, sf_dir, False)


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
ORACLE: dict[str, str] = {}
