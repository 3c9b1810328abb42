"""The language of every document and of every stretch in one language, with a confidence.

Method: multilingual mixture inference.  Likelihoods of hashed character n-grams are
estimated over all documents, first under the stated labels, then again under the languages
found sentence by sentence, which drops the wrong labels.  Each document is a mixture of
languages: expectation-maximisation finds its proportions from the likelihoods of its
sentences, and languages join its set as long as the likelihood grows by more than a penalty.

`und` stands beside the languages for text that none of them explains: its n-grams are all
equally likely, so what is written in letters that the corpus hardly has belongs to it.  A
language that shares script and n-grams with one of the five is taken for the nearest.

What stands in brackets doesn't count, nor do headings, cries and separators, unless a text
has nothing else: it gets the language of those then, with `sentences` 0.  A text without any
letter, and a null, empty or blank one, has no stretches, and no language with confidence 0.
The tables of counts have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import sentences
from folioloom.llm.common import cut_lineage, table

LANGUAGES = ("en", "zh", "es", "ja", "pt")
#: What the languages leave unexplained.
OTHER = "und"
# Codes and English names of the languages.
NAMES = {
    "en": ("en", "eng", "english"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese"),
    "es": ("es", "spa", "spanish"),
    "ja": ("ja", "jpn", "japanese"),
    "pt": ("pt", "por", "portuguese"),
}
_CODE = {name: code for code, names in NAMES.items() for name in names}

ONES, THREES = 1 << 13, 1 << 15
TABLE = ONES + THREES
#: The likelihood of an n-gram counts this much, as n-grams of one sentence depend on each other.
TEMPER = 0.3
#: What a further language must add to a document's log-likelihood, beside half the log of its n-grams.
PENALTY = 3.0
#: Log-probability of an n-gram of `OTHER`, for both orders.
EVEN = -float(np.log(ONES) + np.log(THREES))
#: Characters whose n-grams are in memory at once.
STRETCH = 1 << 19

BRACKET = re.compile(r"[（(\[【][^（(\[【）)\]】]*[）)\]】]")
HEADING = re.compile(r"\W*(?:(?:chapter|cap[ií]tulo|cap\.?|part[e]?)\s+[\divxlc]+|第\s*[\d〇零一二三四五六七八九十百]+\s*[章节節回部])\W*", re.I)
IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿\U00020000-\U0003ffff]")
_DIGITS = re.compile(r"\d+")


def stated(label: str | None) -> str | None:
    """The language that a label names, or None."""
    if label is None:
        return None
    return _CODE.get(re.split(r"[-_\s]", label.strip().lower(), maxsplit=1)[0])


def letters(unit: str) -> int:
    """How many different letters a unit has."""
    return sum(c.isalnum() and not c.isdecimal() for c in set(unit.lower()))


def is_sentence(unit: str) -> bool:
    """Whether a unit says something: no heading, separator, cry or single word."""
    if HEADING.fullmatch(unit):
        return False
    if IDEOGRAPH.search(unit):
        return letters(unit) >= 4
    return letters(unit) >= 5 and len(unit.split()) >= 3


def plain(unit: str) -> str:
    return _DIGITS.sub("0", BRACKET.sub("", unit).lower())


def grams(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slots of the n-grams of units, (2, n), where each unit's begin, and which unit it is.

    A bounded number of characters at a time: a longer unit comes in parts, which see the
    characters beside them, so that no n-gram is lost.
    """
    some: list[tuple[int, str, int, int]] = []  # unit, text, and how much of it is seen but not counted
    size = 0
    for i, u in enumerate(units):
        u = "\x01" + u + "\x01"  # the last mark counts, the first is only seen
        for k in range(1, max(len(u), 2), STRETCH):
            part = u[k - 1 : k + STRETCH + 1]
            if some and size + len(part) > STRETCH:
                yield _slots(some)
                some, size = [], 0
            some.append((i, part, 1, int(k + STRETCH < len(u))))
            size += len(part)
    if some:
        yield _slots(some)


def _slots(parts: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(t for _, t, _, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(t) for _, t, _, _ in parts])
    ends = np.cumsum(n)
    own = np.ones(len(c), bool)
    own[ends - n] = False
    own[(ends - 1)[np.array([bool(z) for *_, z in parts])]] = False
    at = np.flatnonzero(own)
    here, before, after = c[at], c[at - 1], c[np.minimum(at + 1, len(c) - 1)]
    after = np.where(np.isin(at, ends - 1, assume_unique=True), np.uint64(1), after)
    one = (here * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(ONES)
    mix = before * np.uint64(0x85EBCA77) + here * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    three = (mix ^ (mix >> np.uint64(29))) % np.uint64(THREES) + np.uint64(ONES)
    return np.stack([one, three]).astype(np.int64), np.searchsorted(at, ends - n), np.array([i for i, *_ in parts])


def log_table(counts: np.ndarray) -> np.ndarray:
    """(TABLE, languages) of log-probabilities; each order sums to one.  What has no text explains none."""
    out = np.zeros((TABLE, len(LANGUAGES)), np.float32)
    for a, b in ((0, ONES), (ONES, TABLE)):
        n = counts[:, a:b] + 0.05
        out[a:b] = np.log(n / n.sum(1, keepdims=True)).T
    out[:, counts.sum(1) == 0] = 4 * EVEN
    return out


def unit_scores(units: list[str], logs: np.ndarray) -> np.ndarray:
    """(units, languages and `OTHER`): tempered log-likelihoods."""
    out = np.zeros((len(units), len(LANGUAGES) + 1))
    for slots, first, which in grams([plain(u) for u in units]):
        each = logs.take(slots[0], axis=0)
        each += logs.take(slots[1], axis=0)
        np.add.at(out[:, :-1], which, np.add.reduceat(each, first, axis=0, dtype=np.float64))
        np.add.at(out[:, -1], which, EVEN * np.diff([*first, slots.shape[1]]))
    return out * (TEMPER / 2)


_SPLITTER = None


def split(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Units by the priors of the sentence model alone: a language changes between sentences."""
    global _SPLITTER
    if _SPLITTER is None:
        _SPLITTER = sentences.fit(np.zeros(sentences.TABLE, np.int64))
    return sentences.split_many(texts, _SPLITTER)


@dataclass
class Mixture:
    languages: list[int]
    shares: np.ndarray
    posterior: np.ndarray  # (units, languages and `OTHER`)


def mixture(ll: np.ndarray, n_grams: int, rounds: int = 20) -> Mixture:
    """The set of languages of one document, their shares, and each unit's posterior."""

    def em(chosen: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        part = ll[:, chosen]
        top = part.max(1, keepdims=True)
        like = np.exp(part - top)
        pi = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds if len(chosen) > 1 else 1):
            post = like * pi
            post /= post.sum(1, keepdims=True)
            pi = (post.sum(0) + 1e-3) / (len(ll) + 1e-3 * len(chosen))
        return float((np.log((like * pi).sum(1)) + top[:, 0]).sum()), pi, like * pi / (like * pi).sum(1, keepdims=True)

    chosen = [int(ll.sum(0).argmax())]
    best, pi, post = em(chosen)
    cost = PENALTY + 0.5 * np.log(max(n_grams, 2)) * TEMPER
    left = set(np.unique(ll.argmax(1)).tolist()) - set(chosen)
    while left:
        tried = {i: em([*chosen, i]) for i in left}
        i = max(tried, key=lambda k: tried[k][0])
        if tried[i][0] - best <= cost:
            break
        chosen.append(i)
        best, pi, post = tried[i]
        left.discard(i)
    full = np.zeros(ll.shape)
    full[:, chosen] = post
    return Mixture(chosen, pi, full)


SPLIT = "doc_id bigint, text string, lang string, spans array<int>, whole boolean"


def divided(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang, spans, whole): each text with its sentences, or with all that has letters if it has none."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            spans, whole = [], []
            for t, u in zip(b["text"], split(list(b["text"]))):
                own = [(s, e) for s, e in u if is_sentence(t[s:e])]
                whole.append(bool(own))
                spans.append([x for span in own or [(s, e) for s, e in u if letters(t[s:e])] for x in span])
            yield b.assign(spans=spans, whole=whole)

    return documents.select("doc_id", "text", "lang").mapInPandas(run, SPLIT)


def units_of(text: str | None, spans) -> list[str]:
    return [text[s:e] for s, e in zip(spans[::2], spans[1::2])]


def count_grams(texts: DataFrame, logs: np.ndarray | None) -> np.ndarray:
    """Counts by language over all texts of `divided`: by label if there is no model yet, else by unit."""
    shared = texts.sparkSession.sparkContext.broadcast(logs)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs_ = shared.value
        total = np.zeros(len(LANGUAGES) * TABLE, np.int64)
        for b in rows:
            if logs_ is None:
                known = [(t, stated(x)) for t, x in zip(b["text"], b["lang"])]
                known = [(t, LANGUAGES.index(x)) for t, x in known if t and x]
                units, label = [t for t, _ in known], np.array([i for _, i in known], np.int64)
            else:
                units = [u for t, s, w in zip(b["text"], b["spans"], b["whole"]) if w for u in units_of(t, s)]
                label = unit_scores(units, logs_).argmax(1)
                units = [u for u, i in zip(units, label.tolist()) if i < len(LANGUAGES)]
                label = label[label < len(LANGUAGES)]
            for slots, first, which in grams([plain(u) for u in units]):
                base = np.repeat(label[which] * TABLE, np.diff([*first, slots.shape[1]]))
                for one in slots:
                    total += np.bincount(base + one, minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    columns = ("text", "lang") if logs is None else ("text", "spans", "whole")
    rows = texts.select(*columns).mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(LANGUAGES) * TABLE)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"]
    return out.reshape(len(LANGUAGES), TABLE)


def trained(texts: DataFrame, passes: int = 1) -> np.ndarray:
    logs = log_table(count_grams(texts, None))
    for _ in range(passes):
        logs = log_table(count_grams(texts, logs))
    return logs


def _inferred(b: pd.DataFrame, logs: np.ndarray) -> Iterator[tuple]:
    """(doc_id, label, whole, spans, mixture or None) of the texts of a batch."""
    every = [units_of(t, s) for t, s in zip(b["text"], b["spans"])]
    scores, k = unit_scores([u for units in every for u in units], logs), 0
    codes = [*LANGUAGES, OTHER]
    for doc, label, whole, spans, units in zip(b["doc_id"], b["lang"], b["whole"], b["spans"], every):
        ll, k = scores[k : k + len(units)], k + len(units)
        m = mixture(ll, sum(map(len, units))) if units else None
        yield doc, label, whole, spans, m, {codes[i]: float(x) for i, x in zip(m.languages, m.shares)} if m else {}


def segments(texts: DataFrame, logs: np.ndarray) -> DataFrame:
    """(doc_id, start_pos, end_pos, lang, sentences, share, confidence) of every stretch in one language.

    `share` is the language's share in the document by the mixture.
    """
    shared = texts.sparkSession.sparkContext.broadcast(logs)
    codes = [*LANGUAGES, OTHER]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for doc, label, whole, spans, m, share in _inferred(b, shared.value):
                if m is None:
                    continue
                which = m.posterior.argmax(1).tolist()
                first = 0
                for i in range(1, len(which) + 1):
                    if i == len(which) or which[i] != which[first]:
                        lang = codes[which[first]]
                        out.append((
                            doc, label, int(spans[2 * first]), int(spans[2 * i - 1]), lang, (i - first) * bool(whole), share[lang],
                            float(m.posterior[first:i, which[first]].mean())))
                        first = i
            yield pd.DataFrame(out, columns=["doc_id", "label", "start_pos", "end_pos", "lang", "sentences", "share", "confidence"])

    return texts.mapInPandas(run, "doc_id bigint, label string, start_pos int, end_pos int, lang string, sentences int, share double, confidence double")


def document_languages(texts: DataFrame, logs: np.ndarray) -> DataFrame:
    """(doc_id, lang, share, confidence, languages): the language with the largest share of every document.

    `confidence` is the posterior of that language, on average over what it has in the document.
    """
    shared = texts.sparkSession.sparkContext.broadcast(logs)
    codes = [*LANGUAGES, OTHER]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for doc, _, _, _, m, share in _inferred(b, shared.value):
                if m is None:
                    out.append((doc, None, 0.0, 0.0, []))
                    continue
                lang = max(share, key=lambda x: (share[x], x))
                own = m.posterior[:, codes.index(lang)]
                out.append((doc, lang, share[lang], float((own * own).sum() / max(own.sum(), 1e-9)), sorted(share, key=lambda x: -share[x])))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "share", "confidence", "languages"])

    return texts.mapInPandas(run, "doc_id bigint, lang string, share double, confidence double, languages array<string>")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(divided(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))  # read three times


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    named = F.split(F.lower(F.trim("label")), r"[-_\s]")[0]
    code = F.coalesce(*[F.when(named.isin(*names), F.lit(c)) for c, names in NAMES.items()], F.lit(""))
    found = segments(d, trained(d)).where((F.col("sentences") > 0) & (F.col("lang") != OTHER))
    return found.where(code != F.col("lang")).select("doc_id", "lang").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return segments(d, trained(d))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return document_languages(d, trained(d))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}
ORACLE: dict[str, str] = {}
