"""Sentence units of texts in any language and script, with their positions.

Method: a hidden-event n-gram language model.  Between two tokens an event is hidden: a
sentence boundary or none.  At a mark that may end a sentence the model knows

* P(boundary | left context): the word or mark before the gap, learned from how often it
  stands at the end of a line, where a boundary is certain;
* P(right token | boundary): learned from tokens after certain boundaries;
* P(right token | no boundary, mark): learned by expectation-maximisation from the tokens
  that follow the same mark.

Abbreviations, verbs of reporting and the kinds of marks enter as priors.  In a line without
any mark there is an event between every two tokens (words, or characters of scripts without
blanks), decided by pairs of tokens (`ngrams`): P(end | left) P(right | begin) against
P(right | left).

Forward-backward over the gaps of a line gives each its posterior; neighbouring gaps depend
on each other by the number of tokens between them (two initials don't end two sentences).
Gaps where the rules leave no choice (inside brackets, inside a reported quotation, before a
comma) have no event.  Blanks in scripts that don't write terminal marks (Thai, Lao, Khmer)
are gaps too.  All counts are over all rows; they are hashed into tables of fixed size, so
what the driver collects and broadcasts doesn't grow with the data.

Defined results: null, empty and blank texts have no units; repeated rows count once; a line
without any mark is one unit unless the pairs of its tokens tell of more sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import ngrams
from folioloom.llm.common import once, table

# Abbreviations, by how they behave before a capital.
TITLES = "mr mrs ms dr dra st ste sta sto fr col capt gen lt sgt prof rev hon sr sra srta dña dn cnel cel cap pe exmo vol no núm num nº p pp pág págs pag fig ed eds vs av avda approx dept art"
ENDERS = "etc a.m p.m jr ltd inc ca cía cia"
# Verbs that report speech.
SAY_LATIN = (
    "said says asked answered replied cried shouted whispered murmured muttered exclaimed told added remarked "
    "dijo dice decía preguntó respondió contestó gritó susurró murmuró exclamó añadió "
    "disse diz dizia perguntou respondeu gritou sussurrou murmurou exclamou acrescentou"
)
SAY_CHINESE = "说 說 道 问道 問道 喊 喊道 叫道 答道 回答 叹道 嘆道 低语 低語"
SAY_JAPANESE = ("と", "って")

LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_CLOSE = "”’»」』）)】》〉]›\"'"
MARK = re.compile(rf"(?:[.．。｡!！?？…؟۔।॥]+[{re.escape(_CLOSE)}]*)+|(?<=[฀-໿ក-៿]) +(?=[฀-໿ក-៿])")
QUOTE = re.compile(r"“[^”]*”|«[^»]*»|「[^」]*」|『[^』]*』|\"[^\"]*\"")
BRACKET = re.compile(r"[（(\[［【〔][^（(\[［【〔）)\]］】〕]*[）)\]］】〕]")
CLAUSE = re.compile(r"[^，。！？!?…,；;：:“«「\"\n—]*?(?=[，。！？!?…,；;：:“«「\"\n—]|\.(?:\s|$)|$)")
SAYS_LATIN = re.compile(rf"\b(?:{'|'.join(SAY_LATIN.split())})\b(?! for\b)", re.I)
SAYS_CHINESE = tuple(SAY_CHINESE.split())
RIGHT = re.compile(r"[\s“«「『‘\"'（(¿¡—–-]*")
WORD = re.compile(r"[^\W\d_]+")
#: A word that begins with the same letters three times over is a cry or a rattle: none that goes on with a sentence.
CRY = re.compile(r"([^\W\d_]{1,16}?)\1\1")
#: Any mark that ends something, or sets something apart.
BARE = re.compile(r"[.．。｡!！?？…؟۔।॥,，、;；:：—“”«»「」『』\"（(【\[]")
OPENERS = frozenset("“«「『‘\"'（(¿¡—–-")
STOPS = frozenset(",，、;；:：)）]】·")
HARD = frozenset("。｡！？!?؟۔।॥")
CJK = re.compile(r"[぀-ヿ㐀-鿿\U00020000-\U0003ffff]")

L_SIZE, R_SIZE = 1 << 15, 1 << 13
#: Classes of marks whose right tokens are modelled each on their own.
KINDS = {"dots": 0, "dots_latin": 1, "point_cjk": 2, "initial": 3, "acronym": 4, "word": 5, "hard": 6, "quote": 7, "blank": 8}
_TITLES, _ENDERS = frozenset(TITLES.split()), frozenset(ENDERS.split())


@lru_cache(200_000)
def l_slot(word: str) -> int:
    return crc32(word.lower().encode()) % L_SIZE


@lru_cache(200_000)
def r_slot(token: str) -> int:
    return crc32(token.encode()) % R_SIZE


def right_token(line: str, at: int) -> tuple[int, str]:
    """Slot of the token after the gap, and its case: U, l, d(igit), c(aseless), o(ther), e(nd)."""
    first = line[at]
    k = RIGHT.match(line, at).end() if first in OPENERS else at
    if k >= len(line):
        return 0, "e"
    c = line[k]
    if CJK.match(c):
        two = line[k : k + 2]
        return r_slot("initial" if two[-1] in ".．" else two), "c"
    if c.isdigit():
        return r_slot("0"), "d"
    if m := WORD.match(line, k):
        return r_slot(m.group()), "U" if c.isupper() else "c" if not c.islower() else "o" if CRY.match(line, k) else "l"
    return r_slot(c), "o"


def _skip(line: str, at: int) -> int:
    while at < len(line) and line[at].isspace():
        at += 1
    return at


def reported(line: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether the quotation line[start:end] belongs to words before it, and to a clause after it."""
    b = start
    while b and line[b - 1].isspace():
        b -= 1
    inside = b > 0 and line[b - 1] not in "。！？!?…．." + _CLOSE
    at = _skip(line, end)
    if at == len(line):
        return inside, False
    c = line[at]
    if c in ",，、" or c.islower() and not CRY.match(line, at) or line.startswith(SAY_JAPANESE, at):
        return inside, True
    if c in "—–-":
        at = _skip(line, at + 1)
        if at < len(line) and line[at].islower():
            return inside, True
    if inside:
        return inside, False
    z = CLAUSE.match(line, at).end()
    if z == at or line[z : z + 1] in tuple(":：“«「\""):
        return inside, False
    if CJK.match(line[z - 1]):
        return inside, any(line.endswith(w, at, z) for w in SAYS_CHINESE)
    return inside, bool(SAYS_LATIN.search(line, at, z))


@dataclass
class Gaps:
    """What a line holds: certain boundaries, and events as parallel lists."""

    sure: list[int]
    at: list[int]
    kind: list[int]
    left: list[int]
    prior: list[float]
    right: list[int]
    case: list[str]
    near: list[bool]  # few tokens since the gap before, or since the start of the line


#: A sentence that ends at a doubtful mark has more tokens than this.
FEW = 4
_SOFT = frozenset(("initial", "acronym", "point_cjk"))


def left_word(line: str, at: int) -> str:
    """The word before the point at `at`, with the points inside it: of an acronym its last letters."""
    b = at
    while b and line[b - 1].isalpha():
        b -= 1
    if b == at:
        return ""
    for _ in range(2):  # two letters with points tell as much as more of them
        if b > 1 and line[b - 1] == "." and line[b - 2].isalpha():
            b -= 2
        else:
            break
    return line[b:at]


def gaps(line: str) -> Gaps:
    g = Gaps([], [], [], [], [], [], [], [])
    marks = list(MARK.finditer(line))
    if not marks:
        return g
    brackets = [m.span() for m in BRACKET.finditer(line)] if any(c in line for c in "（([［【〔") else ()
    quotes = [(*m.span(), *reported(line, *m.span())) for m in QUOTE.finditer(line)] if any(c in line for c in "“«「『\"") else ()
    bracket_starts, quote_starts = [b[0] for b in brackets], [q[0] for q in quotes]
    length, last = len(line), -9
    for m in marks:
        s, e = m.span()
        n = e
        while n < length and line[n].isspace():
            n += 1
        if n >= length:
            break  # the end of the line is a boundary anyhow
        c = line[n]
        if c in STOPS:
            continue
        if brackets and (k := bisect_left(bracket_starts, s)) and s < brackets[k - 1][1]:
            s = brackets[k - 1][1]  # what ends the remark ends no sentence, but a mark after it may
            if s >= e:
                continue
        mark = line[s]
        kind = None
        if quotes:
            skip = False
            k = bisect_left(quote_starts, s)
            if k and s < quotes[k - 1][1]:
                _, b, inside, after = quotes[k - 1]
                if e >= b:  # the mark ends the quotation
                    skip = after
                    kind = "quote"
                elif inside or after:
                    skip = True
            if skip:
                last = e
                continue
        word, prior = "", 0.5
        if kind == "quote":
            prior = 0.98
        elif mark == " ":
            kind, prior = "blank", 0.5
        elif mark == "…" or line[s : s + 2] in ("..", "．．"):
            kind = "dots" if CJK.match(c) or s and CJK.match(line[s - 1]) else "dots_latin"
        elif mark in HARD:
            kind, prior = "hard", 0.98
        else:  # a single point
            left = line[s - 1] if s else ""
            if left.isdigit() and c.isdigit() and n == e:
                continue
            if left and CJK.match(left):
                kind = "point_cjk"
                first = s - 1
                while first > 0 and CJK.match(line[first - 1]):
                    first -= 1
                follows = line[e + 1] if e + 1 < length else ""
                initial = s - first == 1 or follows in ".．" or (last >= 0 and s - last == 1)
                prior = 0.01 if initial else 0.3
            else:
                if n == e and (c.islower() or left.isalpha() and c.isalpha() and line[e + 1 : e + 2] in (".", "．")):
                    continue  # inside an acronym
                word = left_word(line, s)
                low = word.lower()
                if low in _ENDERS and ("." not in word or word.islower()):
                    kind, prior = "word", 0.9
                elif low in _TITLES:
                    kind, prior = "word", 0.01
                elif len(word) == 1:
                    kind, prior, word = "initial", 0.02, ""
                elif "." in word:
                    kind, prior, word = "acronym", 0.1, ""
                else:
                    kind, prior = "word", 0.95
                if n == e and not (c.isupper() or CJK.match(c) or c in OPENERS):
                    prior = min(prior, 0.05)
        slot, case = right_token(line, n)
        if case == "l" and mark in "。｡！？":
            case = "o"  # these marks end a sentence whatever letter comes
        g.at.append(e)
        g.kind.append(KINDS[kind])
        g.left.append(l_slot(word) if word else -1)
        g.prior.append(prior)
        g.right.append(slot)
        g.case.append(case)
        since = g.at[-2] if len(g.at) > 1 else 0
        doubtful = kind in _SOFT or kind == "word" and (word.lower() in _ENDERS or word.lower() in _TITLES)
        g.near.append(doubtful and (s - since <= 2 if kind == "point_cjk" or case == "c" else len(line[since:s].split()) <= FEW))
        last = e
    return g


# --- training ---------------------------------------------------------------------------

#: Blocks of the one table of counts: words by (line end, capital, other), starts, right tokens by kind, n-grams.
_WORDS, _STARTS, _RIGHTS = 0, 3 * L_SIZE, 3 * L_SIZE + R_SIZE
_GRAMS = _RIGHTS + len(KINDS) * R_SIZE
TABLE = _GRAMS + ngrams.TABLE


def count_line(line: str, table_: np.ndarray) -> None:
    stripped = line.strip()
    if not stripped:
        return
    first = RIGHT.match(stripped).end()
    if first < len(stripped):
        table_[_STARTS + right_token(stripped, 0)[0]] += 1
    body = stripped.rstrip(_CLOSE + " ")
    if body.endswith(".") and not body.endswith("..") and (word := left_word(body, len(body) - 1)):
        table_[_WORDS + 3 * l_slot(word)] += 1
    g = gaps(line)
    for kind, left, right, case in zip(g.kind, g.left, g.right, g.case):
        table_[_RIGHTS + kind * R_SIZE + right] += 1
        if left >= 0:
            table_[_WORDS + 3 * left + (1 if case == "U" else 2)] += 1
        if kind == KINDS["hard"]:
            table_[_STARTS + right] += 1


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Counts over all texts, in one table of fixed size."""

    def part(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.zeros(TABLE, np.int64)
        for b in rows:
            for text in b["text"]:
                if text:
                    for m in LINE.finditer(text):
                        count_line(m.group(), t)
            ngrams.count("\n".join(x for x in b["text"] if x), t[_GRAMS:])
        at = np.flatnonzero(t)
        yield pd.DataFrame({"slot": at, "n": t[at]})

    found = texts.select("text").mapInPandas(part, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(TABLE, np.int64)
    rows = found.toPandas()  # at most TABLE rows
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


@dataclass
class Model:
    word: np.ndarray  # log-odds that a word with a point ends a sentence before a capital, or nan
    start: np.ndarray  # log P(right | boundary)
    inner: np.ndarray  # log P(right | no boundary) by kind
    odds: np.ndarray  # log-odds of a boundary by kind, as EM found them
    grams: ngrams.Model | None  # for lines without marks; None if nothing has been counted


def fit(counts: np.ndarray, rounds: int = 12) -> Model:
    words = counts[_WORDS:_STARTS].reshape(L_SIZE, 3).astype(float)
    starts = counts[_STARTS:_RIGHTS].astype(float)
    rights = counts[_RIGHTS:_GRAMS].reshape(len(KINDS), R_SIZE).astype(float)
    p_start = (starts + 0.02) / (starts.sum() + 0.02 * R_SIZE)
    inner, odds = np.zeros_like(rights), np.zeros(len(KINDS))
    for k in range(len(KINDS)):
        n = rights[k]
        total = n.sum()
        # The starters' share of the mass is told from a free distribution by excess: a token
        # belongs to the inside as far as it follows the mark more often than boundaries explain.
        p_b = 0.5
        for _ in range(rounds):
            rest = np.maximum(n - total * p_b * p_start - 2 * np.sqrt(n), 0)
            p_b = float(np.clip((total - rest.sum() + 1) / (total + 2), 0.005, 0.995))
        p_in = (rest + 0.001) / (rest.sum() + 0.001 * R_SIZE)
        inner[k], odds[k] = np.log(p_in), np.log(p_b / (1 - p_b))
    # Where boundaries are certain to be seen: the share of line ends among ends and capitals.
    usual = words[:, 0].sum() / max(1.0, words[:, :2].sum())
    seen = words[:, :2].sum(axis=1)
    share = np.clip(words[:, 0] / np.maximum(seen, 1) / max(usual, 1e-6), 0, 1)
    sure = 5 * np.minimum(1, seen / 200)
    word = np.where(seen >= 20, np.clip(np.log((share * seen + 0.05) / ((1 - share) * seen + 0.05)), -sure, sure), np.nan)
    grams = counts[_GRAMS:]
    return Model(word, np.log(p_start), inner, odds, ngrams.model(grams) if grams[:ngrams.STARTS].any() else None)


# --- decoding ---------------------------------------------------------------------------

_CASE = {"U": 0.0, "c": 0.0, "l": -7.0, "d": -1.0, "o": -1.0, "e": 0.0}
#: How far the token after a mark may move the log-odds, by kind: most where the mark itself tells least.
_REACH = np.full(len(KINDS), 1.5)
_REACH[[KINDS["dots"], KINDS["dots_latin"], KINDS["blank"]]] = 6.0


def log_odds(g: Gaps, model: Model) -> np.ndarray:
    kind, right, left = np.array(g.kind), np.array(g.right), np.array(g.left)
    prior = np.array(g.prior)
    base = np.log(prior / (1 - prior))
    learnt = np.where(left >= 0, model.word[np.maximum(left, 0)], np.nan)
    base = np.where(np.isnan(learnt), base, np.clip(base + learnt, -6, 6))
    # A model that hasn't counted anything knows nothing of the token after a plain mark.
    reach = _REACH[kind] if model.grams else np.where(_REACH[kind] > 2, _REACH[kind], 0)
    ratio = np.clip(model.start[right] - model.inner[kind, right], -reach, reach)
    caseless = np.array([c == "c" for c in g.case])
    doubtful = _REACH[kind] > 2
    # In a script with case a capital decides after dots; the token decides elsewhere.
    base = base + np.where(~doubtful | caseless | (kind == KINDS["blank"]), ratio + np.where(kind == KINDS["dots"], model.odds[kind], 0), 0)
    base = base + np.where(doubtful & ~caseless, np.array([2.0 if c == "U" else 0.0 for c in g.case]), 0)
    # What has few tokens is hardly a sentence, however well its last word ends others.
    return np.where(np.array(g.near), np.minimum(base, 1), base) + np.array([_CASE[c] for c in g.case])


#: Tokens that a sentence has where no mark tells of one, and the log-odds of one with fewer.
SHORT, FEWER = 3, -6.0


def posteriors(odds: np.ndarray, near: list[bool]) -> np.ndarray:
    """P(boundary) at each gap by forward-backward; two boundaries in near gaps are unlikely.

    Where no gap is near, they are independent, and each posterior is that of its own odds.
    """
    if not any(near):
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    n = len(odds)
    emit = np.stack([np.zeros(n), odds], 1)
    step = np.array([[0.0, 0.0], [0.0, -9.0]])
    free = np.zeros((2, 2))
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = emit[0] + (step[1] if near[0] else 0)  # the line starts after a boundary
    for i in range(1, n):
        f[i] = emit[i] + np.logaddexp.reduce(f[i - 1][:, None] + (step if near[i] else free), 0)
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce((step if near[i + 1] else free) + (emit[i + 1] + b[i + 1])[None, :], 1)
    both = f + b
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -30, 30)))


def apart(odds: np.ndarray) -> np.ndarray:
    """P(boundary) at each gap by forward-backward over the tokens since the last boundary.

    A sentence of fewer than `SHORT` tokens is unlikely.
    """
    n = len(odds)
    few = np.full(SHORT, FEWER)
    few[-1] = 0.0  # state k: k + 1 tokens since the boundary, the last state for as many or more
    f, b = np.full((n + 1, SHORT), -np.inf), np.zeros((n + 1, SHORT))
    f[0, 0] = 0
    for i in range(n):
        stay = np.concatenate([[-np.inf], f[i, :-1]])
        stay[-1] = np.logaddexp(stay[-1], f[i, -1])
        f[i + 1] = stay
        f[i + 1, 0] = np.logaddexp.reduce(f[i] + few) + odds[i]
    b[n] = few
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        go = np.concatenate([b[i + 1, 1:], b[i + 1, -1:]])
        cut = few + odds[i] + b[i + 1, 0]
        b[i] = np.logaddexp(go, cut)
        z = np.logaddexp.reduce(f[i] + b[i])
        out[i] = np.exp(min(0.0, np.logaddexp.reduce(f[i] + cut) - z))
    return out


def unmarked_cuts(lines: list[str], model: ngrams.Model) -> list[list[int]]:
    """Where sentences end in lines without any mark, by the pairs of their tokens."""
    out: list[list[int]] = [[] for _ in lines]
    some: list[int] = []
    size = 0

    def flush() -> None:
        t = ngrams.tokens("\n".join(lines[i] for i in some))
        if not len(t.start):
            return
        odds = model.odds(t)
        begins = np.cumsum([0] + [len(lines[i]) + 1 for i in some])
        first = np.searchsorted(t.start, begins)
        for k, i in enumerate(some):
            a, z = int(first[k]), int(first[k + 1])
            own = odds[a : z - 1]
            if len(own) and own.max() > 0:
                # Few tokens are hardly a sentence, at the begin of the line and after a boundary.
                yes = apart(own) > 0.5
                out[i] = (t.end[a : z - 1][yes] - begins[k]).tolist()

    for i, line in enumerate(lines):
        some.append(i)
        size += len(line) + 1
        if size >= ngrams.STRETCH:
            flush()
            some, size = [], 0
    if some:
        flush()
    return out


def line_units(line: str, offset: int, cuts: list[int], out: list[tuple[int, int]]) -> None:
    """The stretches between the cuts, without the blanks around them."""
    at = 0
    for e in [*cuts, len(line)]:
        piece = line[at:e]
        whole = piece.strip()
        if whole:
            first = offset + at + (len(piece) - len(piece.lstrip()))
            out.append((first, first + len(whole)))
        at = e


def split_many(texts: list[str | None], model: Model) -> list[list[tuple[int, int]]]:
    """The units of each text.  The events of all texts are scored together."""
    lines, events = [], Gaps([], [], [], [], [], [], [], [])
    for i, text in enumerate(texts):
        if text:
            for m in LINE.finditer(text):
                line = m.group()
                g = gaps(line)
                lines.append((i, line, m.start(), len(events.at), len(g.at)))
                for mine, more in ((events.at, g.at), (events.kind, g.kind), (events.left, g.left), (events.prior, g.prior), (events.right, g.right), (events.case, g.case), (events.near, g.near)):
                    mine.extend(more)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    odds = log_odds(events, model) if events.at else np.zeros(0)
    yes = odds > 0
    bare = [k for k, (_, line, _, _, n) in enumerate(lines) if not n and not BARE.search(line)] if model.grams else []
    found = dict(zip(bare, unmarked_cuts([lines[k][1] for k in bare], model.grams)))
    for k, (i, line, offset, a, n) in enumerate(lines):
        cuts = found.get(k, ())
        if n:
            near = events.near[a : a + n]
            ends = posteriors(odds[a : a + n], near) > 0.5 if any(near) else yes[a : a + n]
            cuts = [e for e, y in zip(events.at[a : a + n], ends) if y]
        line_units(line, offset, cuts, out[i])
    return out


def trained_model(texts: DataFrame) -> Model:
    return fit(corpus_counts(texts))


def sentence_units(items: DataFrame, model: Model) -> DataFrame:
    """(item_kind, item_id, start_pos, end_pos) of every unit of (item_kind, item_id, text)."""
    shared = items.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, under 2 MB

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            units = split_many(list(b["text"]), shared.value)
            n = [len(u) for u in units]
            flat = np.array([p for u in units for p in u], np.int32).reshape(-1, 2)
            yield pd.DataFrame({
                "item_kind": np.repeat(b["item_kind"].to_numpy(), n),
                "item_id": np.repeat(b["item_id"].to_numpy(), n),
                "start_pos": flat[:, 0], "end_pos": flat[:, 1],
            })

    return items.select("item_kind", "item_id", "text").mapInPandas(run, "item_kind string, item_id bigint, start_pos int, end_pos int")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once(table(spark, sf_dir, "paragraphs", "paragraph_id", "text"), "paragraph_id")
    c = once(table(spark, sf_dir, "chapter_models", "model_id", "text"), "model_id")
    return p.select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), "text").unionByName(
        c.select(F.lit("chapter_model").alias("item_kind"), F.col("model_id").alias("item_id"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts may see a repeated row twice; the units may not.
    every = table(spark, sf_dir, "paragraphs", "text").unionByName(table(spark, sf_dir, "chapter_models", "text"))
    return sentence_units(_items(spark, sf_dir), trained_model(every))


QUERIES = {"p5_found": p5_found}
ORACLE: dict[str, str] = {}
