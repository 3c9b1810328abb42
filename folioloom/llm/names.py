"""Variant spellings of persons and organisations typed by many people, linked by entity.

Method: merge-and-rematch resolution.  Every entry becomes a profile: what its canonical name
and those variants that agree with it say about given names, generation and surname, or about
the kind of firm and its family, in two writing systems.  Profiles that match are merged; the
merged profile holds the spellings and initials of all of them, enters blocking again and may
match what none of its parts did: an entry with initials only, one written in the other
script.  Rounds go on until none merges.

The lexicon that reads names is learned from the entries, over all of them: which tokens are
given names (they lead names in several works, more often than they end them), which nicknames and misspellings stand beside which
given name, which Chinese parts stand beside which Latin name, and which characters replace
each other in transliterations.  Its tables hold what occurs twice, whatever the size of the
corpus; one with more than 500,000 rows is an error.  A given name that isn't learned stands
for itself, as it is spelt.

Spellings are nodes: an entry is linked to its spellings, and spellings of one block are
linked if they are close, found through keys with one letter left out, or two in words that
may differ by two slips.  No pairs of entries or clusters
are formed before the result, so a hot name costs no more than its rows.

Names may be in any alphabet; the forms of address, generations and kinds of firms that are
given as fixed values are those of two writing systems.

Defined results: repeated entries count once; an entry without id or work takes no part; a
null or empty canonical, and one that can't be read as a name (a given name alone), links
only to entries of the same work with the same text if it isn't blank; null variants,
empty ones, and those that fit several entities, add nothing; kind isn't needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import bounded_rows, cut_lineage, once, table

# Forms of address, generations, and kinds of firms in both writing systems.
TITLES = frozenset("don dona dn dna dr dra sr sra srta cnel cel col gen capt cap ing lic fr prof".split())
JUNIOR = frozenset("segundo sdo ii jr junior hijo filho".split())
FIRMS = {
    "academy": ("academia", "acad", "学院"),
    "pharmacy": ("botica", "bot", "药房"),
    "publisher": ("editorial", "edit", "出版社"),
    "railway": ("ferrocarril", "fc", "铁路公司"),
    "shipping": ("naviera", "nav", "航运公司"),
    "bookshop": ("libreria", "libr", "书店"),
    "printer": ("imprenta", "imp", "印刷厂"),
    "company": ("compania", "cia", "公司"),
}
AND_SONS = re.compile(r"\b(?:y\s+cia\s+e\s+hijos|y\s+cia|(?:&|e|y)\s+(?:hijos|hjs)|hijos|hjs)\b|(?<=\s)&(?=\s|$)")
PLACE = re.compile(r"\s+(?:de|del|d|dal|da|de la)\s+\w+.*$")
_FIRM_LATIN = {w: k for k, ws in FIRMS.items() for w in ws[:2]}
_FIRM_CHINESE = sorted(((ws[2], k) for k, ws in FIRMS.items()), key=lambda x: -len(x[0]))

HAN = re.compile(r"[㐀-鿿豈-﫿]")
_TOKEN = re.compile(r"[^\W\d_]+\.?")
_RAILWAY = re.compile(r"\bf\s*\.\s*c\b\.?")


#: A longer word is no name: it equals only itself.
LONGEST = 64


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance; more than `most` counts as `most` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or max(len(a), len(b)) > LONGEST:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)


def close(a: str, b: str) -> bool:
    """Whether two Latin spellings may be one word with a slip."""
    short = min(len(a), len(b))
    return edit_distance(a, b, 2) <= (2 if short >= 6 else 1 if short >= 3 else 0)


def plain_latin(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if unicodedata.category(c) != "Mn")
    s = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", s)
    s = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", s)
    return re.sub(r"\s+", " ", re.sub(r"[-‐‑–_/]", " ", s)).strip()


@dataclass(frozen=True)
class Latin:
    """A Latin form as typed: tokens with their points, in the order given names, surnames if known."""

    given: tuple[str, ...]
    surname: tuple[str, ...]
    loose: tuple[str, ...]  # tokens not yet told apart
    junior: bool
    firm: str = ""


@lru_cache(100_000)
def firm_word(token: str) -> str:
    t = token.replace(".", "")
    if t in _FIRM_LATIN:
        return _FIRM_LATIN[t]
    short = token.endswith(".")
    if (3 if short else 6) <= len(t) <= (5 if short else 99):
        for w, k in _FIRM_LATIN.items():
            if (len(w) >= 6) == short or len(w) < 3 or t[0] != w[0] or edit_distance(t, w, 2) > (2 if len(w) >= 8 else 1):
                continue
            # Three letters may shorten a given name as well: only a letter typed twice, or two in reverse.
            if len(w) > 3 or re.sub(r"(.)\1", r"\1", t) == w or (w != "cia" and sorted(t) == sorted(w)):
                return k
    return ""


@lru_cache(200_000)
def read_latin(text: str, railway: bool = True) -> Latin | None:
    """`railway`: F. C. means a kind of firm, not two given names."""
    s = plain_latin(text)
    if railway:
        s = _RAILWAY.sub("fc", s)
    parts = [p.strip() for p in s.split(",")]
    words = [w for p in parts for w in re.findall(r"[^\W\d_]+\.?|&", p)]
    for w in words:
        if kind := firm_word(w):
            body = re.sub(r"\b(\w+)\.", r"\1", " , ".join(parts)).replace("&", " & ")
            body = AND_SONS.sub(" ", " " + re.sub(r"\s+", " ", body) + " ")
            rest = [p.strip() for p in body.split(",")]
            rest = [" ".join(x for x in p.split() if not (firm_word(x) and firm_word(x) == kind)) for p in rest]
            rest = [PLACE.sub("", " " + p).strip() for p in rest]
            rest = [p for p in rest if p]
            if not rest:
                return None
            return Latin((), tuple(rest[0].split()[:1]), (), False, kind)
    junior = False
    kept = []
    for p in parts:
        tokens = _TOKEN.findall(p)
        while tokens and tokens[0].rstrip(".") in TITLES and (len(tokens) > 1 or len(parts) > 1):
            tokens.pop(0)
        out = []
        for k, t in enumerate(tokens):
            bare = t.rstrip(".")
            if bare in JUNIOR or (k == len(tokens) - 1 and len(bare) >= 6 and edit_distance(bare, "segundo", 1) <= 1):
                junior = True
            else:
                out.append(t)
        if out:
            kept.append(out)
    if not kept:
        return None
    if len(kept) >= 2:
        return Latin(tuple(kept[1]), tuple(t.rstrip(".") for t in kept[0]), (), junior)
    return Latin((), (), tuple(kept[0]), junior)


@dataclass(frozen=True)
class Chinese:
    parts: tuple[str, ...]  # one part: not yet cut
    junior: bool
    vague: bool  # only a generation and a surname
    firm: str = ""


@lru_cache(200_000)
def read_chinese(text: str) -> Chinese | None:
    """`text` is in simplified characters."""
    s = text.strip()
    junior = False
    m = re.search(r"[（(](?:子|儿子|小)[）)]\s*$", s)
    if m:
        s, junior = s[: m.start()], True
    parts = [p for p in re.split(r"[^㐀-鿿豈-﫿]+", s) if p]
    if not parts:
        return None
    if len(parts) == 1:
        for word, kind in _FIRM_CHINESE:
            if s.endswith(word) and len(s) > len(word):
                family = s[: -len(word)]
                family = family[:-2] if family.endswith("父子") and len(family) > 2 else family
                return Chinese((family,), False, False, kind)
    for end in ("第二", "二世"):
        if parts[-1].endswith(end) and len(parts[-1]) > 2:
            parts[-1], junior = parts[-1][:-2], True
    vague = False
    if parts[0][0] in "老小" and len(parts[0]) > 1:
        if len(parts) > 1 or len(parts[0]) > 6:
            junior |= parts[0][0] == "小"
            parts[0] = parts[0][1:]
        else:
            vague = True
    return Chinese(tuple(parts), junior, vague)


# --- the lexicon -------------------------------------------------------------------------


@dataclass
class Lexicon:
    given: dict[str, str] = field(default_factory=dict)  # token -> given name
    nick: dict[str, tuple[str, ...]] = field(default_factory=dict)  # nickname of several given names
    chinese: dict[str, str] = field(default_factory=dict)  # part -> given name
    swaps: set[tuple[str, str]] = field(default_factory=set)  # characters that replace each other
    initial: dict[str, str] = field(default_factory=dict)  # first character of a surname -> Latin letters it renders

    def __post_init__(self) -> None:
        self.names = sorted(set(self.given.values()))
        self._cache: dict[tuple[str, str], frozenset[str]] = {}
        self._by_first: dict[str, set[str]] = {}
        self._class: dict[str, str] = {}
        for a, b in sorted(self.swaps):
            x, y = self.of_class(a), self.of_class(b)
            if x != y:
                self._class[max(x, y)] = min(x, y)
        for part, name in self.chinese.items():
            self._by_first.setdefault(part[0], set()).add(name)

    def __getstate__(self):
        return self.given, self.nick, self.chinese, self.swaps, self.initial

    def __setstate__(self, state):
        self.given, self.nick, self.chinese, self.swaps, self.initial = state
        self.__post_init__()

    def of_class(self, c: str) -> str:
        """One character for all that replace each other, over any number of steps."""
        while (up := self._class.get(c, c)) != c:
            c = up
        return c

    def latin(self, token: str) -> frozenset[str]:
        """Given names that a token may stand for."""
        key = ("l", token)
        if key not in self._cache:
            self._cache[key] = frozenset(self._latin(token))
        return self._cache[key]

    def _latin(self, token: str) -> set[str]:
        bare = token.rstrip(".")
        if len(bare) == 1:
            return {n for n in self.names if n[0] == bare}
        if bare in self.given:
            return {self.given[bare]}
        if bare in self.nick:
            return set(self.nick[bare])
        if token.endswith("."):
            if found := {n for n in self.names if n.startswith(bare)}:
                return found
            near = {n for n in self.names if any(edit_distance(n[:k], bare, 1) <= 1 for k in (len(bare) - 1, len(bare), len(bare) + 1))}
            return {n for n in near if n[0] == bare[0]} or near
        if len(bare) < 3:
            return set()
        ranked = sorted((edit_distance(bare, n, 2), n) for n in self.names)
        if not ranked or ranked[0][0] > (2 if len(bare) >= 6 else 1):
            return {n for w, n in self.given.items() if len(w) >= 4 and edit_distance(bare, w, 1) <= 1}
        return {n for d, n in ranked if d == ranked[0][0]}

    def near_name(self, token: str, most: int) -> bool:
        return len(token) >= 4 and any(edit_distance(token, n, most) <= most for n in self.names)

    def han(self, part: str) -> frozenset[str]:
        key = ("c", part)
        if key not in self._cache:
            self._cache[key] = frozenset(self._han(part))
        return self._cache[key]

    def _han(self, part: str) -> set[str]:
        if part in self.chinese:
            return {self.chinese[part]}
        if len(part) == 1:
            return self._by_first.get(part, set()) or {n for c, ns in self._by_first.items() if (c, part) in self.swaps for n in ns}
        best, found = 1.01 if len(part) < 4 else 1.61, set()
        for w, n in self.chinese.items():
            if abs(len(w) - len(part)) <= 1:
                d = self.han_distance(part, w)
                if d < best - 1e-9:
                    best, found = d, {n}
                elif abs(d - best) < 1e-9 and found:
                    found.add(n)
        return found

    def han_distance(self, a: str, b: str) -> float:
        """Edit distance in which characters that replace each other cost little."""
        prev = [float(j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            row = [float(i)]
            for j, y in enumerate(b, 1):
                c = 0.0 if x == y else 0.25 if (x, y) in self.swaps else 1.0
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + c))
            prev = row
        return prev[-1]

    def han_close(self, a: str, b: str) -> bool:
        n = max(len(a), len(b))
        if n > LONGEST:
            return a == b
        return self.han_distance(a, b) <= (1.0 if n <= 2 else 1.25 if n == 3 else 1.5) and not (n <= 2 and self.han_distance(a, b) >= 1 and min(len(a), len(b)) < 2)


def forms(canonical: str | None, variants, to_simplified: dict) -> list[str]:
    """The canonical name and the variants, blanks left out; Chinese ones simplified."""
    every = [canonical, *(variants if variants is not None else [])]
    return [x.translate(to_simplified) if x and HAN.search(x) else x or "" for x in every]


def first_given(form: Latin) -> str:
    return form.given[0] if form.given else form.loose[0] if form.loose else ""


def _counted(rows: DataFrame, f, keys: str) -> DataFrame:
    """Counts what `f` yields for (work_id, canonical, variants), by entries and by works."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            c = Counter((k, w) for w, canonical, variants in zip(b["work_id"], b["canonical"], b["variants"]) for k in set(f(canonical, variants)))
            yield pd.DataFrame([(a, z, w, n) for ((a, z), w), n in c.items()], columns=["a", "z", "work_id", "n"])

    counted = rows.select("work_id", "canonical", "variants").mapInPandas(run, "a string, z string, work_id string, n bigint")
    return counted.groupBy("a", "z").agg(F.sum("n").alias("n"), F.countDistinct("work_id").alias("works"))


#: Stands beside a token that ends a name.
LAST = "\x00last"


def slip(token: str, name: str, times: float) -> bool:
    """Whether a token is likelier a misspelling of a name that occurs so many times as often: each letter needs more of them."""
    return len(token) >= 3 and times > 5 and edit_distance(token, name, 2) <= (2 if times > 20 and len(token) >= 6 else 1)


def learn(entries: DataFrame, to_simplified: dict) -> Lexicon:
    """The lexicon of all entries.  What is collected occurs twice, at every size; beyond a limit it is an error."""
    entries = entries.where("work_id is not null")

    def latin_heads(canonical, variants):
        read = [read_latin(x) for x in forms(canonical, variants, to_simplified) if x and not HAN.search(x)]
        # A form with points shortens a name; a comma form has told its given names.
        heads = {first_given(r) for r in read if r and not r.firm}
        heads = {h for h in heads if len(h) >= 2 and not h.endswith(".")}
        ends = {(r.surname or r.loose)[-1].rstrip(".") for r in read if r and not r.firm and (r.surname or len(r.loose) > 1)}
        for t in ends:
            yield t, LAST
        for h in heads:
            yield h, ""
            for other in heads:
                if other != h:
                    yield h, other

    rows = bounded_rows(_counted(entries, latin_heads, "").where("works >= 2"), 500_000, "the lexicon's given names")
    n_of = {r.a: (r.n, r.works) for r in rows if not r.z}
    last = {r.a: r.n for r in rows if r.z == LAST}
    beside: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        if r.z and r.z in n_of and n_of[r.z][0] > n_of.get(r.a, (0, 0))[0]:
            beside.setdefault(r.a, []).append((r.n, r.z))
    given: dict[str, str] = {}
    nick: dict[str, tuple[str, ...]] = {}
    for t, (n, w) in sorted(n_of.items(), key=lambda kv: -kv[1][0]):
        others = [(k, g) for k, g in beside.get(t, []) if given.get(g) == g]
        total = sum(k for k, _ in others)
        if total >= max(2, 0.1 * n):  # a nickname or a slip
            found = tuple(sorted(g for k, g in others if k >= 0.25 * total))
            if len(found) == 1:
                given[t] = found[0]
            else:
                nick[t] = found
        elif n > last.get(t, 0) and not any(slip(t, g, n_of[g][0] / n) for g in (*given, *nick)):
            given[t] = t
    lexicon = Lexicon(given, nick)

    def chinese_parts(canonical, variants):
        texts = forms(canonical, variants, to_simplified)
        told = [codes for x in texts if x and not HAN.search(x) and (codes := sure_given(x, lexicon))]
        if not told:
            return
        best = max(told, key=len)
        for x in texts:
            c = read_chinese(x) if x and HAN.search(x) else None
            if c and not c.firm and not c.vague and len(c.parts) == len(best) + 1:
                for part, code in zip(c.parts, best):
                    if len(part) > 1:
                        yield part, code

    rows = bounded_rows(_counted(entries, chinese_parts, "").where(F.col("n") >= 2), 500_000, "the lexicon's Chinese parts")
    by_part: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by_part.setdefault(r.a, []).append((r.n, r.z))
    chinese = {}
    for part, found in by_part.items():
        n, code = max(found)
        if n >= 0.6 * sum(x for x, _ in found):
            chinese[part] = code

    def swapped(canonical, variants):
        surnames = set()
        for x in forms(canonical, variants, to_simplified):
            c = read_chinese(x) if x and HAN.search(x) else None
            if c and not c.vague and (c.firm or len(c.parts) > 1):
                surnames.add(c.parts[-1])
        for a in surnames:
            for b in surnames:
                if a < b and len(a) == len(b) and len(a) > 1:
                    for x, y in zip(a, b):
                        if x != y:
                            yield min(x, y), max(x, y)

    rows = bounded_rows(_counted(entries, swapped, "").where(F.col("n") >= 2), 500_000, "the lexicon's characters")
    swaps = {p for r in rows for p in ((r.a, r.z), (r.z, r.a))}
    by_code: dict[str, list[str]] = {}
    for part, code in chinese.items():
        by_code.setdefault(code, []).append(part)
    for parts in by_code.values():
        for a in parts:
            for b in parts:
                if a != b and len(a) == len(b):
                    swaps |= {(x, y) for x, y in zip(a, b) if x != y}

    lexicon = Lexicon(given, nick, chinese, swaps)

    def heads(canonical, variants):
        p = profile(canonical, variants, to_simplified, lexicon)
        if p:
            for han in p.han:
                for latin in p.latin:
                    yield han[0], latin[0]

    rows = bounded_rows(_counted(entries, heads, "").where(F.col("n") >= 2), 500_000, "the lexicon's first characters")
    total: dict[str, int] = {}
    for r in rows:
        total[r.a] = total.get(r.a, 0) + r.n
    initial: dict[str, str] = {}
    for r in rows:
        if r.n >= 0.08 * total[r.a]:
            initial[r.a] = initial.get(r.a, "") + r.z
    return Lexicon(given, nick, chinese, swaps, initial)


def cut_latin(form: Latin, lexicon: Lexicon) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """(given tokens, surnames) of a form whose tokens aren't told apart by a comma."""
    if form.given:
        return (form.given[:2], form.surname) if form.surname else None
    t = form.loose
    if len(t) < 2:
        return None
    n = 1
    if len(t) >= 3 and (t[1].endswith(".") or len(t[1]) == 1 or t[1] in lexicon.given or lexicon.near_name(t[1], 1 if len(t) == 3 else 2)):
        n = 2
    return t[:n], tuple(x.rstrip(".") for x in t[n:])


def sure_given(text: str, lexicon: Lexicon) -> tuple[str, ...] | None:
    """The given names of a Latin form if each is spelt as the lexicon has it."""
    form = read_latin(text)
    if form is None or form.firm:
        return None
    cut = cut_latin(form, lexicon)
    if cut is None or any(t.endswith(".") or t not in lexicon.given for t in cut[0]):
        return None
    return tuple(lexicon.given[t] for t in cut[0])


# --- profiles ----------------------------------------------------------------------------


@dataclass
class Profile:
    """What an entry says of its entity.  `given` has a set of names for each position."""

    firm: str
    junior: bool
    given: list[frozenset[str]]
    latin: set[str]
    han: set[str]
    own: list[str] = field(default_factory=list)  # the given names as spelt


@lru_cache(200_000)
def _segment(part: str, lexicon_id: int) -> tuple[str, ...]:
    lexicon = _LEXICONS[lexicon_id]
    out, rest = [], part
    while len(out) < 2:
        for n in range(min(6, len(rest) - 2), 1, -1):
            if rest[:n] in lexicon.chinese:
                out.append(rest[:n])
                rest = rest[n:]
                break
        else:
            best = None
            for n in range(min(6, len(rest) - 2), 2, -1):
                for w in lexicon.chinese:
                    if len(w) == n and (d := lexicon.han_distance(rest[:n], w)) <= 1.0 and (best is None or d < best[0]):
                        best = (d, n)
            if best is None or (out and best[0] > 0.5 and len(rest) - best[1] < 2):
                break
            out.append(rest[: best[1]])
            rest = rest[best[1] :]
    return (*out, rest)


_LEXICONS: dict[int, Lexicon] = {}


def segment(part: str, lexicon: Lexicon) -> tuple[str, ...]:
    """An uncut Chinese name in its parts, by the given names at its start."""
    _LEXICONS[id(lexicon)] = lexicon
    return _segment(part, id(lexicon))


def read(text: str, lexicon: Lexicon, railway: bool = True) -> Profile | None:
    """The profile of one form, or None if it names nobody in particular."""
    if not text or not text.strip():
        return None
    if HAN.search(text):
        c = read_chinese(text)
        if c is None or c.vague:
            return None
        if c.firm:
            return Profile(c.firm, False, [], set(), {c.parts[0]})
        parts = c.parts
        if len(parts) == 1:
            if len(parts[0]) < 4:
                return None
            parts = segment(parts[0], lexicon)
        if not 2 <= len(parts) <= 3:
            return None
        return Profile("", c.junior, [lexicon.han(p) for p in parts[:-1]], set(), {parts[-1]}, list(parts[:-1]))
    form = read_latin(text, railway)
    if form is None:
        return None
    if form.firm:
        return Profile(form.firm, False, [], {form.surname[0]}, set())
    cut = cut_latin(form, lexicon)
    if cut is None:
        return None
    given, surnames = cut
    return Profile("", form.junior, [lexicon.latin(t) for t in given], {surnames[0]}, set(), list(given))


def profile(canonical: str | None, variants, to_simplified: dict, lexicon: Lexicon) -> Profile | None:
    """The canonical name, with what the variants that agree with it add."""
    first, *rest = forms(canonical, variants, to_simplified)
    p = read(first, lexicon)
    if p is None:
        return None
    if p.firm and not HAN.search(first) and _RAILWAY.search(plain_latin(first)) and (person := read(first, lexicon, railway=False)) and len(person.given) == 2:
        # Two initials or a firm: what more of the variants say.
        told = [q for x in rest if (q := read(x, lexicon))]
        if sum(not q.firm and len(q.given) == 2 and all(a & b for a, b in zip(q.given, person.given)) for q in told) > sum(bool(q.firm) for q in told):
            p = person
    for text in rest:
        q = read(text, lexicon)
        # A given name or nickname alone, or with the surname, still tells an initial's name.
        if p.given and len(p.given[0]) > 1 and text and not HAN.search(text) and (form := read_latin(text)) and not form.firm:
            heads = lexicon.latin(first_given(form)) if len(form.given or form.loose) <= 2 else frozenset()
            if heads & p.given[0]:
                p.given = [heads & p.given[0], *p.given[1:]]
        if q is None or q.firm != p.firm or len(q.given) != len(p.given) or q.junior and not p.junior:
            continue
        both = [a & b if a and b else a or b for a, b in zip(p.given, q.given)]
        # Where neither is learned, the same spelling agrees.
        if any(not x and (a or b or s != t) for x, a, b, s, t in zip(both, p.given, q.given, p.own, q.own)):
            continue
        if p.latin and q.latin and not any(close(a, b) for a in p.latin for b in q.latin):
            continue
        if p.han and q.han and not any(lexicon.han_close(a, b) for a in p.han for b in q.han):
            continue
        p.given = both
        # A variant without the generation may mean the parent: its spelling of the family's name holds all the same.
        p.latin |= q.latin
        p.han |= q.han
    p.given = [g or frozenset([s]) for g, s in zip(p.given, p.own)]
    return p


# --- linking -----------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of (a, b), by star contraction.

    Each round links all neighbours to the smallest one, from the larger ends and then from the
    smaller; the lineage is cut after each round.  The number of rounds grows with the logarithm
    of the largest component.
    """
    def seal(df: DataFrame):
        """The number of edges and a digest of them: two sets are told apart in one pass."""
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = seal(e)
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").distinct())
        after = seal(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def deletions(word: str, slips: int = 1) -> list[str]:
    """The word with up to `slips` letters left out: words that many slips apart share one of them."""
    found = last = {word}
    for _ in range(slips if len(word) <= LONGEST else 0):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return list(found)


PROFILE = "entry_id bigint, work_id string, firm string, junior boolean, given array<array<string>>, latin array<string>, han array<string>, text string"


def profiles(entries: DataFrame, to_simplified: dict, lexicon: Lexicon) -> DataFrame:
    shared = entries.sparkSession.sparkContext.broadcast(lexicon)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for e, w, canonical, variants in zip(b["entry_id"], b["work_id"], b["canonical"], b["variants"]):
                p = profile(canonical, variants, to_simplified, shared.value)
                text = re.sub(r"\s+", " ", plain_latin(canonical or ""))
                if p is None:
                    out.append((e, w, None, None, [], [], [], text))
                else:
                    out.append((e, w, p.firm, p.junior, [sorted(g) for g in p.given], sorted(p.latin), sorted(p.han), text))
            yield pd.DataFrame(out, columns=["entry_id", "work_id", "firm", "junior", "given", "latin", "han", "text"])

    return entries.select("entry_id", "work_id", "canonical", "variants").mapInPandas(run, PROFILE)


def _keyed(words: DataFrame, shared, ddl: str) -> DataFrame:
    """Rows with script and word, for each key of the word: close words share one."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            # As many letters left out as `close` and `han_close` allow slips: no close pair is missed.
            keys = [deletions(w, 2 if len(w) >= 6 else 1) if s == "latin" else deletions("".join(map(shared.value.of_class, w))) for s, w in zip(b["script"], b["word"])]
            r = b.loc[b.index.repeat([len(k) for k in keys])].reset_index(drop=True)
            r["key"] = [k for ks in keys for k in ks]
            yield r

    return words.mapInPandas(run, f"{ddl}, key string")


def spelling_links(nodes: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(a, b): close spellings of one block, of nodes (node, block, script, word).

    With a column `fresh`, only pairs with a fresh node.
    """
    if "fresh" in nodes.columns:
        nodes = nodes.join(nodes.where("fresh").select("block").distinct(), "block", "left_semi")
    else:
        nodes = nodes.withColumn("fresh", F.lit(True))
    shared = nodes.sparkSession.sparkContext.broadcast(lexicon)
    k = _keyed(nodes, shared, "node bigint, block string, script string, word string, fresh boolean")
    a = k.select("block", "script", "key", F.col("node").alias("a"), F.col("word").alias("wa"), F.col("fresh").alias("fa"))
    b = k.select("block", "script", "key", F.col("node").alias("b"), F.col("word").alias("wb"), F.col("fresh").alias("fb"))
    pairs = a.join(b, ["block", "script", "key"]).where("a < b and (fa or fb)").select("a", "b", "script", "wa", "wb").distinct()

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            ok = [close(x, y) if s == "latin" else shared.value.han_close(x, y) for s, x, y in zip(p["script"], p["wa"], p["wb"])]
            yield p.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(check, "a bigint, b bigint")


def _spellings(entries: DataFrame) -> DataFrame:
    """(entry_id, block, script, word, node): the spellings of entries that have a block."""
    return entries.select("entry_id", "block", F.explode(F.concat(
        F.transform("latin", lambda w: F.struct(F.lit("latin").alias("script"), w.alias("word"))),
        F.transform("han", lambda w: F.struct(F.lit("han").alias("script"), w.alias("word"))))).alias("s")).select(
        "entry_id", "block", "s.script", "s.word", (-F.abs(F.xxhash64("block", "s.script", "s.word") % F.lit(1 << 61)) - 1).alias("node"))


def resolve(entries: DataFrame, to_simplified: dict, lexicon: Lexicon) -> DataFrame:
    """(entry_id, work_id, entity): entries with one entity have one number."""
    shared = entries.sparkSession.sparkContext.broadcast(lexicon)
    base = cut_lineage(profiles(once(entries, "entry_id").where("work_id is not null"), to_simplified, lexicon))
    readable = base.where("firm is not null")
    sure = F.forall("given", lambda g: F.size(g) == 1)
    block = F.concat_ws("|", "work_id", "firm", F.col("junior").cast("string"), F.concat_ws("+", F.transform("given", lambda g: g[0])))

    # Round 1: profiles whose given names are certain; entries meet at their spellings.
    certain = readable.where(sure).withColumn("block", block)
    spelt = cut_lineage(_spellings(certain))
    nodes = spelt.select("node", "block", "script", "word").distinct()
    unread = base.where("firm is null and text <> ''").withColumn("node", -F.abs(F.xxhash64("work_id", "text") % F.lit(1 << 61)) - 1).select(F.col("entry_id").alias("a"), F.col("node").alias("b"))
    edges = cut_lineage(
        spelt.select(F.col("entry_id").alias("a"), F.col("node").alias("b")).unionByName(spelling_links(nodes, lexicon)).unionByName(unread))

    open_ = base.where("firm is not null").where(~sure)
    while True:  # ends: a round that goes on has fewer clusters or fewer open entries
        # Merge: a cluster has the spellings of all its entries.
        label = cut_lineage(components(edges))
        found = label.select(F.col("node").alias("entry_id"), F.col("label").alias("cluster"))
        words = spelt.join(found, "entry_id").groupBy("cluster", "block").agg(
            F.array_sort(F.collect_set(F.when(F.col("script") == "latin", F.col("word")))).alias("latin"),
            F.array_sort(F.collect_set(F.when(F.col("script") == "han", F.col("word")))).alias("han"))
        merged = cut_lineage(words)
        # Rematch: clusters of one block that each lack the other's script; open entries that agree with a block's clusters.
        new = _rematch_clusters(merged, shared).unionByName(_rematch_open(open_, merged, shared))
        new = cut_lineage(new.distinct())
        if new.isEmpty():
            break
        # A merged entry brings its spellings to the cluster's block, where they meet all spellings.
        placed = new.where("block is not null").select(F.col("a").alias("entry_id"), "block").distinct()
        gained = cut_lineage(_spellings(open_.join(placed, "entry_id")))
        spelt = cut_lineage(spelt.unionByName(gained))
        fresh = gained.select("node", "block", "script", "word").distinct().join(nodes, "node", "left_anti")
        nodes = cut_lineage(nodes.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True))))
        edges = cut_lineage(label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new.select("a", "b")).unionByName(
            gained.select(F.col("entry_id").alias("a"), F.col("node").alias("b"))).unionByName(spelling_links(nodes, lexicon)))
        nodes = nodes.drop("fresh")
        open_ = cut_lineage(open_.join(placed.select("entry_id").distinct(), "entry_id", "left_anti"))
    # Entries still open meet those with the same reading.
    reading = F.concat_ws("|", "work_id", "firm", F.col("junior").cast("string"), F.to_json("given"))
    twins = open_.select("entry_id", reading.alias("block"), F.explode(F.concat("latin", "han")).alias("word")).select(
        F.col("entry_id").alias("a"), (-F.abs(F.xxhash64("block", "word") % F.lit(1 << 61)) - 1).alias("b"))
    label = components(edges.unionByName(twins)).where("node >= 0")
    return base.select("entry_id", "work_id").join(label.withColumnRenamed("node", "entry_id"), "entry_id", "left").select(
        "entry_id", "work_id", F.coalesce("label", "entry_id").alias("entity"))


def _only(mine: DataFrame, theirs: DataFrame, me: str, them: str) -> DataFrame:
    """(me, them): who has a single choice among those that share one of its letters in its block.

    Each group of (block, letter) is told by its smallest and largest member, so nothing is paired.
    """
    groups = theirs.groupBy("block", "letter").agg(F.min(them).alias("lo"), F.max(them).alias("hi"))
    return mine.join(groups, ["block", "letter"]).groupBy(me).agg(F.min("lo").alias(them), F.max("hi").alias("_hi")).where(f"{them} = _hi").drop("_hi")


def _rematch_clusters(merged: DataFrame, shared) -> DataFrame:
    """Clusters of one block without a common script, joined if each is the other's only choice.

    The first letters of a transliteration tell which may be one name.
    """

    def letters(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        initial = shared.value.initial
        for p in it:
            p["letters"] = [sorted({x for h in han for x in initial.get(h[0], "")}) for han in p["han"]]
            yield p[["block", "b", "letters"]]

    latin = merged.where("size(latin) > 0 and size(han) = 0").select(
        "block", F.col("cluster").alias("a"), F.explode(F.array_distinct(F.transform("latin", lambda w: F.substring(w, 1, 1)))).alias("letter"))
    han = merged.where("size(han) > 0 and size(latin) = 0").select("block", F.col("cluster").alias("b"), "han").mapInPandas(
        letters, "block string, b bigint, letters array<string>").select("block", "b", F.explode("letters").alias("letter"))
    return _only(latin, han, "a", "b").join(_only(han, latin, "b", "a"), ["a", "b"]).select("a", "b", F.lit(None).cast("string").alias("block"))


def _rematch_open(open_: DataFrame, merged: DataFrame, shared) -> DataFrame:
    """Entries with several readings, joined to the clusters that agree with one of them if they are of one block.

    Spellings meet by their keys, each once in a block: entries and clusters only follow theirs.
    """
    reading = open_.select(
        "entry_id", "latin", "han",
        F.explode(F.expr(
            "case when size(given) = 0 then array(cast(array() as array<string>)) when size(given) = 1 then transform(given[0], x -> array(x)) "
            "else flatten(transform(given[0], x -> transform(given[1], y -> array(x, y)))) end")).alias("names"),
        "work_id", "firm", "junior")
    in_block = reading.withColumn("block", F.concat_ws("|", "work_id", "firm", F.col("junior").cast("string"), F.concat_ws("+", "names"))).join(
        merged.select("block").distinct(), "block", "left_semi")
    spelt = F.explode(F.concat(
        F.transform("latin", lambda w: F.struct(F.lit("latin").alias("script"), w.alias("word"))),
        F.transform("han", lambda w: F.struct(F.lit("han").alias("script"), w.alias("word"))))).alias("s")
    mine = in_block.select(F.col("entry_id").alias("a"), "block", spelt).select("a", "block", "s.*")
    theirs = merged.select(F.col("cluster").alias("b"), "block", spelt).select("b", "block", "s.*")
    asked, known = (_keyed(df.select("block", "script", "word").distinct(), shared, "block string, script string, word string") for df in (mine, theirs))
    pairs = asked.withColumnRenamed("word", "wa").join(known.withColumnRenamed("word", "wb"), ["block", "script", "key"]).select("block", "script", "wa", "wb").distinct()

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield p.loc[[close(x, y) if s == "latin" else shared.value.han_close(x, y) for s, x, y in zip(p["script"], p["wa"], p["wb"])]]

    near = pairs.mapInPandas(check, "block string, script string, wa string, wb string")
    hits = mine.withColumnRenamed("word", "wa").join(near, ["block", "script", "wa"]).join(theirs.withColumnRenamed("word", "wb"), ["block", "script", "wb"]).select("a", "b", "block").distinct()
    only = hits.groupBy("a").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo = hi").select("a")
    return hits.join(only, "a").select("a", "b", "block")


def entity_pairs(resolved: DataFrame) -> DataFrame:
    """All pairs of entries of one entity, smaller first."""
    a = resolved.select("work_id", "entity", F.col("entry_id").alias("entry_a"))
    b = resolved.select("work_id", "entity", F.col("entry_id").alias("entry_b"))
    return a.join(b, ["work_id", "entity"]).where("entry_a < entry_b").select("entry_a", "entry_b")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bounded_rows(table(spark, sf_dir, "script_map").where("trad is not null and simp is not null"), 200_000, "script_map")
    to_simplified = {ord(r.trad): r.simp for r in rows}
    entries = once(table(spark, sf_dir, "name_map", "entry_id", "work_id", "canonical", "variants"), "entry_id")
    return resolve(entries, to_simplified, learn(entries, to_simplified))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(_resolved(spark, sf_dir))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
ORACLE: dict[str, str] = {}
