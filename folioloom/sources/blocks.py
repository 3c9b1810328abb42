"""Text blocks of HTML documents in the three dialects the pipelines use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dialect:
    """Which tags make a block, which are skipped with all they hold, and how blocks end.

    `match_end`: an end tag closes down to its own start; else it closes the innermost block.
    `p_flushes_div`: the text so far of an open div is a block of its own before a paragraph.
    """

    blocks: frozenset[str]
    skipped: frozenset[str]
    line: str
    match_end: bool = False
    p_flushes_div: bool = False
    keep_lines: bool = False
    dropped: tuple[str, ...] = ()


def _tags(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Fixed values of the dialects.
DIALECTS = {
    "book": Dialect(_tags("p div h1 h2 h3 h4 h5 h6"), _tags("head style script title ul ol table sup sub"), " ", True, True, False, ("[插图]",)),
    "translation": Dialect(_tags("p div"), _tags("head style script title aside sup sub a table ol ul"), " "),
    "extract": Dialect(_tags("p div h1 h2 h3 h4 li"), _tags("head style script title svg math table"), "\n", keep_lines=True),
}


START, END, TEXT = "start", "end", "text"


class _Tokens(HTMLParser):
    """A document as (kind, value, target of a link), in order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str | None]] = []
        self.feed(html)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.found.append((START, tag, next((v for k, v in attrs if k == "href"), None)))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((END, tag, None))

    def handle_data(self, data: str) -> None:
        self.found.append((TEXT, data, None))


def shown(html: str, d: Dialect) -> Iterator[tuple[str, str]]:
    """The tokens of the body that aren't within a skipped tag; the body's ends stay."""
    inside, depth = False, 0
    for kind, value, _ in _Tokens(html).found:
        if kind != TEXT and value == "body":
            inside = kind == START
            if not inside:
                yield kind, value
        elif inside and kind != TEXT and value in d.skipped:
            depth = depth + 1 if kind == START else max(0, depth - 1)
        elif inside and not depth:
            yield kind, value


def tidy(parts: list[str], d: Dialect) -> str:
    text = reduce(lambda t, x: t.replace(x, ""), d.dropped, "".join(parts).replace("\u00a0", " "))
    if d.keep_lines:
        return re.sub(r"\n+", "\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()
    return " ".join(text.split())


def ending(open_: list[tuple[str, list[str]]], tag: str, d: Dialect) -> int:
    """How many of the open blocks stay open at an end tag."""
    if tag == "body":
        return 0
    if tag not in d.blocks:
        return len(open_)
    if not d.match_end:
        return max(len(open_) - 1, 0)
    own = [i for i, (t, _) in enumerate(open_) if t == tag]
    return own[-1] if own else len(open_)


def blocks_of(html: str | None, dialect: str) -> list[str]:
    """Blocks in the order in which they end; one that is still open when the text stops is lost."""
    d, open_, ended = DIALECTS[dialect], [], []
    for kind, value in shown(html or "", d):
        if kind == END:
            stay = ending(open_, value, d)
            ended += [parts for _, parts in reversed(open_[stay:])]
            open_ = open_[:stay]
        elif kind == START and value in d.blocks:
            if d.p_flushes_div and value == "p" and open_ and open_[-1][0] == "div":
                ended.append(open_[-1][1])  # the div goes on with a block of its own
                open_[-1] = ("div", [])
            open_.append((value, []))
        elif open_ and (kind == TEXT or value == "br"):
            open_[-1][1].append(value if kind == TEXT else d.line)
    return [text for parts in ended if (text := tidy(parts, d))]


def links_of(html: str | None) -> list[tuple[str, str]]:
    """(href, label) of every link: the text from its start to the next end of a link."""
    found: list[tuple[str, str]] = []
    href, label = None, ""
    for kind, value, target in _Tokens(html or "").found:
        if kind == START and value == "a" and target:
            href, label = target, ""
        elif kind == TEXT:
            label += value
        elif kind == END and value == "a" and href is not None:
            found.append((href, " ".join(label.split())))
            href = None
    return found


def read_blocks(pages: DataFrame, key: str, html: str, dialect: str) -> DataFrame:
    """(key, idx, text): the blocks of a column of documents, from 1."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            found = [(k, i, t) for k, h in zip(b[key], b[html]) for i, t in enumerate(blocks_of(h, dialect), 1)]
            yield pd.DataFrame(found, columns=[key, "idx", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, idx int, text string")
