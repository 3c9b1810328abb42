"""Files written from results (K1-K4, K6-K10, K14, K15): JSON, pages, books, summaries.

The part that grows with the data is a DataFrame; what is packaged on the driver is one
document, whose rows come in order through an iterator.
"""

from __future__ import annotations

import json
import textwrap
import zipfile
from collections.abc import Iterator
from html import escape
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIMETYPE = "application/epub+zip"


def write_json(df: DataFrame, path: str) -> None:
    """K1: one object a line, over as many files as partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_file(df: DataFrame, path: str, name: str | None = None) -> None:
    """K1, K7: one indented file, wrapped in a module if a name is given; a row at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"module.exports = {{ {name}: [" if name else "[")
        some = False
        for r in df.toJSON().toLocalIterator():
            out.write((",\n" if some else "\n") + textwrap.indent(json.dumps(json.loads(r), ensure_ascii=False, indent=2), "  "))
            some = True
        out.write(("\n" if some else "") + ("] };\n" if name else "]\n"))


def replace_store(df: DataFrame, path: str) -> None:
    """Overwrites a stored table."""
    df.write.mode("overwrite").parquet(path)


def review_rows(pairs: DataFrame, chapter: str, full: bool = False, most: int = 12) -> DataFrame:
    """K4: the first pairs of each chapter, or all, with a mark on costly ones."""
    w = Window.partitionBy(chapter).orderBy("pair")
    rows = pairs.withColumn("warn", F.coalesce(F.col("cost") > 0.55, F.lit(False)))
    return rows if full else rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def page(title: str, body: str, lang: str = "en") -> str:
    """An XHTML page."""
    return (
        f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{lang}" lang="{lang}">'
        f'<head><meta charset="utf-8"/><title>{escape(title)}</title></head><body>{body}</body></html>')


def review_page(rows: Iterator, title: str) -> str:
    body = "".join(
        f'<tr class="{"warn" if r.warn else ""}"><td>{escape(" ".join(r.ref))}</td><td>{escape(" ".join(r.target))}</td><td>{"" if r.cost is None else round(r.cost, 4)}</td></tr>' for r in rows)
    return page(title, f"<h1>{escape(title)}</h1><table>{body}</table>")


def alignment_summary(pairs: DataFrame, chapter: str) -> DataFrame:
    """Units and rows by chapter, and in all, with the costly rows."""
    return pairs.rollup(chapter).agg(
        F.sum(F.size("ref")).alias("ref_units"), F.sum(F.size("target")).alias("target_units"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cost") > 0.55).alias("costly"))


def summary_markdown(summary: DataFrame, chapter: str) -> str:
    rows = summary.orderBy(F.col(chapter).asc_nulls_first()).collect()  # a row for each chapter
    head = f"| {chapter} | ref units | target units | rows | costly |\n| ---: | ---: | ---: | ---: | ---: |\n"
    return head + "".join(f"| {'all' if r[chapter] is None else r[chapter]} | {r.ref_units} | {r.target_units} | {r.rows} | {r.costly} |\n" for r in rows)


LAYOUTS = ("columns", "alternating", "mixed")


def chapter_body(pairs: list, layout: str) -> str:
    """K2: aligned rows side by side, row after row, or text by text."""
    if layout not in LAYOUTS:
        raise ValueError(layout)
    out = []
    for p in pairs:
        a = [f'<p class="ref">{escape(t)}</p>' for t in p.ref]
        b = [f'<p class="target">{escape(t)}</p>' for t in p.target]
        if layout == "columns":
            out.append(f'<div class="pair"><div>{"".join(a)}</div><div>{"".join(b)}</div></div>')
        elif layout == "alternating":
            out += a + b
        else:
            out += [x for k in range(max(len(a), len(b))) for x in (*a[k : k + 1], *b[k : k + 1])]
    return "".join(out)


def write_book(pairs: DataFrame, chapter: str, path: str, title: str, layout: str = "columns", identifier: str = "urn:folioloom:book") -> None:
    """An EPUB with a document for each chapter, in order; mimetype first and stored."""
    files: list[tuple[int, str]] = []
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', zipfile.ZIP_DEFLATED)
        now, rows = None, []

        def flush() -> None:
            if rows:
                name = f"chapter{now:02d}.xhtml"
                z.writestr(f"OEBPS/{name}", page(f"{title} {now}", f"<h1>{now}</h1>" + chapter_body(rows, layout)), zipfile.ZIP_DEFLATED)
                files.append((now, name))

        for r in pairs.orderBy(chapter, "pair").toLocalIterator():
            if r[chapter] != now:
                flush()
                now, rows = r[chapter], []
            rows.append(r)
        flush()
        items = "".join(f'<item id="c{n}" href="{f}" media-type="application/xhtml+xml"/>' for n, f in files)
        order = "".join(f'<itemref idref="c{n}"/>' for n, _ in files)
        nav = "".join(f'<li><a href="{f}">{n}</a></li>' for n, f in files)
        points = "".join(f'<navPoint id="n{n}" playOrder="{k}"><navLabel><text>{n}</text></navLabel><content src="{f}"/></navPoint>' for k, (n, f) in enumerate(files, 1))
        z.writestr("OEBPS/nav.xhtml", page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>'), zipfile.ZIP_DEFLATED)
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>', zipfile.ZIP_DEFLATED)
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>zh</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{order}</spine></package>', zipfile.ZIP_DEFLATED)


def check_book(path: str) -> None:
    """Mimetype first, stored and exact; every XML member well formed."""
    with zipfile.ZipFile(path) as z:
        first = z.infolist()[0]
        if first.filename != "mimetype" or first.compress_type != zipfile.ZIP_STORED or z.read("mimetype").decode() != MIMETYPE:
            raise ValueError("mimetype must come first and be stored")
        for n in z.namelist():
            if n.endswith((".xhtml", ".opf", ".ncx", ".xml")):
                ElementTree.fromstring(z.read(n))
