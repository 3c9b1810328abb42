"""E-book archives (S1-S6, S11, S12, S21): members, damaged archives, spine, contents, pages.

Archives come through Spark's binaryFile source; members are read where the archive is.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import text as N
from folioloom.sources.blocks import links_of

#: Signatures of the parts of an archive: a member's header, the directory at the end, its end.
PART = re.compile(rb"PK(?:\x03\x04|\x01\x02|\x05\x06)")
#: A member's header: signature, version, flags, method, time, date, checksum, sizes stored and whole, lengths of name and extra field.
HEADER = struct.Struct("<4s5H3I2H")
UTF8_NAME = 0x800
DAMAGED = "zip_central_directory_unreadable"


def member_table(data: bytes) -> pd.DataFrame:
    """(header, name, method, body, size) of everything that looks like a member's header."""
    rows = []
    for m in PART.finditer(data):
        if m.group().endswith(b"\x03\x04") and m.start() + HEADER.size <= len(data):
            _, _, flags, method, _, _, _, stored, _, name, extra = HEADER.unpack_from(data, m.start())
            at = m.start() + HEADER.size
            label = data[at : at + name].decode("utf-8" if flags & UTF8_NAME else "cp437", errors="replace")
            rows.append((m.start(), label, method, at + name + extra, stored))
        elif not m.group().endswith(b"\x03\x04"):
            rows.append((m.start(), None, -1, m.start(), 0))
    return pd.DataFrame(rows, columns=["header", "name", "method", "body", "size"])


def unpacked(raw: bytes, method: int) -> bytes:
    """A member's bytes; nothing if it is stored in an unknown way or broken."""
    try:
        return raw if method == 0 else zlib.decompress(raw, -zlib.MAX_WBITS) if method == 8 else b""
    except zlib.error:
        return b""


def salvage(data: bytes) -> dict[str, bytes]:
    """S3: the members by their own headers, up to the directory.

    What looks like a header within a member's bytes is none.  Of members with one name the last counts.
    """
    table = member_table(data)
    found, free = {}, 0
    for header, name, method, body, size in table.itertuples(index=False):
        if header < free:
            continue
        if method < 0:  # the directory begins
            break
        free = body + size
        found[name] = unpacked(data[body:free], method)
    return found


def members(data: bytes) -> tuple[dict[str, bytes], str | None]:
    """All members, and a warning if they had to be salvaged."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in z.namelist()}, None
    except zipfile.BadZipFile:
        return salvage(data), DAMAGED


def package_path(entries: dict[str, bytes]) -> str | None:
    """Where the container says the package is, else the first package file."""
    container = entries.get("META-INF/container.xml")
    if not container:
        return min((n for n in entries if n.endswith(".opf")), key=list(entries).index, default=None)
    named = [e.get("full-path") for e in ElementTree.fromstring(container).findall(".//{*}rootfile")]
    return next(filter(None, named), None)


def package_rows(opf: bytes, package: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(id, entry) of the manifest and (pos, id) of the reading order."""
    root, base = ElementTree.fromstring(opf), posixpath.dirname(package)
    items = [(e.get("id"), posixpath.normpath(posixpath.join(base, e.get("href")))) for e in root.findall(".//{*}item[@href]") if e.get("id")]
    order = [e.get("idref") for e in root.findall(".//{*}itemref[@idref]")]
    return pd.DataFrame(items, columns=["id", "entry"]).drop_duplicates("id", keep="last"), pd.DataFrame({"pos": range(len(order)), "id": order})


def spine(entries: dict[str, bytes], package: str | None) -> list[str]:
    """The members in reading order; references to nothing are left out."""
    if not package or package not in entries:
        return []
    items, order = package_rows(entries[package], package)
    if items.empty or order.empty:
        return []
    return [p for p in order.merge(items, "inner", "id").sort_values("pos")["entry"] if p in entries]


def contents(ncx: bytes) -> list[tuple[str, str]]:
    """(member, label) of the navigation points."""
    out = []
    for point in (e for e in ElementTree.fromstring(ncx).iter() if e.tag.endswith("navPoint")):
        label = next((e.text or "" for e in point.iter() if e.tag.endswith("text")), "")
        src = next((e.get("src") or "" for e in point.iter() if e.tag.endswith("content")), "")
        out.append((src.split("#")[0], " ".join(label.split())))
    return out


def toc_links(html: bytes, base: str) -> list[tuple[str, str]]:
    """Links of a contents page, as paths of members."""
    return [(posixpath.normpath(posixpath.join(base, h.split("#")[0])), label) for h, label in links_of(html.decode("utf-8", errors="replace"))]


def binary_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, entry, content, warning) of archives."""
    return members_of(binary_files(spark, paths))


def members_of(archives: DataFrame) -> DataFrame:
    """The same of (path, content)."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for path, data in zip(b["path"], b["content"]):
                found, warning = members(bytes(data))
                out += [(path, n, c, warning) for n, c in found.items()]
            yield pd.DataFrame(out, columns=["path", "entry", "content", "warning"])

    return archives.select("path", "content").mapInPandas(run, "path string, entry string, content binary, warning string")


_PARTS = "path string, kind string, key string, pos int, entry string, html string"


def read_spine(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, pos, entry, html): the documents of archives in reading order (S4, S5); by name if there is no package.

    The reading order, the manifest and the members are rows, and are joined.
    """
    return spine_of(binary_files(spark, paths))


def spine_of(archives: DataFrame) -> DataFrame:
    """The same of (path, content)."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for path, data in zip(b["path"], b["content"]):
                found, _ = members(bytes(data))
                out += [(path, "document", None, None, n, found[n].decode("utf-8", errors="replace")) for n in found if re.search(N.MARKUP_FILE, n.lower())]
                package = package_path(found)
                if package in found:
                    items, order = package_rows(found[package], package)
                    out += [(path, "item", i, None, e, None) for i, e in items.itertuples(index=False)]
                    out += [(path, "order", i, p, None, None) for p, i in order.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "kind", "key", "pos", "entry", "html"]).astype({"pos": "Int32"})

    parts = archives.select("path", "content").mapInPandas(run, _PARTS)
    documents = parts.where("kind = 'document'").select("path", "entry", "html")
    items, order = parts.where("kind = 'item'").select("path", "key", "entry"), parts.where("kind = 'order'").select("path", "key", "pos")
    told = order.join(items, ["path", "key"]).join(documents, ["path", "entry"]).select("path", "pos", "entry", "html")
    w = Window.partitionBy("path")  # the documents of one archive
    untold = documents.join(told.select("path").distinct(), "path", "left_anti").withColumn("pos", F.row_number().over(w.orderBy("entry")))
    every = told.unionByName(untold.select("path", "pos", "entry", "html"))
    return every.withColumn("pos", (F.row_number().over(w.orderBy("pos")) - 1).cast("int"))


def chapter_files(pattern: str, numbers: range) -> list[str]:
    """The fixed names of chapter members."""
    return [pattern % n for n in numbers]


def page_chapters(pages: DataFrame, contents_: DataFrame, chapters: int = 20) -> DataFrame:
    """(book, chapter, href, title, blocks) of extracted pages by their outline.

    `pages` has (book, page, text), `contents_` (book, page, title).  A heading's pages go to the
    page before the next heading.
    """
    w = Window.partitionBy("book").orderBy("page")
    last = pages.groupBy("book").agg((F.max("page") + 1).alias("end"))
    heads = contents_.withColumn("chapter", N.chapter_number(F.col("title"))).where("chapter is not null").withColumn("next", F.lead("page").over(w))
    heads = heads.join(last, "book").withColumn("next", F.coalesce("next", "end")).where(F.col("chapter").between(1, chapters)).withColumnRenamed("page", "first")
    lines = page_lines(pages).select("book", "page", "line", "text")
    inside = heads.join(lines, "book").where("page >= first and page < next")
    return inside.groupBy("book", "chapter", "first", "next", "title").agg(F.sort_array(F.collect_list(F.struct("page", "line", "text"))).alias("b")).select(
        "book", "chapter", F.format_string("pdf-pages-%03d-%03d", "first", F.col("next") - 1).alias("href"), "title", F.col("b.text").alias("blocks"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(book, page, line, text): the lines of a page without numbers and dates."""
    each = pages.select("book", "page", F.posexplode(F.split("text", "\\R")).alias("line", "raw"))
    return each.withColumn("text", N.keep_lines(N.unescape(F.col("raw")))).where((F.col("text") != "") & ~N.is_page_noise(F.col("text"))).drop("raw")


def page_documents(pages: DataFrame) -> DataFrame:
    """One document a page, without a chapter."""
    return page_lines(pages).groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("b")).select(
        "book", F.lit(None).cast("int").alias("chapter"), F.format_string("page-%03d", "page").alias("href"), F.format_string("Page %d", "page").alias("title"), F.col("b.text").alias("blocks"))
