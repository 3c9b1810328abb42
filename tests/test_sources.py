import io
import struct
import zipfile

import pytest

from folioloom.sources import archives as Z
from folioloom.sources import blocks as H
from folioloom.sources import files as L
from folioloom.sources import sinks as K
from tests.conftest import rows


@pytest.mark.parametrize("html, dialect, want", [
    ("<p>lost</p><body><div>a<p>b</p>c</div></body>", "book", ["a", "b", "c"]),
    ("<body><div>a<p>b</p>c</div></body>", "translation", ["b", "ac"]),
    ("<body><p>one<p>two</p></body>", "book", ["two", "one"]),
    ("<body><p>never closed", "book", []),
    ("<body><div><h1>t</h1></p>x</div></body>", "book", ["t", "x"]),
    ("<body><div>a<h1>t</div>b</h1></body>", "extract", ["t", "ab"]),
    ("<body><p>a<br/>b <sup>1</sup><a>link</a></p><ul><li>x</li></ul></body>", "translation", ["a b"]),
    ("<body><p>a<br/>b</p><ul><li>x &amp; y</li></ul></body>", "extract", ["a\nb", "x & y"]),
    ("<body><p>[插图] 甲 乙</p></body>", "book", ["甲 乙"]),
    ("", "book", []), (None, "book", []),
])
def test_blocks(html, dialect, want):
    assert H.blocks_of(html, dialect) == want


def archive(names=("OEBPS/b.xhtml", "OEBPS/a.xhtml")):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="OEBPS/p.opf"/></c>')
        items = "".join(f'<item id="i{k}" href="{n.split("/")[1]}"/>' for k, n in enumerate(names))
        z.writestr("OEBPS/p.opf", f'<package xmlns="u"><manifest>{items}</manifest><spine>' + "".join(f'<itemref idref="i{k}"/>' for k in range(len(names))) + '<itemref idref="none"/></spine></package>')
        for n in names:
            z.writestr(n, f"<html><body><p>{n}</p></body></html>")
        z.writestr("raw.txt", "plain", zipfile.ZIP_STORED)
    return out.getvalue()


def test_damaged_archive_is_salvaged():
    whole = archive()
    cut = whole[: whole.rindex(b"PK\x01\x02") - 0][: whole.index(b"PK\x01\x02")]
    found, warning = Z.members(cut)
    assert warning == Z.DAMAGED and found == Z.members(whole)[0]
    start = struct.unpack("<I", whole[whole.index(b"PK\x01\x02") + 42 :][:4])[0]
    assert start == 0 and Z.salvage(b"junk" + cut) == found and Z.salvage(b"") == {}


def test_spine_order(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(archive())
    (tmp_path / "b.epub").write_bytes(archive(("OEBPS/z.xhtml",)))
    got = rows(Z.read_spine(spark, str(tmp_path)).select("pos", "entry"))
    assert got == [(0, "OEBPS/b.xhtml"), (0, "OEBPS/z.xhtml"), (1, "OEBPS/a.xhtml")]
    assert Z.read_members(spark, str(tmp_path / "a.epub")).where("entry = 'raw.txt'").first().content == b"plain"


def test_contents_and_links():
    ncx = b'<ncx xmlns="u"><navPoint><navLabel><text> Chapter  1 </text></navLabel><content src="a.html#x"/></navPoint></ncx>'
    assert Z.contents(ncx) == [("a.html", "Chapter 1")]
    assert Z.toc_links(b'<body><a href="../t/a.html">A <b>b</b></a><a>no</a></body>', "text/x") == [("text/t/a.html", "A b")]


def test_pages_by_outline(spark):
    pages = spark.createDataFrame([("b", 1, "12\n引子"), ("b", 2, "甲\n\n20240101"), ("b", 3, "乙"), ("b", 4, "丙")], "book string, page int, text string")
    toc = spark.createDataFrame([("b", 2, "第一章"), ("b", 4, "第二章"), ("b", 3, "插页")], "book string, page int, title string")
    assert rows(Z.page_chapters(pages, toc).select("chapter", "href", "blocks")) == [(1, "pdf-pages-002-003", ["甲", "乙"]), (2, "pdf-pages-004-004", ["丙"])]
    assert rows(Z.page_documents(pages).select("href", "blocks"))[0] == ("page-001", ["引子"])


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "d.js").write_text('// x\nwindow.DATA = {"a": [1, 2],\n "b": "甲"};\n')
    assert L.read_assigned(spark, str(tmp_path / "d.js"), "DATA", "a array<int>, b string").first() == ([1, 2], "甲")
    with pytest.raises(Exception):
        L.read_assigned(spark, str(tmp_path / "d.js"), "OTHER", "a array<int>").collect()
    (tmp_path / "a.txt").write_text("x1\nx2\n")
    (tmp_path / "b.txt").write_text("y1\ny2")
    lines = L.read_lines(spark, {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "b.txt")})
    assert rows(L.lines_side_by_side(lines, ["a", "b"])) == [(1, "x1", "y1"), (2, "x2", "y2")]
    (tmp_path / "j.json").write_text('[{"k": 1}, {"k": 2}]')
    assert rows(L.read_json(spark, str(tmp_path / "j.json"), "k int")) == [(1,), (2,)]
    v = spark.createDataFrame([("a", str(tmp_path / "a.txt"), None), ("b", None, "BOOK"), ("c", None, "NONE"), ("d", None, None)], "id string, source_path string, source_path_env string")
    got = rows(L.resolve_paths(v, {"d": "/nowhere"}, {"BOOK": str(tmp_path / "b.txt")}))
    assert [(r[0], r[2]) for r in got] == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert L.stored_or_empty(spark, str(tmp_path / "missing"), "a int").count() == 0


def test_body_documents_by_chapter_number(spark):
    docs = [("v", i, f"x{i}.html", 6000, (i - 1) // 2 + 1) for i in range(1, 41)] + [("v", 0, "cover.html", 9000, 1), ("v", 50, "y.html", 10, 2)]
    df = spark.createDataFrame(docs, "v string, i int, href string, char_count int, c int")
    from pyspark.sql import functions as F

    assert [r.i for r in L.body_documents(df, "v", "i", F.col("c")).orderBy("i").collect()] == list(range(1, 40, 2))
    assert L.body_documents(df.where("i < 11"), "v", "i", F.col("c")).count() == 10


@pytest.mark.parametrize("layout", K.LAYOUTS)
def test_book_round_trip(spark, tmp_path, layout):
    pairs = spark.createDataFrame([(2, 1, ["甲 < 乙"], ["A & B", "C"], 0.7), (1, 1, ["丙"], [], 0.0)], "chapter int, pair int, ref array<string>, target array<string>, cost double")
    path = str(tmp_path / "b.epub")
    K.write_book(pairs, "chapter", path, "T & t", layout)
    K.check_book(path)
    found, _ = Z.members(open(path, "rb").read())
    assert Z.spine(found, Z.package_path(found)) == ["OEBPS/chapter01.xhtml", "OEBPS/chapter02.xhtml"]
    text = H.blocks_of(found["OEBPS/chapter02.xhtml"].decode(), "translation")
    assert {"甲 < 乙", "A & B", "C"} <= set(" ".join(text).replace("乙A", "乙 A").replace("BC", "B C").split("|")) or {"甲 < 乙", "A & B", "C"} <= set(text)


def test_summary_and_review(spark, tmp_path):
    pairs = spark.createDataFrame([(1, k, ["a"], ["b", "c"], 0.1 * k) for k in range(1, 15)], "chapter int, pair int, ref array<string>, target array<string>, cost double")
    assert K.review_rows(pairs, "chapter").count() == 12 and K.review_rows(pairs, "chapter", True).count() == 14
    md = K.summary_markdown(K.alignment_summary(pairs, "chapter"), "chapter")
    assert "| all | 14 | 28 | 14 | 9 |" in md
    assert "<td>a</td>" in K.review_page(iter(K.review_rows(pairs, "chapter").collect()), "x")
    K.write_json_file(pairs.limit(1), str(tmp_path / "m.js"), "rows")
    assert (tmp_path / "m.js").read_text().startswith("module.exports = { rows: [")
