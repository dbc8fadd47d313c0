"""Pages of PDF files that are written here, object by object."""

import zlib

import pytest

from boardframe.sources import pages
from boardframe.sources.pages import Document, Page, PdfPages, Reference, Slice, Tokens, Word


def written(objects, tail=b""):
    return b"%PDF-1.7\n%\xe2\xe3\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in objects.items()) + tail


def stream(body, spec=b"", deflate=False):
    raw = zlib.compress(body) if deflate else body
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (spec, b"/Filter /FlateDecode" if deflate else b"", len(raw), raw)


def book(body, more=None, resources=b"", **options):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << " + resources + b" >> >>", 4: stream(body, **options)}
    document = Document(written(objects | (more or {})))
    return Page(document, document.pages()[0])


FONT = {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Roman /FirstChar 32 /Widths [250 500 500] >>"}
USES = b"/Font << /F 5 0 R >>"


def test_tokens():
    tokens = Tokens(b"<< /A 1 /B#20C [2.5 -3 (x\\(y\\)\\n\\101 (in) ]) <4 1f> true null 7 0 R] >> % note\n/N<</D<</E 1>>>>f* Tj")
    assert tokens.value() == {"A": 1, "B C": [2.5, -3, b"x(y)\nA (in) ]", b"A\xf0", True, None, Reference(7)]}
    assert [tokens.value() for _ in range(4)] == ["N", {"D": {"E": 1}}, Word(b"f*"), Word(b"Tj")] and tokens.value() is pages.END
    assert Tokens(b"(cut").value() == b"cut" and Tokens(b"[1 2").value() == [1, 2] and Tokens(b"  ").value() is pages.END


def test_text_positions():
    page = book(b"BT /F 10 Tf 1 0 0 1 20 50 Tm (!\") Tj 0 -20 Td [(!) -1000 (!)] TJ 12 TL T* (!) Tj 5 Tc 200 Tz (!!) ' ET", FONT, USES, deflate=True)
    assert [(round(x, 3), round(y, 3), ch) for _, x, y, *_, ch in page.glyphs] == [(20, 40, "!"), (25, 40, '"'), (20, 60, "!"), (35, 60, "!"), (20, 72, "!"), (20, 84, "!"), (40, 84, "!")]
    assert {(font, size, color) for _, _, _, font, size, color, _ in page.glyphs} == {("Roman", 10, 0)} and [g[0] for g in page.glyphs] == list(range(7))


def test_matrices_colours_and_forms():
    form = stream(b"1 0 0 RG 0 0 10 10 re f", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5]")
    picture = stream(b"\x00" * 4, b"/Type /XObject /Subtype /Image /Width 2 /Height 2")
    page = book(b"q 2 0 0 2 10 10 cm /X Do 0.5 g BT /F 10 Tf (!) Tj ET Q q 30 0 0 40 50 20 cm /I Do Q 0 0 1 rg BT /F 1 Tf (!) Tj ET 1 1 m 2 9 l n", FONT | {6: form, 7: picture}, USES + b" /XObject << /X 6 0 R /I 7 0 R >>")
    assert page.drawings == [(20, 60, 40, 80, 1)]
    assert page.images == [(50, 40, 80, 80, "I")]
    assert [(g[4], g[5]) for g in page.glyphs] == [(20, 0x808080), (1, 255)]


def test_character_tables_and_packed_objects():
    table = stream(b"1 beginbfchar <0001> <265A> endbfchar 1 beginbfrange <0002> <0003> <2655> endbfrange", deflate=True)
    packed = b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Chess /ToUnicode 6 0 R >>"
    more = {6: table, 8: stream(b"5 0 " + packed, b"/Type /ObjStm /N 1 /First 4", deflate=True)}
    page = book(b"BT /F 10 Tf <000100020003> Tj ET", more, USES)
    assert [g[-1] for g in page.glyphs] == ["♚", "♕", "♖"] and page.glyphs[0][3] == "Chess"


def test_paths():
    page = book(b"10 10 m 30 10 l 30 30 l 10 30 l s 0 0 m 1 2 3 4 5 6 c S BI /W 1 ID \x00\x01 EI 0 0 1 1 re B*")
    assert [d[4] for d in page.drawings] == [4, 1, 1] and len(page.images) == 1


def test_refused():
    with pytest.raises(ValueError, match="encrypted"):
        Document(written({1: b"<< >>"}, b"trailer << /Encrypt 9 0 R >>"))
    with pytest.raises(ValueError, match="LZWDecode"):
        book(b"", {4: b"<< /Filter /LZWDecode /Length 1 >>\nstream\nx\nendstream"})
    assert Document(b"no file").pages() == []
    assert book(b"BT (no font) Tj /Missing 9 Tf (x) Tj ET Q 1 2 cm (odd) re").glyphs == []


def test_source(spark, tmp_path, monkeypatch):
    for name in ("a/one.pdf", "two.PDF"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        kids = {10 + k: b"<< /Type /Page /Contents [20 0 R %d 0 R] >>" % (30 + k) for k in range(5)}
        objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [%s] /MediaBox [0 0 200 100] /Resources << %s >> >>" % (b" ".join(b"%d 0 R" % k for k in kids), USES), 20: stream(b"BT /F 10 Tf 1 0 0 1 20 50 Tm"), **{30 + k: stream(b"(%d) Tj ET" % k) for k in range(5)}}
        (tmp_path / name).write_bytes(written(objects | kids | FONT))
    (tmp_path / "note.txt").write_text("x")
    spark.dataSource.register(PdfPages)
    rows = spark.read.format("pdf_pages").load(f"file://{tmp_path}").collect()
    assert sorted((r["file"].rpartition("/")[2], r["page"], r["ch"]) for r in rows) == sorted((f, k, str(k)) for f in ("one.pdf", "two.PDF") for k in range(5))
    assert spark.read.format("pdf_pages").option("table", "pages").load(f"file://{tmp_path}/two.PDF").select("width", "height").distinct().collect() == [(200.0, 100.0)]
    with pytest.raises(Exception, match="no table"):
        spark.read.format("pdf_pages").option("table", "words").load(f"file://{tmp_path}").collect()
    monkeypatch.setattr(pages, "SLICE", 300)
    reader = PdfPages({"path": f"file://{tmp_path}", "table": "glyphs"}).reader(None)
    parts = reader.partitions()
    assert len(parts) > 6 and all(isinstance(p, Slice) for p in parts)
    assert sorted((r[0].rpartition("/")[2], r[1], r[-1]) for p in parts for r in reader.read(p)) == sorted((r["file"].rpartition("/")[2], r["page"], r["ch"]) for r in rows)
