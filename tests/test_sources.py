"""PDF files, page images and recognition."""

import base64
import json
import zlib

import numpy as np
import pytest

from quire import session
from quire.operators import convert
from quire.sources import ocr, pdf, settings

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"


def file_of(contents, font=FONT, more=None, rotate=0, packed=False):
    """A PDF file with a page for each content; objects in an object stream if packed."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font, **(more or {})}
    streams_, kids, n = {}, [], 20
    for c in contents:
        data = zlib.compress(c)
        streams_[n] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Rotate %d >>" % (n, rotate)
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    objects[2] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> /XObject << /X 4 0 R >> >> /Kids [" + b" ".join(kids) + b"] >>"
    objects[n] = rb"<< /Title (A \(b\) title) /Author <FEFF0041006E006E> >>"
    for k in [k for k, v in objects.items() if b"stream" in v]:
        streams_[k] = objects.pop(k)
    if packed:
        places, body = [], b""
        for k, v in objects.items():
            places.append(b"%d %d" % (k, len(body)))
            body += v + b" "
        head = b" ".join(places) + b" "
        data = zlib.compress(head + body)
        streams_[n + 1] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(objects), len(head), len(data), data)
        objects = {}
    every = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (objects | streams_).items())
    return b"%PDF-1.5\n" + every + b"trailer << /Root 1 0 R /Info %d 0 R >>\n%%%%EOF" % n


def words(data):
    return [[(w[0], w[1], *w[2:6], w[7]) for w in page[2]] for page in pdf.decode(data)[1]]


@pytest.mark.parametrize("packed", [False, True])
def test_decode(packed):
    data = file_of([b"BT /F1 10 Tf 50 700 Td (Hello wor) Tj (ld) Tj 0 -12 Td [(sec) -10 (ond) -800 (li\\156e)] TJ ET", b""], packed=packed)
    assert pdf.decode(data)[0] == {"title": "A (b) title", "author": "Ann"}
    first, second = words(data)
    assert second == [] and [w[:2] for w in first] == [(0, "Hello"), (0, "world"), (1, "second"), (1, "line")]
    assert first[0][2:] == (50.0, 92.5, 80.0, 102.5, 0) and first[1][2] == 86.0 and first[3][2] == pytest.approx(94.1)


def test_turned_pages():
    hi = b"BT /F1 10 Tf 50 700 Td (Hi) Tj ET"
    assert words(file_of([hi], rotate=90)) == [[(0, "Hi", 697.5, 50.0, 707.5, 62.0, 90)]]
    assert words(file_of([hi], rotate=180)) == [[(0, "Hi", 538.0, 697.5, 550.0, 707.5, 180)]]
    assert words(file_of([b"BT /F1 10 Tf 0 1 -1 0 300 400 Tm (Up) Tj ET"]))[0][0][6] == 270


def test_forms_and_composite_fonts():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>"
    form = b"BT /F1 10 Tf 10 10 Td <000100020003> Tj ET"
    more = {
        4: b"<< /Subtype /Form /Matrix [1 0 0 1 100 0] /Length %d >>\nstream\n%s\nendstream" % (len(form), form),
        5: b"<< /Subtype /CIDFontType2 /DW 500 /W [1 [1000 250]] >>", 6: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
    }
    assert words(file_of([b"q 2 0 0 2 0 0 cm /X Do Q"], font, more))[0] == [(0, "Abc", 220.0, 765.0, 255.0, 785.0, 0)]


def test_differences_and_filters():
    font = b"<< /Subtype /Type1 /BaseFont /Other /FirstChar 65 /Widths [600 600] /Encoding << /Differences [65 /fi /uni00E9 67 /odd] >> >>"
    assert [w[1] for w in words(file_of([b"BT /F1 10 Tf (ABC) Tj ET"], font))[0]] == ["ﬁé"]
    inner = base64.a85encode(b"BT /F1 10 Tf (x) Tj ET") + b"~>"
    data = file_of([]).replace(b"/Kids []", b"/Kids [9 0 R]").replace(b"trailer", b"9 0 obj << /Type /Page /Contents 10 0 R >> endobj\n10 0 obj << /Filter [/A85] /Length 11 0 R >> stream\n" + inner + b"\nendstream endobj\ntrailer")
    assert [w[1] for w in words(data)[0]] == ["x"]
    rows = bytes([2, 1, 2, 2, 1, 1, 1, 5, 1])
    assert pdf.predicted(rows, {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3, 5, 6])


def test_decoded(spark):
    rows = [("a.pdf", file_of([b"BT /F1 10 Tf 50 700 Td (  caf\\351 ) Tj ET", b""])), ("b.pdf", b"none"), ("c.pdf", None), ("d.pdf", file_of([]).replace(b"/Info", b"/Encrypt 1 0 R /Info"))]
    got = pdf.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r.page, r.text) for r in got if not r.error] == [("a.pdf", 0, "café"), ("a.pdf", 1, None)]
    assert {r.path: r.error for r in got if r.error} == {"b.pdf": "ValueError: not a PDF file", "c.pdf": "ValueError: not a PDF file", "d.pdf": "ValueError: encrypted"}
    assert pdf.normalized_boxes(pdf.raw_boxes(pdf.decoded(spark.createDataFrame(rows, "path string, content binary")))).count() == 1


def page_of(lines, x=50):
    return b"BT /F1 9 Tf 14 TL %d 700 Td " % x + b" ".join(b"(%s) '" % t.encode() for t in lines) + b" ET"


def test_convert_pdf(spark, tmp_path):
    (tmp_path / "in").mkdir()
    front = ["Abstract", "We study exam-", "ples of things that are told in", "more than a few words here.", "1 Results", "All is well, as it was said be-"]
    (tmp_path / "in/a.PDF").write_bytes(file_of([page_of(front), page_of(["fore in many words that go on for a while", "and are not few either."])]))
    (tmp_path / "in/bad.pdf").write_bytes(b"none")
    out = str(tmp_path / "out")
    assert session.main(["convert", str(tmp_path / "in"), "-o", out], spark) == 2
    md = (tmp_path / "out/a.md").read_text()
    assert md.startswith("---\ntitle: A (b) title\nauthors:\n  - Ann\n")
    assert md.endswith("# Abstract\n\nWe study examples of things that are told in more than a few words here.\n\n# 1 Results\n\nAll is well, as it was said before in many words that go on for a while and are not few either.\n\n")
    assert json.loads((tmp_path / "out/run-reports/a.stats.json").read_text())["pages"] == 2


def test_settings_take_effect(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Abstract\nWe study things.\nKeywords\none, two\n")
    settings.save(settings.Heuristics(keywords_as_h2=False), str(tmp_path / "h.json"))
    for name, more, mark in (("x", [], "\n## Keywords\n"), ("y", ["--heuristics", str(tmp_path / "h.json")], "\n# Keywords\n")):
        assert session.main(["convert", str(tmp_path / "a.txt"), "-o", str(tmp_path / name), *more], spark) == 0
        assert mark in (tmp_path / name / "a.md").read_text()


def image(rows):
    """Dark where a row has an x."""
    return b"".join(b"".join(b"\x00\x00\x00\xff" if c == "x" else b"\xff\xff\xff\xff" for c in r) + b"\0\0" for r in rows)


def test_images(spark):
    asked = spark.createDataFrame([(1, 0, b"p"), (1, 1, b"q"), (2, 0, b"bad")], "doc_id long, page int, content binary").repartition(1)

    dark, light = image(["....", ".xx.", "...."]), image(["...."] * 3)

    def drawer():
        def draw(content, page, dpi):
            if content == b"bad":
                raise OSError("no page")
            return light if page else dark, 4, 3, 18

        return draw

    images = ocr.drawn(asked, drawer, 100)
    assert {(r.doc_id, r.page): r.error for r in images.collect()} == {(1, 0): None, (1, 1): None, (2, 0): "OSError: no page"}
    got = {r.page: (r.x0, r.y0, r.x1, r.y1, r.skew) for r in ocr.measured(images).collect()}
    assert got == {0: (1, 1, 3, 2, 0.0), 1: (None, None, None, None, 0.0)}
    read = ocr.recognised(images, lambda: lambda rgba, dpi: f"\n one {int((rgba[:, :, 0] == 0).sum())} \n\n two\n", 100).orderBy("page", "line_no").collect()
    assert [(r.page, r.line_no, r.text, r.y0, r.x1) for r in read] == [(0, 0, "one 2", 0.0, 4.0), (0, 1, "two", 14.0, 4.0), (1, 0, "one 0", 0.0, 4.0), (1, 1, "two", 14.0, 4.0)]


def test_skew(spark):
    dark = np.full((200, 300, 4), 255, np.uint8)
    for y in range(20, 160, 20):
        for x in range(300):
            dark[int(y + x * np.tan(np.radians(2.0))) : int(y + x * np.tan(np.radians(2.0))) + 4, x, :3] = 0
    rows = spark.createDataFrame([(1, 0, dark.tobytes(), 300, 200, 1200, None)], ocr.IMAGE)
    assert abs(ocr.measured(rows).collect()[0].skew - 2.0) <= 0.25


def test_recognised_pages(spark):
    lines = spark.createDataFrame([(1, 0, "scan", 0, "w�rd " * 9), (1, 1, "scan", 0, "good words all over this page of nine")], "doc_id long, page int, family string, line_no int, text string")
    read = spark.createDataFrame([(1, p, 0, "these are nine words that were read by it") for p in (0, 1, 2)], "doc_id long, page int, line_no int, text string")
    asked = spark.createDataFrame([(1, 0, "candidate", "scan"), (1, 1, "candidate", "scan"), (1, 2, "direct", "scan")], "doc_id long, page int, kind string, family string")
    got = {r.page: r.text[:5] for r in convert.with_recognised(lines, read, asked).collect()}
    assert got == {0: "these", 1: "good ", 2: "these"}
