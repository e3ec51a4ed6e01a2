"""Reading PDFs that are written here."""

import zlib

from pyspark.sql import functions as F

from dossier.operators import redaction
from dossier.sources import pdf


def document(*contents: bytes, deflate: bool = False, page: bytes = b"", info: bytes = b"<< /Title (A \\(small\\) report) /CreationDate (D:20240102) >>") -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /MediaBox [0 0 600 800] /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(contents))) + b"] /Count %d >>" % len(contents), b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250] >>", info]
    for k, body in enumerate(contents):
        raw = zlib.compress(body) if deflate else body
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R %s >>" % (6 + 2 * k, page))
        objects.append(b"<< /Length %d %s >>\nstream\n" % (len(raw), b"/Filter /FlateDecode" if deflate else b"") + raw + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 4 0 R >>\n"


PAGE = b"BT /F1 10 Tf 100 700 Td (Jane Roe) Tj 0 -20 Td [(sp) -20 (lit)] TJ ET 0 g 95 695 60 16 re f 3 Tr BT /F1 10 Tf 100 600 Td (unseen) Tj ET"


def test_pages_glyphs_and_order():
    for deflate in (False, True):
        meta, (page,) = pdf.read(document(PAGE, deflate=deflate))
        assert meta == {"title": "A (small) report", "created": "D:20240102"}
        assert "".join(g[1] for g in page["glyphs"]) == "Jane Roesplitunseen" and page["media"] == [0, 0, 600, 800]
        (rect,) = page["rects"]
        assert rect[1:5] == (95, 695, 155, 711) and rect[0] == 14 and rect[5] == [0.0]
        assert [g[7] for g in page["glyphs"]] == [False] * 13 + [True] * 6


def test_files_as_tables(spark):
    files = [("a.pdf", document(PAGE, PAGE)), ("b.pdf", document(PAGE, page=b"/Rotate 90")), ("c.pdf", b"no pdf"), ("d.pdf", b"%PDF-1.4 broken " * 50), ("e.pdf", document(b"BT (no font) Tj [ ( q Q Q << ET"))]
    read = pdf.pages(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"))
    rows = {(r.path, r.page): r for r in read.select("path", "page", "n_pages", "width", "height", "error").collect()}
    assert set(rows) == {("a.pdf", 1), ("a.pdf", 2), ("b.pdf", 1), ("c.pdf", None), ("e.pdf", 1)}
    assert (rows["b.pdf", 1].width, rows["b.pdf", 1].height) == (800, 600) and "no PDF" in rows["c.pdf", None].error and rows["a.pdf", 2].n_pages == 2
    glyphs, rects = pdf.glyphs(read.where("path = 'a.pdf'")), pdf.rectangles(read.where("path = 'a.pdf'"))
    texts = [r.text for r in pdf.words(glyphs.where("page = 1")).orderBy("pos").collect()]
    assert texts == ["Jane", "Roe", "split", "unseen"]
    found = redaction.findings(redaction.wiped(redaction.hidden(glyphs, rects)))
    assert {(r.page, r.text) for r in found.collect()} == {(1, "Jane Roe"), (2, "Jane Roe")}
    hidden = redaction.hidden(glyphs.withColumn("seq", F.lit(99)), rects)
    assert hidden.count() == 16  # painted after the box, but in its colour: eight glyphs on each page
