"""PDF files that the test writes itself."""

import zlib

from papyra.sources import documents, pdf


def build(pages, flate=False, cmap=None, packed=False):
    """A file of pages, each a content stream; with ``cmap`` its font has a ToUnicode map."""

    def stream(data):
        data = data.encode("latin-1")
        return b"<< /Length %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(data), zlib.compress(data)) if flate else b"<< /Length %d >> stream\n%s\nendstream" % (len(data), data)

    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)))}
    objects[3] = b"<< /Type /Font /Subtype /Type0%s >>" % (b" /ToUnicode 4 0 R" if cmap else b"")
    if cmap:
        objects[4] = stream(cmap)
    for i, p in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(p)
    out = [b"%PDF-1.7\n"]
    if packed:
        inner = {k: v for k, v in objects.items() if b"stream" not in v}
        objects = {k: v for k, v in objects.items() if b"stream" in v}
        head, body = b"", b""
        for k, v in inner.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        whole = zlib.compress(head + body)
        objects[99] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(inner), len(head), whole)
    out += [b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()]
    return b"".join(out)


PAGE = r"BT /F1 12 Tf 72 700 Td (A title \(one\)) Tj ET BT /F1 10 Tf 14 TL 72 650 Td (First line) Tj T* [(Sec) -20 (ond) -400 (line)] TJ ET BT /F1 10 Tf 1 0 0 1 72 300 Tm (Far \101way) Tj ET"
BLOCKS = ["A title (one)", "First line\nSecond line", "Far Away"]


def test_blocks_in_all_forms():
    for options in ({}, {"flate": True}, {"flate": True, "packed": True}):
        rows = list(pdf.elements(build([PAGE, "BT /F1 9 Tf 10 10 Td (Page two) Tj ET"], **options)))
        assert [(r[0], r[1], r[5]) for r in rows] == [(1, 0, BLOCKS[0]), (1, 1, BLOCKS[1]), (1, 2, BLOCKS[2]), (2, 0, "Page two")]
        assert rows[0][2:5] == (72.0, 700.0, 12.0)


def test_unicode_map():
    cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <9879> endbfchar 1 beginbfrange <0010> <0012> <4e00> endbfrange"
    rows = list(pdf.elements(build(["BT /F1 12 Tf 1 1 Td <000100100012> Tj ET"], cmap=cmap)))
    assert [r[5] for r in rows] == ["项一" + chr(0x4E02)]


def test_files_and_statuses(spark, tmp_path):
    long = "BT /F1 9 Tf 10 10 Td (" + "enough text on this page " * 3 + ") Tj ET"
    (tmp_path / "a.pdf").write_bytes(build([long, long]))
    (tmp_path / "b.pdf").write_bytes(build([long, "", "", ""]))
    (tmp_path / "c.pdf").write_bytes(b"garbage")
    (tmp_path / "d.pdf").write_bytes(build([PAGE]).replace(b"%PDF", b"%PDF") + b"trailer << /Encrypt 5 0 R >>")
    whole = build([long], flate=True)
    for k in range(30):
        at = 10 + k * (len(whole) - 30) // 30
        (tmp_path / f"x{k}.pdf").write_bytes(whole[:at] + bytes(255 - b for b in whole[at : at + 6]) + whole[at + 6 :])
    rows = pdf.read_pdf(spark, f"file://{tmp_path}/*.pdf").cache()
    got = {r.path.rsplit("/", 1)[1]: r.status for r in pdf.statuses(rows).collect()}
    assert len(got) == 34 and [got[f"{c}.pdf"] for c in "abcd"] == ["PARSED", "OCR_REQUIRED", "PARSE_ERROR", "PARSE_ERROR"]


def test_a_folder_of_all_kinds(spark, tmp_path):
    from test_docx import p, save

    (tmp_path / "a.pdf").write_bytes(build(["BT /F1 9 Tf 10 10 Td (enough text on this page for the gate) Tj ET"]))
    save(tmp_path / "b.docx", p("A paragraph with some text"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.xyz").write_bytes(b"anything")
    got = {r.path.rsplit("/", 1)[1]: (r.type, r.status, r.exit_code) for r in documents.statuses(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.pdf": ("pdf", "PARSED", 0), "b.docx": ("docx", "PARSED", 0), "c.docx": ("docx", "PARSE_ERROR", 3), "d.xyz": ("xyz", "UNSUPPORTED_FORMAT", 2)}
    assert sorted(r.text for r in documents.fragments(spark, f"file://{tmp_path}").collect()) == ["A paragraph with some text", "enough text on this page for the gate"]
