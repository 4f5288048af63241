"""DOCX files that the test writes itself."""

import zipfile

from papyra.sources import docx

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style=""):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def save(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")


def test_read(spark, tmp_path):
    cell = lambda *x: f"<w:tc>{''.join(map(p, x))}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(f'a{i}')}{cell(f'b{i}', 'more')}</w:tr>" for i in range(3)) + "</w:tbl>"
    save(tmp_path / "1.docx", p("Title &amp; more", "Heading1") + table + p("end"))
    save(tmp_path / "2.docx", p("") + p(" "))
    (tmp_path / "3.docx").write_bytes(b"garbage")
    (tmp_path / "4.docx").write_bytes(b"")
    got = docx.read_docx(spark, f"file://{tmp_path}/*.docx").cache()
    one = got.where("path like '%1.docx'").orderBy("pos").collect()
    assert [(r.kind, r.table, r.row, r.col, r.text) for r in one][:3] == [("paragraph", None, None, None, "Title & more"), ("cell", 0, 0, 0, "a0"), ("cell", 0, 0, 1, "b0\nmore")]
    assert len(one) == 8 and one[0].style == "Heading1" and one[-1].text == "end"
    assert sorted((r.path[-6], r.status) for r in got.where("status != 'OK'").collect()) == [("2", "OCR_REQUIRED"), ("3", "FAILED")]  # none of 4, which has no bytes
    assert [r.text for r in docx.fragments(got).orderBy("pos").collect()] == ["Title & more", "a0 | b0\nmore", "a1 | b1\nmore", "a2 | b2\nmore", "end"]


def test_damaged_files_fail_one_by_one(spark, tmp_path):
    """A file with flipped bytes gives a FAILED row or what can still be read; no job fails."""
    save(tmp_path / "ok.docx", p("text " * 200))
    whole = (tmp_path / "ok.docx").read_bytes()
    for k in range(40):
        at = 30 + k * (len(whole) - 60) // 40
        (tmp_path / f"d{k}.docx").write_bytes(whole[:at] + bytes(255 - b for b in whole[at : at + 8]) + whole[at + 8 :])
    got = {r.path.rsplit("/", 1)[1]: r.status for r in docx.read_docx(spark, f"file://{tmp_path}/*.docx").collect()}
    assert len(got) == 41 and got["ok.docx"] == "OK" and list(got.values()).count("FAILED") > 10


def test_merged_cells_stand_at_each_place(spark, tmp_path):
    tc = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    rows = [tc("wide", '<w:gridSpan w:val="2"/>') + tc("c"), tc("tall", '<w:vMerge w:val="restart"/>') + tc("x") + tc("y"), tc("", "<w:vMerge/>") + tc("z") + tc("u")]
    box = "<w:p><w:r><w:t>seen</w:t><w:pict><w:txbxContent>" + p("box") + "</w:txbxContent></w:pict></w:r></w:p>"
    save(tmp_path / "m.docx", "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>" + box)
    got = docx.read_docx(spark, f"file://{tmp_path}/m.docx").orderBy("pos").collect()
    assert [(r.row, r.col, r.text) for r in got if r.kind == "cell"] == [(0, 0, "wide"), (0, 1, "wide"), (0, 2, "c"), (1, 0, "tall"), (1, 1, "x"), (1, 2, "y"), (2, 0, "tall"), (2, 1, "z"), (2, 2, "u")]
    assert got[-1].text == "seen"
