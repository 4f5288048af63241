"""Deliveries that are written and read again, word lists, and odd rows of repairs."""

import json

import pytest
from pyspark.sql import functions as F

from papyra.operators import delivery as dl
from papyra.operators import repair as rp
from papyra.sources import lexicon


def test_views_replace_what_an_earlier_run_left(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2,)], "id int")
    dl.write_views({"facts": a, "stale": b}, f"file://{tmp_path}/out")
    dl.write_views({"facts": b, "checks": a}, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["checks", "facts"]
    views = dl.read_views(spark, f"file://{tmp_path}/out", ["facts", "checks"])
    assert [r.id for r in views["facts"].collect()] == [2] and views["checks"].columns == ["id", "t"]
    assert dl.missing_columns(views, {"facts": ["id", "t"], "rows": ["id"], "checks": ["t"]}) == [("facts", "t"), ("rows", "id")]


def test_lexicon(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"strong": ["否决", " 无效 ", "", "否决"], "verbs": ["提供"], "a": ["编号", "甲"], "b": ["编号"]}), encoding="utf-8")
    words = lexicon.rows(spark, f"file://{tmp_path}/w.json")
    assert sorted((r.name, r.word) for r in words.collect()) == [("a", "甲"), ("a", "编号"), ("b", "编号"), ("strong", "否决"), ("strong", "无效"), ("verbs", "提供")]
    assert "编号" not in {r.word for r in lexicon.unambiguous(words).collect()}
    compiled = lexicon.compiled(words)
    assert compiled.strong == ("否决", "无效") and compiled.verbs == ("提供",) and compiled.topics == ()


@pytest.mark.parametrize("text", [None, "", "  ", "；；；", "，", "%", "x" * 50_000])
def test_repairs_on_odd_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    made = df.select(rp.without_repeats(t), rp.without_doubling(t), rp.without_overlap(t, t), rp.distinct_segments(t), rp.numeric_fragment(t), rp.is_incomplete(t), rp.segments(t), rp.owned_segments(t, "甲", "乙"), dl.occurrences(t, F.lit(""))).first()
    if text is None:
        assert all(x is None for x in made[:7])
    if text and text.startswith("x"):
        assert made[0] == made[1] == made[3] == made[4] == text and made[2] == ""


def test_ledger_and_proposals_on_odd_rows(spark):
    atoms = spark.createDataFrame([(1, 0, ""), (1, 1, "甲乙"), (2, 0, "甲")], "doc_id int, n int, key string")
    got = {(r.doc_id, r.n): (r.place, r.note) for r in dl.text_ledger(atoms, spark.createDataFrame([(1, "甲乙")], "doc_id int, key string")).collect()}
    assert got == {(1, 0): (0, "MISSING"), (1, 1): (1, ""), (2, 0): (0, "MISSING")}
    assert dl.text_ledger(atoms.where("false"), spark.createDataFrame([], "doc_id int, key string")).count() == 0
    item = "doc_id int, kind string, page int, block int, table int, row int, col int, text string"
    items = spark.createDataFrame([(1, "docx_paragraph", None, 3, None, None, None, "工期 90天"), (1, "pdf_block", 1, 3, None, None, None, "x")], item)
    claims = spark.createDataFrame([(1, "docx_paragraph", None, 3, None, None, None, "f", "90天", "工期90天"), (1, "pdf_block", 1, 3, None, None, None, "f", "y", None), (None, "pdf_block", 1, 3, None, None, None, "f", "x", "x")], item.replace("text string", "field string, value string, evidence string"))
    assert sorted(r.verdict for r in dl.judged_proposals(claims, items, lambda f, t: t).collect()) == ["accepted", "evidence is not there", "no such place"]


def test_documents_are_written_as_json_and_lines(spark, tmp_path):
    item = "doc_id int, pos int, kind string, page int, block int, table int, row int, col int, text string"
    items = spark.createDataFrame([(1, 2, "pdf_block", 1, 1, None, None, None, "b\nc"), (1, 1, "pdf_block", 1, 0, None, None, None, "a"), (2, 1, "docx_table_cell", None, None, 0, 0, 0, None)], item)
    dl.write_documents(items, f"file://{tmp_path}/out")
    whole = {x["doc_id"]: x["items"] for x in (json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out/normalized").collect())}
    assert [i["text"] for i in whole[1]] == ["a", "b\nc"] and len(whole[2]) == 1
    lines = spark.read.text(f"file://{tmp_path}/out/lines").collect()
    assert {(r.doc_id, r.value) for r in lines} == {(1, "[PDF:P:1:B:0] a"), (1, "[PDF:P:1:B:1] b\\nc"), (2, "[DOCX:T:0:R:0:C:0] ")}
