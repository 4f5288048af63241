"""Negative controls of the checks, odd rows of the lookups, and ingestion that is replayed."""

from pyspark.sql import functions as F

from papyra.operators import invariants as iv
from papyra.operators import lookups as lk
from papyra.streaming.ingest import ingest

ROWS = "doc_id bigint, pos int, text string"


def test_checks_find_violations(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k bigint")
    parents = spark.createDataFrame([(1,)], "p bigint")
    found = iv.checks({"orphans": iv.orphans(rows, "k", parents, "p"), "repeats": iv.repeats(rows, "k"), "none": rows.where("k > 9")})
    assert {r.check_id: r.violations for r in found.collect()} == {"orphans": 2, "repeats": 1, "none": 0}


def test_accounts_close(spark):
    source = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "g int, text string")
    delivered = spark.createDataFrame([(1, "a"), (1, "c"), (3, "d")], "g int, text string")
    got = {r.g: tuple(r)[1:] for r in iv.accounted(source, delivered, "g").collect()}
    assert got == {1: (3, 2, 1, 2, 1), 2: (1, 0, 0, 1, 0), 3: (0, 1, 0, 0, 1)}
    assert all(s == m + lost and d == m + new for s, d, m, lost, new in got.values())


def test_text_gate(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 19), (4, "x" * 20), (5, "x" * 60 + "\n\n"), (6, "x" * 40 + "\n" + "y"), (7, "x" * 100 + "\ny\ny\ny")], "doc_id bigint, text string")
    got = {r.doc_id: (r.pages, r.chars, r.status) for r in iv.text_gate(docs).collect()}
    assert got == {1: (1, 0, "OCR_REQUIRED"), 2: (1, 0, "OCR_REQUIRED"), 3: (1, 19, "OCR_REQUIRED"), 4: (1, 20, "READY"), 5: (3, 60, "OCR_REQUIRED"), 6: (2, 41, "READY"), 7: (4, 103, "OCR_REQUIRED")}


def test_lookups_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "Head"), (1, 1, "plain text here."), (1, 2, "strong * text."), (2, 0, "alone.")], ROWS)
    got = {(r.doc_id, r.pos): r.status for r in lk.propagated(rows, F.col("text").contains("*")).collect()}
    assert got == {(1, 0): "SECTION", (1, 1): "SECTION", (1, 2): "OWN", (2, 0): "NONE"}
    claims = spark.createDataFrame([(1, 0, "Head"), (1, 0, "x"), (1, 9, "x"), (None, 0, "x"), (1, 0, None)], "doc_id bigint, pos int, excerpt string")
    assert sorted(r.status for r in lk.validated(claims, rows).collect()) == ["MISMATCH", "MISMATCH", "MISSING", "MISSING", "VALID"]
    empty = spark.createDataFrame([], ROWS)
    assert lk.same_text(empty).count() == lk.numbered(empty, "S%d").count() == 0
    twice = rows.unionByName(rows).withColumn("text", F.lit("the same eighteen characters"))
    assert [tuple(r) for r in lk.same_text(twice).collect()] == [(1, 0, 8)]


def test_replayed_files_come_once(spark, tmp_path):
    kind, source, target = "doc_id bigint, text string", str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, kind, target, str(tmp_path / "state")).awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.parquet(target).select("doc_id", "text").collect())

    assert put((1, "a"), (2, "b"), (2, "b"), (None, "c")) == [(1, "a"), (2, "b")]
    assert put((1, "a"), (2, "other"), (3, None)) == [(1, "a"), (2, "b"), (3, None)]


def test_a_new_checkpoint_over_an_old_target(spark, tmp_path):
    """What another checkpoint has taken in stays, and its ids aren't taken in again."""
    kind, target = "doc_id bigint, text string", str(tmp_path / "out")
    for k, rows in enumerate(([(1, "a")], [(2, "b"), (1, "c")], [(3, "d")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        ingest(spark, str(tmp_path / f"in{k}"), kind, target, str(tmp_path / f"state{k}")).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(target).select("doc_id", "text").collect()) == [(1, "a"), (2, "b"), (3, "d")]
