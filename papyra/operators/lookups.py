"""Lookups between clauses, their locators and their regions: equi-joins, with what else has to hold as a residue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators import fragments as fr

#: Keys of fewer characters say too little to tell two fragments the same.
KEY_CHARS = 18


def same_text(rows: DataFrame, least: int = KEY_CHARS) -> DataFrame:
    """For each text without white space, in lower case: the first fragment that has it, and how many do."""
    key = F.lower(F.regexp_replace("text", r"[ \t]+", ""))
    at = F.struct("doc_id", "pos")
    found = rows.select(key.alias("key"), "doc_id", "pos").where(F.char_length("key") >= least)
    return found.groupBy("key").agg(F.min(at).alias("at"), F.count("*").alias("copies")).select("at.doc_id", "at.pos", "copies")


def outside(points: DataFrame, boxes: DataFrame, slack: float = 0) -> DataFrame:
    """Points (page, x, y) in no box (page, x0, y0, x1, y1) of their page; boxes are wider by ``slack``."""
    p, b = points.alias("p"), boxes.alias("b")
    inside = F.col("p.x").between(F.col("b.x0") - slack, F.col("b.x1") + slack) & F.col("p.y").between(F.col("b.y0") - slack, F.col("b.y1") + slack)
    return p.join(b, (F.col("p.page") == F.col("b.page")) & inside, "left_anti")


def validated(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Claims (doc_id, pos, excerpt) with status: MISSING without a fragment there, MISMATCH if it lacks the excerpt, else VALID."""
    at = claims.join(rows.select("doc_id", "pos", "text"), ["doc_id", "pos"], "left")
    status = F.when(F.col("text").isNull(), "MISSING").when(F.col("text").contains(F.col("excerpt")), "VALID").otherwise("MISMATCH")
    return at.withColumn("status", F.coalesce(status, F.lit("MISMATCH")))


def propagated(rows: DataFrame, strong: Column, heading: Callable[[Column], Column] = fr.is_heading) -> DataFrame:
    """Fragments with status OWN if they are strong, SECTION if another of their section is, else NONE.

    Fragments before the first heading are a section as well. The section's flag is a window over the document, so that
    the rows are shuffled once.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"own": F.coalesce(strong, F.lit(False)), "section": F.count(F.when(heading(F.col("text")), 1)).over(doc)})
    any_of = F.bool_or("own").over(Window.partitionBy("doc_id", "section"))
    return placed.withColumn("status", F.when(F.col("own"), "OWN").when(any_of, "SECTION").otherwise("NONE")).drop("own", "section")


def numbered(rows: DataFrame, form: str) -> DataFrame:
    """Fragments with their running number in the document, as ``form`` writes it; later drops leave gaps."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("id", F.format_string(form, n))


def carried(rows: DataFrame, key: str, order: list[str], value: Column, reset: Column) -> DataFrame:
    """The last value at or before each row, forgotten after a row that resets."""
    before = Window.partitionBy(key).orderBy(*order)
    n = F.coalesce(F.sum(reset.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", n).withColumn("carried", F.last(value, ignorenulls=True).over(part)).drop("island")
