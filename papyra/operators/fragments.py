"""Documents to ordered fragments, and the ordered operators over them.

Every table carries its order (doc_id, pos): rows have none of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A fragment of at most so many characters without a full stop at its end counts as a heading, if the caller has no other rule.
HEADING_CHARS = 24


def fragments(documents: DataFrame) -> DataFrame:
    """Non-empty lines with their position: doc_id, pos, text. Null texts have none."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "")


def is_heading(text: Column) -> Column:
    return (F.char_length(text) <= HEADING_CHARS) & ~text.endswith(".")


def section_carry(rows: DataFrame, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """Each fragment with the last heading at or before it in its document."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(heading(F.col("text")), F.col("text")), ignorenulls=True).over(order))


def first_of_repeats(rows: DataFrame) -> DataFrame:
    """The first fragment of each normalised text in a document, with how often it came."""
    norm = F.lower(F.regexp_replace("text", r"[ \t]+", " "))
    same = Window.partitionBy("doc_id", "norm")
    return rows.withColumn("norm", norm).withColumns({"times": F.count("*").over(same), "k": F.row_number().over(same.orderBy("pos"))}).where("k = 1").drop("k", "norm")


def repeated_chrome(rows: DataFrame, least: int) -> DataFrame:
    """Lines in at least so many documents: running heads and notices."""
    return rows.groupBy("text").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("times")).where(F.col("documents") >= least)


def sections(rows: DataFrame, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """Intervals of positions that headings open: doc_id, title, start, stop (the next heading's position, or null)."""
    heads = rows.where(heading(F.col("text")))
    return heads.select("doc_id", F.col("text").alias("title"), F.col("pos").alias("start"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).alias("stop"))


def in_sections(rows: DataFrame, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """Fragments with the title and start of the section that holds them, carried by a window; those before the first heading are left out."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(heading(F.col("text")), F.struct("text", "pos")), ignorenulls=True).over(order)
    return rows.withColumn("_h", head).where("_h is not null").select(*rows.columns, F.col("_h.text").alias("title"), F.col("_h.pos").alias("start"))


def whole_fragments(rows: DataFrame) -> DataFrame:
    """Fragments that aren't a proper prefix of another fragment of their document.

    In binary order the next greater text after a proper prefix begins with it, so one look ahead among a document's
    distinct texts decides. Null texts are left out.
    """
    each = rows.select("doc_id", "text").where("text is not null").distinct()
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("text"))
    cut = each.withColumn("_n", following).where(F.startswith("_n", "text")).select("doc_id", "text")
    return rows.where("text is not null").join(cut, ["doc_id", "text"], "left_anti")
