"""Checks: gates on documents, accounts of what came and went, and a table of violations that must all be 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a text has at least, in all and on a page; share of pages with text.
TEXT_CHARS, PAGE_SHARE = 20, 0.5


def text_gate(documents: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, pages, chars and status: OCR_REQUIRED if a document has too little text, in all or by page, else READY.

    A page counts as filled from TEXT_CHARS characters on.

    Pages are the parts between separators. Null texts have one empty page. No shuffle.
    """
    pages = F.split(F.coalesce("text", F.lit("")), separator)
    sizes = F.transform(pages, lambda x: F.char_length(F.trim(x)))
    counted = documents.select("doc_id", sizes.alias("sizes")).select(
        "doc_id", F.size("sizes").alias("pages"), F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("chars"), F.size(F.filter("sizes", lambda x: x >= TEXT_CHARS)).alias("filled")
    )
    few = (F.col("filled") < PAGE_SHARE * F.col("pages")) | (F.col("chars") < TEXT_CHARS * F.col("pages"))
    status = F.when((F.col("chars") < TEXT_CHARS) | ((F.col("pages") >= 2) & few), "OCR_REQUIRED").otherwise("READY")
    return counted.select("doc_id", "pages", "chars", status.alias("status"))


def accounted(source: DataFrame, delivered: DataFrame, group: str) -> DataFrame:
    """Per group: texts in the source and delivered, matched, lost and invented, counted with repeats.

    source = matched + lost, delivered = matched + invented. Counts of each text meet by aggregation, not by a join.
    """
    both = source.select(group, "text", F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(delivered.select(group, "text", F.lit(0).alias("s"), F.lit(1).alias("d")))
    each = both.groupBy(group, "text").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    return each.groupBy(group).agg(
        F.sum("s").alias("source"), F.sum("d").alias("delivered"), F.sum(F.least("s", "d")).alias("matched"),
        F.sum(F.greatest(F.col("s") - F.col("d"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("d") - F.col("s"), F.lit(0))).alias("invented"),
    )


def checks(violations: dict[str, DataFrame]) -> DataFrame:
    """check_id, violations: how many rows each frame of violations has."""
    return reduce(DataFrame.unionByName, [v.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check_id"), "violations") for k, v in violations.items()])


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key is no reference."""
    own = rows.select(F.col(key).alias("_key")).where("_key is not null")
    return own.join(parents.select(F.col(parent_key).alias("_key")), "_key", "left_anti")


def repeats(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).count().where("count > 1")


def strongest(rows: DataFrame, key: str, status: Column, order: list[str]) -> DataFrame:
    """The strongest status of each key: the one that comes first in ``order``; others count for nothing."""
    rank = F.array_position(F.array(*map(F.lit, order)), status)
    found = rows.where(rank > 0).groupBy(F.col(key).alias("key")).agg(F.min(rank).alias("rank"), F.count("*").alias("stated"))
    return found.select("key", F.element_at(F.array(*map(F.lit, order)), F.col("rank").cast("int")).alias("status"), "stated")
