"""A corpus from raw documents to tokens: stages that each write a table which the next one reads.

Rows are judged one by one: repeated rows and rows without an id go through the classifier, line dedup, decontamination and
encoding like others, each with its own result; only the Jaccard stage keeps one of them. Null texts stay null (as tokens they
count as empty), long texts are taken whole, further columns stay, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm import bpe, decontam, jaccard, linededup, quality
from papyra.llm.common import free_names, release, scratch, scratch_dir
from papyra.llm.queries import tokenizer_path


_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[tuple[SparkSession, str]] = []


def stage(fn: _Stage) -> _Stage:
    """``fn`` as a stage: the stage before has been written, so the tables that it worked with go, and no others."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        release(_before)
        held = scratch()
        out = fn(spark, docs, sf_dir)
        _before = [x for x in scratch() if x not in held]
        return out

    return run_stage


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents share, but for the last that holds them; n_chars follows."""
    kept, dropped = free_names(docs, "_kept", "_dropped")
    out = linededup.dedup(docs, kept=kept, dropped=dropped)
    changed = F.col(dropped) > 0
    size = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    return out.withColumns({"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, size).otherwise(F.col("n_chars"))}).select(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id. Rows without an id stay.

    A repeated id's texts are judged one by one: those that are no near copies of each other or of a smaller id's text
    all stay. Of a group's rows with the smallest id the one of the least token-set class stays, then of the least text,
    then of the least other columns. An id's rows without any word are one group.
    """
    key, mark, cls, copies, place = free_names(docs, "_id", "_mark", "_class", "_copies", "_place")
    groups = jaccard.grouped(docs).where("doc_id = component_id").select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("class").alias(cls), "component")
    least = groups.groupBy(key, "component").agg(F.min(cls).alias(cls), F.count("*").alias(copies))
    kept = groups.join(least, [key, "component", cls]).select(key, mark, cls, copies).distinct()
    rows = docs.join(kept, (F.col("doc_id") == F.col(key)) & (jaccard.mark_of(F.col("text")) == F.col(mark)))
    nested = [f.name for f in docs.schema if not isinstance(f.dataType, T.AtomicType)]
    order = ["text", *(x for x in docs.columns if x not in nested), *([F.to_json(F.struct(*nested))] if nested else [])]
    several = rows.where(F.col(copies) > 1)  # only rows of repeated ids need a choice
    first = several.withColumn(place, F.row_number().over(Window.partitionBy(key, cls).orderBy(*order))).where(F.col(place) == 1)
    return rows.where(F.col(copies) == 1).select(*docs.columns).unionByName(first.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again: counts and digests of both beside the document's columns, in place of any with their names."""
    return bpe.digests(docs, tokenizer_path(), *docs.columns)


STAGES: list[tuple[str, _Stage]] = [
    ("quality classifier", good),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clean),
    ("BPE encoding and decoding", tokens),
]

#: A trained classifier is no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"), keep=True)
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
