"""Files of a folder by their suffix: what could be read of each, as a status, and its text as fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import delivery
from papyra.sources import docx, pdf


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """path, type, status (PARSED, OCR_REQUIRED, PARSE_ERROR, UNSUPPORTED_FORMAT) and exit_code of every file with bytes in ``folder``. No file fails the job."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    every = spark.read.format("binaryFile").load(folder).select("path", suffix.alias("type"))
    word = docx.read_docx(spark, folder, "*.docx").groupBy("path").agg(F.min("status").alias("s"))
    found = word.select("path", F.when(F.col("s") == "FAILED", "PARSE_ERROR").when(F.col("s") == "OCR_REQUIRED", "OCR_REQUIRED").otherwise("PARSED").alias("status"))
    found = found.unionByName(pdf.statuses(pdf.read_pdf(spark, folder, "*.pdf")).select("path", "status"))
    out = every.join(found, "path", "left").withColumn("status", F.coalesce("status", F.lit("UNSUPPORTED_FORMAT")))
    return out.withColumn("exit_code", delivery.exit_code(F.col("status")))


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments (doc_id, pos, text) of all files that could be read: paragraphs and table rows, or a page's blocks in order."""
    pages = pdf.read_pdf(spark, folder, "*.pdf").where("status = 'PARSED' and trim(text) != ''")
    blocks = pages.select(F.col("path").alias("doc_id"), (F.col("page") * 10_000 + F.col("block")).alias("pos"), "text")
    return docx.fragments(docx.read_docx(spark, folder, "*.docx")).unionByName(blocks)
