"""Rules are data: tables of patterns, matched, scored and ranked against fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Topic rules of the demonstration queries, in order of precedence: name, words.
TOPICS = [("licence", ["licensed", "license"]), ("contact", ["@", "(706)"]), ("credential", ["token", "password"]), ("table", [" | "]), ("noise", ["***", "###"])]
MARKERS = ["*", "#", "%", "$"]


def first_match(rows: DataFrame) -> DataFrame:
    """Each fragment with the first topic one of whose words it holds; ``other`` if none."""
    text, topic = F.lower("text"), F.lit("other")
    for name, words in reversed(TOPICS):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        topic = F.when(hit, F.lit(name)).otherwise(topic)
    return rows.withColumn("topic", topic)


def marker_flags(rows: DataFrame) -> DataFrame:
    """Which marker characters a fragment has, in the order of MARKERS."""
    flags = [F.when(F.col("text").contains(m), F.lit(m)) for m in MARKERS]
    return rows.withColumn("markers", F.concat_ws("", *flags)).where("markers != ''")


def value_tokens(rows: DataFrame) -> DataFrame:
    """Numbers of a fragment, in order."""
    return rows.withColumn("found", F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)).where("size(found) > 0")


def scored(rows: DataFrame, k: int) -> DataFrame:
    """For each rule the k best fragments: words found, then the shorter, then document order. A fragment's hits are counted in its own row."""
    low = F.lower("text")
    hits = lambda words: reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("bigint") for w in words))
    every = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(n).alias("name"), hits(words).alias("hits")) for i, (n, words) in enumerate(TOPICS)))
    score = rows.select("doc_id", "pos", F.char_length("text").alias("chars"), F.explode(F.filter(every, lambda x: x["hits"] > 0)).alias("x"))
    order = Window.partitionBy("rule").orderBy(F.desc("hits"), "chars", "doc_id", "pos")
    return score.select("x.rule", "x.name", "doc_id", "pos", "x.hits", "chars").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
