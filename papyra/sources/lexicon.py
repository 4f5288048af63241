"""Word lists as files: JSON (or YAML, where that reader is installed) with a list of words under each name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.requirements import Lexicon

#: A lexicon's words are compiled into expressions; more than this is no lexicon.
MOST = 10_000


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, ordinal, word) of a file {"name": ["word", ...], ...}; words are trimmed, empty and repeated ones left out."""
    content = spark.read.text(path, wholetext=True).first()
    text = content[0] if content else "{}"
    if path.endswith((".yaml", ".yml")):
        import yaml  # an optional reader

        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    found = [(name, i, w.strip()) for name, words in data.items() for i, w in enumerate(dict.fromkeys(words)) if w.strip()]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} words")
    return spark.createDataFrame(found, "name string, ordinal int, word string")


def unambiguous(words: DataFrame) -> DataFrame:
    """The words that one name alone has: an alias of two fields tells neither."""
    once = words.groupBy("word").agg(F.count_distinct("name").alias("n")).where("n = 1").select("word")
    return words.join(once, "word", "left_semi")


def compiled(words: DataFrame) -> Lexicon:
    """A lexicon of the names that it knows, in the words' order. At most MOST words reach the driver."""
    known = {n for n in Lexicon._fields if n not in ("topics", "others", "modules", "risks")}
    found: dict[str, list[str]] = {}
    for r in words.orderBy("name", "ordinal").limit(MOST).collect():
        found.setdefault(r["name"], []).append(r["word"])
    return Lexicon(**{k: tuple(v) for k, v in found.items() if k in known})
