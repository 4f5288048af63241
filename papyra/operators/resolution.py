"""Candidates to facts: conflicts are kept, fields are dense, clauses fall back to their parents.

Null keys form a group of their own in aggregations and meet nothing in joins.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED, NEEDS_REVIEW, NOT_FOUND = "RESOLVED", "NEEDS_REVIEW", "NOT_FOUND"
_EDGES = r"(?U)[\s，,。；;：:、.!！？!?（）()]"


def union_first(candidates: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Candidates of several sources, the first of each key by priority (the place in the list), then order."""
    every = reduce(DataFrame.unionByName, [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)])
    return every.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("priority", *order))).where("k = 1").drop("k")


def resolve(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """A group's value if it is the only one, else null and NEEDS_REVIEW: no number of votes hides a conflict. Null values don't count."""
    own = rows.select(F.col(group).alias("key"), value.alias("value")).where("value is not null").groupBy("key", "value").agg(F.count("*").alias("votes"))
    found = own.groupBy("key").agg(F.count("*").alias("candidates"), F.sum("votes").alias("votes"), F.min("value").alias("only"))
    one = F.col("candidates") == 1
    return found.select("key", F.when(one, F.col("only")).alias("resolved"), "candidates", "votes", F.when(one, RESOLVED).otherwise(NEEDS_REVIEW).alias("status"))


def without_truncated(candidates: DataFrame) -> DataFrame:
    """Without candidates that are visibly a piece of another of their document and field, or another with rubbish at its end.

    Texts are compared without white space and punctuation; those of fewer than four characters always stay. The other
    candidates of a group come as a list of distinct texts and confidences: as long as a document has different values for one
    field. ``candidates`` has doc_id, field, value, normalized, confidence and, if cells are told
    apart, ``in_cell``.
    """
    text = F.regexp_replace(F.coalesce("normalized", "value"), _EDGES, "")
    cell = F.col("in_cell") if "in_cell" in candidates.columns else F.lit(False)
    own = candidates.withColumns({"_text": text, "_cell": cell})
    others = F.collect_set(F.struct(F.col("_text").alias("o"), F.col("confidence").alias("c"))).over(Window.partitionBy("doc_id", "field"))
    joined = own.withColumn("_others", others)
    n, mine, trust = F.char_length("_text"), F.col("_text"), F.col("confidence")
    ends = F.rtrim("value").rlike("[。;；)）]$")
    rest = F.col("value").rlike(r"(?U)\s[^\s]{1,3}$") & F.col("_cell")

    def cut(x: Column) -> Column:
        o, c, m = x["o"], x["c"], F.char_length(x["o"])
        piece = ((m > n + 2) & o.startswith(mine) & (c >= trust)) | ((2 * n <= m) & o.contains(mine) & (trust < c)) | ((m > n) & o.endswith(mine) & (trust <= c))
        rubbish = mine.startswith(o) & (m > 0) & (((n > m + 2) & (n - m <= 32) & (trust < c) & ~ends) | ((n > m) & (n - m <= 3) & (trust <= c) & rest))
        return piece | rubbish

    gone = (n >= 4) & F.exists("_others", cut)
    return joined.where(~F.coalesce(gone, F.lit(False))).select(*candidates.columns)


def source_rank(section: Column, ranks: list[tuple[int, str]], default: int) -> Column:
    """The greatest rank whose words (parted by a slash) a section title holds, else ``default``: a preference among equal values only."""
    found = [F.when(reduce(lambda a, b: a | b, (section.contains(w.strip()) for w in words.split("/") if w.strip())), F.lit(rank)) for rank, words in ranks]
    return F.coalesce(F.greatest(*found, F.lit(None).cast("int")), F.lit(default))


def confidence_of(confidence: Column, rank: Column, agreeing: Column) -> Column:
    """The chosen candidate's confidence, raised a little by its source's rank and by others that agree; at most 1."""
    return F.least(F.lit(1.0), confidence + F.least(F.lit(0.02), rank / 10000.0) + F.least(F.lit(0.03), 0.01 * (agreeing - 1)))


def resolve_fields(candidates: DataFrame, fields: list[Any]) -> DataFrame:
    """One row for each document and field that has a usable candidate: value, status, confidence, reason, numbers of candidates.

    Candidates have doc_id, field, pos, value, normalized, method, confidence and, if there is one, rank (of the source) and
    evidence. Unusable ones (blank) and truncated ones go first. No valid value: NEEDS_REVIEW. Values that differ:
    NEEDS_REVIEW, without a value. Keyword evidence needs a candidate of another method elsewhere that passes its gate; one
    candidate alone has to pass its method's gate. Else the best candidate by rank, confidence and place counts. Fields of
    kind money, date, duration, compact and yes_no publish the comparison value, others the text as it stands.
    """
    from papyra.operators.facts import GATE

    rank = F.col("rank") if "rank" in candidates.columns else F.lit(0)
    usable = candidates.where("trim(value) != ''").withColumn("rank", rank)
    usable = without_truncated(usable)
    gate = F.element_at(F.create_map(*(F.lit(x) for pair in GATE.items() for x in pair)), F.col("method"))
    valid, word = F.col("normalized").isNotNull(), F.col("method") == "keyword"
    passes = F.coalesce(F.col("confidence") >= gate, F.lit(False)) & ~word
    best = F.struct("rank", "confidence", (-F.col("pos")).alias("p"), "value")
    found = usable.groupBy("doc_id", "field").agg(
        F.count("*").alias("candidates"), F.count(F.when(valid, 1)).alias("n"), F.count_distinct("normalized").alias("differ"),
        F.min("confidence").alias("least"), F.min(F.when(valid, F.col("confidence"))).alias("least_valid"),
        F.coalesce(F.bool_or(valid & word), F.lit(False)).alias("words"),
        F.array_compact(F.collect_set(F.when(valid & word, F.col("pos")))).alias("word_at"), F.array_compact(F.collect_set(F.when(valid & passes, F.col("pos")))).alias("support_at"),
        F.count(F.when(valid & passes, 1)).alias("passing"),
        F.max_by(F.struct("value", "normalized", "confidence", "rank"), F.when(valid, best)).alias("b"),
    )
    alone = F.col("words") & (F.size(F.array_except("support_at", "word_at")) == 0)
    reason = (
        F.when(F.col("n") == 0, "no valid value").when(F.col("differ") > 1, "values differ").when(alone, "keyword alone")
        .when((F.col("n") == 1) & (F.col("passing") == 0), "below the gate").when(F.col("n") == 1, "one candidate").otherwise("candidates agree")
    )
    found = found.withColumn("reason", reason)
    ok = F.col("reason").isin("one candidate", "candidates agree")
    typed = [f.name for f in fields if f.kind != "text"]
    published = F.when(F.col("field").isin(typed), F.col("b.normalized")).otherwise(F.col("b.value")) if typed else F.col("b.value")
    sure = F.when(ok, confidence_of(F.col("b.confidence"), F.col("b.rank"), F.col("n"))).when(F.col("n") == 0, F.col("least")).when(F.col("reason") == "values differ", F.col("least_valid")).otherwise(F.col("least"))
    return found.select("doc_id", "field", "candidates", F.when(ok, published).alias("value"), F.when(ok, F.col("b.normalized")).alias("normalized"), F.when(ok, RESOLVED).otherwise(NEEDS_REVIEW).alias("status"), sure.alias("confidence"), "reason")


def derived(facts: DataFrame, candidates: DataFrame, target: str, source: str, pattern: str) -> DataFrame:
    """``target`` takes the value of a resolved ``source`` of its document where one of its candidates refers to it by ``pattern``.

    ``facts`` has doc_id, field, value, normalized, status, confidence, reason.
    """
    refers = candidates.where(F.col("field") == target).where(F.regexp_replace("value", r"(?U)\s+", "").rlike(f"^(?:{pattern})$")).groupBy("doc_id").agg(F.min_by("confidence", "pos").alias("_c"))
    known = facts.where((F.col("field") == source) & (F.col("status") == RESOLVED)).select("doc_id", F.col("normalized").alias("_v"), F.col("confidence").alias("_s"))
    own = facts.join(refers.join(known, "doc_id"), "doc_id", "left")
    now = (F.col("field") == target) & F.col("_v").isNotNull()
    put = lambda c, v: F.when(now, v).otherwise(F.col(c)).alias(c)
    new = {"value": F.col("_v"), "normalized": F.col("_v"), "status": F.lit(RESOLVED), "confidence": F.least("_c", "_s"), "reason": F.lit("cross reference")}
    return own.select(*(put(c, new[c]) if c in new else F.col(c) for c in facts.columns))


def dense(facts: DataFrame, keys: DataFrame, fields: list[str]) -> DataFrame:
    """A row for every key and field; those without a fact are NOT_FOUND. The fields are a short fixed list."""
    every = keys.select("key", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return every.join(facts, ["key", "field"], "left").withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def summary(facts: DataFrame, key: str = "key") -> DataFrame:
    """Per document how many fields have each status."""
    count = lambda s: F.count_if(F.col("status") == s)
    return facts.groupBy(key).agg(F.count("*").alias("fields"), count(RESOLVED).alias("resolved"), count(NEEDS_REVIEW).alias("needs_review"), count(NOT_FOUND).alias("not_found"))


def overridden(facts: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """``facts`` (doc_id, field, value, status, confidence) after reviewers' ``overrides`` (doc_id, field, action, choice), with an ``outcome``.

    SELECT takes the candidate whose place is ``choice`` as it stands, KEEP leaves the fact. Only NEEDS_REVIEW can change: others are
    REFUSED, a choice that isn't there or is blank is INVALID, and both leave the fact. Facts without an override have no outcome.
    Of several overrides of one fact the first by action and choice counts.
    """
    one = overrides.groupBy("doc_id", "field").agg(F.min(F.struct("action", "choice")).alias("_o"))
    picked = candidates.select("doc_id", "field", F.col("place").alias("_place"), F.col("value").alias("_value"), F.col("confidence").alias("_sure"))
    asked = facts.join(one, ["doc_id", "field"], "left")
    both = asked.join(picked, (asked["doc_id"] == picked["doc_id"]) & (asked["field"] == picked["field"]) & (F.col("_o.choice") == F.col("_place")), "left").drop(picked["doc_id"]).drop(picked["field"])
    fits = F.coalesce(F.trim("_value") != "", F.lit(False))
    outcome = F.when(F.col("_o").isNull(), F.lit(None)).when(F.col("status") != NEEDS_REVIEW, "REFUSED").when(F.col("_o.action") == "KEEP", "KEPT").when(fits, "SELECTED").otherwise("INVALID")
    done = both.withColumn("outcome", outcome)
    now = F.coalesce(F.col("outcome") == "SELECTED", F.lit(False))
    put = {"value": F.col("_value"), "status": F.lit(RESOLVED), "confidence": F.col("_sure")}
    return done.select(*(F.when(now, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in facts.columns), "outcome")


def with_parent(clauses: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each clause with its best schedule row: of its own key, else of its parent's; keys with several rows give the first by (item)."""
    best = schedule.groupBy("key").agg(F.min("item").alias("item"))
    own = clauses.join(best.select(F.col("key"), F.col("item").alias("own_item")), "key", "left")
    both = own.join(best.select(F.col("key").alias("parent"), F.col("item").alias("parent_item")), "parent", "left")
    via = F.when(F.col("own_item").isNotNull(), "own").when(F.col("parent_item").isNotNull(), "parent").otherwise("none")
    return both.select("key", F.coalesce("own_item", "parent_item").alias("item"), via.alias("via"))
