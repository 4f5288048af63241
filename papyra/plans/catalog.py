"""The operators as queries on the standard tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import fragments as fr
from papyra.operators import resolution as rs
from papyra.operators import rules as ru

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_LINES = "lines AS (SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(text, ' ') <> '')"
#: The documents' short lines without a bar stand for headings: few of them are without a full stop.
_HEAD = "(length(text) <= 40 AND NOT contains(text, '|'))"


def short_line(text: Column) -> Column:
    return (F.char_length(text) <= 40) & ~text.contains("|")


def query(sql: str):  # type: ignore[no-untyped-def]
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return fr.fragments(spark.read.parquet(f"{d}/documents.parquet"))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, CAST(length(text) AS INT) AS chars, sha256(text) AS digest FROM lines")
def fragment_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("doc_id", "pos", F.char_length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, last_value(CASE WHEN {_HEAD} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines")
def section_carry(spark: SparkSession, d: str) -> DataFrame:
    return fr.section_carry(_rows(spark, d), short_line).select("doc_id", "pos", "section")


@query(f"""WITH {_LINES} SELECT CASE WHEN {_HEAD} THEN 'heading' WHEN length(text) < 80 THEN 'short' WHEN text = upper(text) THEN 'shouted' ELSE 'kept' END AS reason, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1""")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(short_line(F.col("text")), "heading").when(F.char_length("text") < 80, "short").when(F.col("text") == F.upper("text"), "shouted").otherwise("kept")
    return _rows(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def _case() -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{n}'" for n, words in ru.TOPICS) + " ELSE 'other' END"


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, {_case()} AS topic FROM lines")
def first_rule_match(spark: SparkSession, d: str) -> DataFrame:
    return ru.first_match(_rows(spark, d)).select("doc_id", "pos", "topic")


@query(f"WITH {_LINES}, m AS (SELECT doc_id, pos, " + " || ".join(f"CASE WHEN contains(text, '{m}') THEN '{m}' ELSE '' END" for m in ru.MARKERS) + " AS markers FROM lines) SELECT doc_id, CAST(pos AS INT) AS pos, markers FROM m WHERE markers <> ''")
def marker_flags(spark: SparkSession, d: str) -> DataFrame:
    return ru.marker_flags(_rows(spark, d)).select("doc_id", "pos", "markers")


@query(f"WITH {_LINES}, v AS (SELECT doc_id, pos, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') AS f FROM lines) SELECT doc_id, CAST(pos AS INT) AS pos, CAST(len(f) AS INT) AS n, array_to_string(f, ',') AS found FROM v WHERE len(f) > 0")
def value_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ru.value_tokens(_rows(spark, d)).select("doc_id", "pos", F.size("found").alias("n"), F.array_join("found", ",").alias("found"))


@query(rf"WITH {_LINES} SELECT doc_id, CAST(min(pos) AS INT) AS pos, count(*) AS times FROM lines GROUP BY doc_id, lower(regexp_replace(text, '[ \t]+', ' ', 'g'))")
def fragment_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return fr.first_of_repeats(_rows(spark, d)).select("doc_id", "pos", "times")


@query(f"WITH {_LINES} SELECT text, count(DISTINCT doc_id) AS documents, count(*) AS times FROM lines GROUP BY text HAVING count(DISTINCT doc_id) >= 5")
def repeated_chrome(spark: SparkSession, d: str) -> DataFrame:
    return fr.repeated_chrome(_rows(spark, d), 5)


_RULES = "rules(rule, name, word) AS (VALUES " + ", ".join(f"({i}, '{n}', '{w}')" for i, (n, words) in enumerate(ru.TOPICS) for w in words) + ")"


@query(f"""WITH {_LINES}, {_RULES}, s AS (SELECT rule, name, doc_id, pos, count(*) AS hits, any_value(length(text)) AS chars FROM lines JOIN rules ON contains(lower(text), word) GROUP BY rule, name, doc_id, pos)
SELECT rule, name, doc_id, CAST(pos AS INT) AS pos, hits, CAST(chars AS INT) AS chars, CAST(row_number() OVER (PARTITION BY rule ORDER BY hits DESC, chars, doc_id, pos) AS INT) AS place FROM s QUALIFY place <= 40""")
def rule_scores_topk(spark: SparkSession, d: str) -> DataFrame:
    return ru.scored(_rows(spark, d), 40)


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, text AS title, pos AS start, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM lines WHERE {_HEAD})
SELECT l.doc_id, CAST(l.pos AS INT) AS pos, title, CAST(start AS INT) AS start FROM lines l JOIN h ON l.doc_id = h.doc_id AND l.pos >= start AND (stop IS NULL OR l.pos < stop)""")
def range_join_sections(spark: SparkSession, d: str) -> DataFrame:
    return fr.in_sections(_rows(spark, d), short_line).select("doc_id", "pos", "title", "start")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos FROM lines a WHERE NOT EXISTS (SELECT 1 FROM lines b WHERE a.doc_id = b.doc_id AND length(b.text) > length(a.text) AND starts_with(b.text, a.text))")
def truncated_drop(spark: SparkSession, d: str) -> DataFrame:
    return fr.whole_fragments(_rows(spark, d)).select("doc_id", "pos")


@query("""WITH u AS (SELECT conv_id, turn, 0 AS priority, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1, text FROM conversations WHERE role <> 'assistant'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY priority, turn) AS k FROM u) SELECT conv_id, turn, CAST(priority AS INT) AS priority FROM k WHERE k = 1""")
def candidate_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return rs.union_first([c.where("role = 'assistant'"), c.where("role <> 'assistant'")], ["conv_id", "text"], ["turn"]).select("conv_id", "turn", "priority")


@query("""SELECT o_custkey AS key, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS resolved, count(DISTINCT o_orderstatus) AS candidates, count(*) AS votes,
CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'RESOLVED' ELSE 'NEEDS_REVIEW' END AS status FROM orders GROUP BY o_custkey""")
def resolve_groups(spark: SparkSession, d: str) -> DataFrame:
    return rs.resolve(_read(spark, d, "orders"), "o_custkey", F.col("o_orderstatus"))


@query("""WITH f AS (SELECT o_custkey AS key, o_orderstatus AS field, 'RESOLVED' AS status, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT c_custkey AS key, unnest(['F', 'O', 'P']) AS field FROM customer)
SELECT key, field, coalesce(status, 'NOT_FOUND') AS status, n FROM k LEFT JOIN f USING (key, field)""")
def dense_fields(spark: SparkSession, d: str) -> DataFrame:
    facts = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("field")).agg(F.count("*").alias("n")).withColumn("status", F.lit("RESOLVED"))
    return rs.dense(facts, _read(spark, d, "customer").select(F.col("c_custkey").alias("key")), ["F", "O", "P"]).select("key", "field", "status", "n")


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey * 10 AS parent FROM lineitem), a AS (SELECT o_orderkey * 10 AS key, o_orderpriority AS item FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber = 1), s AS (SELECT key, min(item) AS item FROM a GROUP BY key)
SELECT c.key, coalesce(o.item, p.item) AS item, CASE WHEN o.item IS NOT NULL THEN 'own' WHEN p.item IS NOT NULL THEN 'parent' ELSE 'none' END AS via FROM c LEFT JOIN s o ON o.key = c.key LEFT JOIN s p ON p.key = c.parent""")
def parent_key_fallback(spark: SparkSession, d: str) -> DataFrame:
    item = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    clauses = item.select(key.alias("key"), (F.col("l_orderkey") * 10).alias("parent"))
    orders = _read(spark, d, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 10).alias("key"), F.col("o_orderpriority").alias("item"))
    return rs.with_parent(clauses, orders.unionByName(item.where("l_linenumber = 1").select(key.alias("key"), F.col("l_returnflag").alias("item"))))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {_LINES} SELECT text FROM lines WHERE doc_id % 2 = 0 EXCEPT ALL SELECT text FROM lines WHERE doc_id % 2 = 1")
def multiset_except(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return rows.where("doc_id % 2 = 0").select("text").exceptAll(rows.where("doc_id % 2 = 1").select("text"))


@query("SELECT user_id, count(*) AS events, CASE WHEN bool_or(event_type = 'purchase') THEN 'closed' WHEN bool_or(event_type = 'click') THEN 'active' ELSE 'seen' END AS status FROM events GROUP BY user_id")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return _read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.when(has("purchase"), "closed").when(has("click"), "active").otherwise("seen").alias("status"))


@query(f"WITH {_LINES} SELECT doc_id, sha256(string_agg(text, ' / ' ORDER BY pos)) AS digest, count(*) AS fragments FROM lines GROUP BY doc_id")
def ordered_join(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return _rows(spark, d).groupBy("doc_id").agg(F.sha2(F.array_join(parts, " / "), 256).alias("digest"), F.count("*").alias("fragments"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
