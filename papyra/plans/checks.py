"""Lookups and checks as queries on the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.operators import invariants as iv
from papyra.operators import lookups as lk
from papyra.operators import rules as ru
from papyra.plans.catalog import _HEAD, _LINES, _read, _rows, query, short_line

_STRENGTH = ["error", "purchase", "signup", "click", "view"]
_STRONG = " OR ".join(f"contains(text, '{m}')" for m in ru.MARKERS)


@query(rf"""WITH {_LINES}, k AS (SELECT lower(regexp_replace(text, '[ \t]+', '', 'g')) AS key, doc_id, pos FROM lines), f AS (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS place FROM k WHERE length(key) >= {lk.KEY_CHARS})
SELECT doc_id, CAST(pos AS INT) AS pos, copies FROM f WHERE place = 1""")
def near_dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return lk.same_text(_rows(spark, d))


@query("""WITH p AS (SELECT l_orderkey AS page, l_quantity AS x, CAST(10 * l_linenumber AS DOUBLE) AS y FROM lineitem), b AS (SELECT o_orderkey AS page, o_custkey % 20 AS x0, 10 AS y0, o_custkey % 20 + 20 AS x1, 40 AS y1 FROM orders)
SELECT page, x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND p.x BETWEEN x0 - 1 AND x1 + 1 AND p.y BETWEEN y0 - 1 AND y1 + 1)""")
def box_anti_join(spark: SparkSession, d: str) -> DataFrame:
    points = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), (10.0 * F.col("l_linenumber")).alias("y"))
    left = F.col("o_custkey") % 20
    boxes = _read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), left.alias("x0"), F.lit(10).alias("y0"), (left + 20).alias("x1"), F.lit(40).alias("y1"))
    return lk.outside(points, boxes, 1)


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, pos + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS pos, substr(text, 1, 20) AS excerpt FROM lines)
SELECT c.doc_id, CAST(c.pos AS INT) AS pos, CASE WHEN text IS NULL THEN 'MISSING' WHEN contains(text, excerpt) THEN 'VALID' ELSE 'MISMATCH' END AS status FROM c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.pos = c.pos""")
def locator_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    claims = rows.select("doc_id", (F.col("pos") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).alias("pos"), F.substring("text", 1, 20).alias("excerpt"))
    return lk.validated(claims, rows).select("doc_id", "pos", "status")


@query(f"""WITH {_LINES}, s AS (SELECT *, ({_STRONG}) AS own, count(CASE WHEN {_HEAD} THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines)
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN own THEN 'OWN' WHEN bool_or(own) OVER (PARTITION BY doc_id, section) THEN 'SECTION' ELSE 'NONE' END AS status FROM s""")
def reference_propagation(spark: SparkSession, d: str) -> DataFrame:
    strong = F.lit(False)
    for m in ru.MARKERS:
        strong = strong | F.col("text").contains(m)
    return lk.propagated(_rows(spark, d), strong, short_line).select("doc_id", "pos", "status")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, printf('SR%04d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS id FROM lines")
def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    return lk.numbered(_rows(spark, d), "SR%04d").select("doc_id", "pos", "id")


@query("""WITH i AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM events)
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM i""")
def governing_carry(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return lk.carried(rows, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), F.col("event_type") == "purchase").select("event_id", "carried")


@query("""SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size >= 40 THEN 0 WHEN p_size >= 20 THEN 1 ELSE 2 END, p_partkey) AS INT) AS place FROM part""")
def module_order(spark: SparkSession, d: str) -> DataFrame:
    risk = F.when(F.col("p_size") >= 40, 0).when(F.col("p_size") >= 20, 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy(risk, "p_partkey"))
    return _read(spark, d, "part").select("p_partkey", "p_brand", order.alias("place"))


@query(f"""WITH z AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' '))) AS s FROM documents), c AS (SELECT doc_id, len(s) AS pages, list_sum(s) AS chars, len(list_filter(s, lambda x: x >= {iv.TEXT_CHARS})) AS filled FROM z)
SELECT doc_id, CAST(pages AS INT) AS pages, CAST(chars AS INT) AS chars, CASE WHEN chars < {iv.TEXT_CHARS} OR (pages >= 2 AND (filled < {iv.PAGE_SHARE} * pages OR chars < {iv.TEXT_CHARS} * pages)) THEN 'OCR_REQUIRED' ELSE 'READY' END AS status FROM c""")
def text_gate(spark: SparkSession, d: str) -> DataFrame:
    return iv.text_gate(_read(spark, d, "documents"))


@query(f"""WITH {_LINES}, u AS (SELECT doc_id, text, 1 AS s, 0 AS d FROM lines UNION ALL SELECT doc_id, lower(text), 0, 1 FROM lines WHERE length(text) >= 40), e AS (SELECT doc_id, text, sum(s) AS s, sum(d) AS d FROM u GROUP BY doc_id, text)
SELECT doc_id, CAST(sum(s) AS BIGINT) AS source, CAST(sum(d) AS BIGINT) AS delivered, CAST(sum(least(s, d)) AS BIGINT) AS matched, CAST(sum(greatest(s - d, 0)) AS BIGINT) AS lost, CAST(sum(greatest(d - s, 0)) AS BIGINT) AS invented FROM e GROUP BY doc_id""")
def text_account(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return iv.accounted(rows, rows.where(F.char_length("text") >= 40).withColumn("text", F.lower("text")), "doc_id")


@query("""SELECT 'lineitem_order' AS check_id, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'label_value', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'document_chars', count(*) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'turn_twice', count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)""")
def qa_checks(spark: SparkSession, d: str) -> DataFrame:
    t = {n: _read(spark, d, n) for n in ("lineitem", "orders", "customer", "labels", "documents", "conversations")}
    return iv.checks({
        "lineitem_order": iv.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), "order_customer": iv.orphans(t["orders"], "o_custkey", t["customer"], "c_custkey"),
        "label_document": iv.orphans(t["labels"], "doc_id", t["documents"], "doc_id"), "label_value": t["labels"].where("quality not in (0, 1) or toxic not in (0, 1)"),
        "document_chars": t["documents"].where("n_chars != char_length(text)"), "turn_twice": iv.repeats(t["conversations"], "conv_id", "turn"),
    })


@query("SELECT user_id AS key, " + "CASE " + " ".join(f"WHEN bool_or(event_type = '{s}') THEN '{s}'" for s in _STRENGTH) + " END AS status, count(*) AS stated FROM events GROUP BY user_id")
def strongest_status(spark: SparkSession, d: str) -> DataFrame:
    return iv.strongest(_read(spark, d, "events"), "user_id", F.col("event_type"), _STRENGTH)
