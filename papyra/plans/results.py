"""Repairs, deliveries and whole runs as queries: written cases, and tables beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import values
from papyra.operators import concerns as cn
from papyra.operators import criticality as cr
from papyra.operators import delivery as dl
from papyra.operators import qa
from papyra.operators import repair as rp
from papyra.operators import requirements as rq
from papyra.plans.cases import cases, document_cases
from papyra.plans.catalog import _LINES, _read, _rows, query
from papyra.plans.clauses import _CONCERNS, _SCOPES, LEXICON, _arr, _atom_rows, _fv, _pos, _split_marks, cells_of
from papyra.plans.layout import _made, _sql

_two = lambda c, i: F.split(c, r"\|")[i]

cases("repeated_phrases", rp.without_repeats, [("具备有效的营业 执照 执照，准", "具备有效的营业 执照，准"), ("供应商名称 供应商名称 供应商名称 与", "供应商名称 与"), ("甲 甲", "甲 甲"), ("没有重复", "没有重复"), (None, None)])
cases("doubled_phrases", rp.without_doubling, [("起给甲方起给甲方的", "起给甲方的"), ("人人平等", "人人平等"), ("检测报告检测报告检测报告", "检测报告"), (None, None)])
cases("overlaps", lambda c: rp.without_overlap(_two(c, 0), _two(c, 1)), [("应付之日 起给甲方|起给甲方 的支付宽限期", "的支付宽限期"), ("甲乙丙|丁", "丁"), ("甲乙丙丁戊|乙丙丁戊", ""), ("一二三四|三四五六", "三四五六"), ("|abc", "abc"), ("全部文字在内|文字在内", "")])
cases("distinct_segments", rp.distinct_segments, [("甲乙；甲乙；丙", "甲乙；丙"), ("视为交付完成；签字后视为交付完成", "签字后视为交付完成"), ("甲", "甲"), ("", ""), ("甲 乙;甲乙丙", "甲乙丙"), (None, None)])
cases("numeric_fragments", rp.numeric_fragment, [("剩余 %，剩余 5%%，剩余 5%作为质保金", "剩余 5%作为质保金"), ("剩余 %", "剩余 %"), ("付款 30% ，其余70%", "付款 30%，其余70%"), ("（ 5天", "（5天"), (None, None)])
cases("incomplete_fragments", lambda c: rp.is_incomplete(c).cast("string"), [("》的通知", "true"), ("意见》的规定执行", "true"), ("并且提供", "true"), ("投标人应当", "false"), ("《办法》规定", "true"), ("按《办法》执行", "false"), ("）说明", "true"), (None, None)])
cases("internal_clauses", lambda c: F.concat_ws(",", rp.is_internal(c, "评标委员会|采购人", "组建|评审|复核", "投标人.{0,6}(?:应|须)").cast("string"), rp.is_fee(c, ("售价", "工本费")).cast("string")), [
    ("评标委员会负责评审", "true,false"), ("采购人组建小组，投标人应配合", "false,false"), ("招标文件售价500元", "false,true"), ("保证金不含售价", "false,false"), ("普通", "false,false"),
])
_ACTIONS = [("SUBMIT", "提交|递交"), ("SIGN", "签字|盖章"), ("PAY", "支付|缴纳")]
_MODALITY = [("MUST_NOT", "不得|禁止|严禁"), ("MUST", "应当|必须|须"), ("MAY", "可以|可")]
cases("clause_classes", lambda c: F.concat_ws(",", rp.first_of(c, _MODALITY, "INFORMATIONAL"), rp.first_of(c, _ACTIONS), rp.first_of(c, [("BIDDER", "投标人|供应商"), ("COMMITTEE", "评标委员会"), ("PURCHASER", "采购人")], "OTHER")), [
    ("投标人必须提交保函", "MUST,SUBMIT,BIDDER"), ("不得转包，应当签字", "MUST_NOT,SIGN,OTHER"), ("采购人可以支付", "MAY,PAY,PURCHASER"), ("说明文字", "INFORMATIONAL,,OTHER"), ("评标委员会与供应商", "INFORMATIONAL,,BIDDER"),
])
_BY_NAME, _BY_CONTEXT = [("OPENING", "不见面开标"), ("TRANSACTION", "交易平台|交易系统"), ("SERVICE", "采购平台")], [("OPENING", "开标|解密"), ("UPLOAD", "上传|递交")]
cases("platform_roles", lambda c: rp.role_of(_two(c, 0), _two(c, 1), _BY_NAME, _BY_CONTEXT), [("甲省交易平台|在此开标", "TRANSACTION"), ("乙平台|请 上传 文件", "UPLOAD"), ("丙平台|其他", "UNKNOWN"), ("|开标", "UNKNOWN"), ("不见面 开标大厅|", "OPENING")])
cases("clause_segments", lambda c: _arr(rp.segments(c)), [("1、提供保函；2、提供承诺。其他", "提供保函 ¦ 提供承诺 ¦ 其他"), ("（1）甲（2）乙", "甲（2）乙"), ("", ""), ("版本1.2、说明", "版本1.2、说明")])
cases("owned_segments", lambda c: _arr(rp.owned_segments(c, "验收|交付", "运输|费用")), [
    ("设备单价中含运输费，安装调试完毕，甲方验收后，视为交付完成。", "甲方验收后，视为交付完成"), ("验收合格；费用自理", "验收合格"), ("运输费用", ""), ("验收费用，甲方交付，乙方交付，运输", "甲方交付，乙方交付"), ("交付", "交付"),
])
cases("contract_breaches", lambda c: _arr(rp.breaches(c, [("NO_SUBJECT", "投标人|供应商", ""), ("HAS_PRICE", "", "报价|价格"), ("NO_DUTY", "应|须", "")])), [("投标人应报价", "HAS_PRICE"), ("普通", "NO_SUBJECT ¦ NO_DUTY"), ("供应商须提供", "")])
cases("exit_codes", lambda c: dl.exit_code(c).cast("string"), [("PARSED", "0"), ("UNSUPPORTED_FORMAT", "2"), ("PARSE_ERROR", "3"), ("OCR_REQUIRED", "4"), ("OTHER", None), (None, None)])
cases("locator_texts", lambda c: tx.locator_text(_two(c, 0), _two(c, 1).try_cast("int"), _two(c, 2).try_cast("int"), _two(c, 2).try_cast("int"), _two(c, 3).try_cast("int"), _two(c, 4).try_cast("int")), [
    ("pdf_block|3|0||", "page 3, block 1"), ("pdf_table_cell|2|1|0|4", "page 2, table 2, row 1, cell 5"), ("docx_paragraph||6||", "paragraph 7"), ("docx_table_cell||0|2|1", "table 1, row 3, cell 2"), ("other|1|1|1|1", None),
])


def _ledger(docs: DataFrame) -> DataFrame:
    """Before ==: the source's lines; after it the delivered text."""
    both = docs.select("doc_id", F.split("text", "\n==\n").alias("p"))
    atoms = both.select("doc_id", F.posexplode(F.split(F.col("p")[0], "\n")).alias("n", "t")).select("doc_id", "n", tx.squeezed(F.col("t")).alias("key"))
    out = dl.text_ledger(atoms, both.select("doc_id", tx.squeezed(F.col("p")[1]).alias("key")), 4)
    return _fv(out, "n", F.concat_ws("/", "place", "note"))


document_cases("text_ledger", _ledger, [
    ("甲乙丙丁\n戊己庚辛\n==\n甲乙丙丁戊己庚辛", [("0", "1/"), ("1", "5/")]), ("甲乙丙丁\n戊己庚辛\n==\n戊己庚辛甲乙丙丁", [("0", "5/"), ("1", "1/OUT_OF_ORDER")]), ("甲乙丙丁\n缺\n==\n甲乙丙丁甲乙丙丁", [("0", "1/TOO_OFTEN"), ("1", "0/MISSING")]), ("甲\n甲\n==\n甲甲", [("0", "1/"), ("1", "2/")]),
])


def _items_of(docs: DataFrame) -> DataFrame:
    c = cells_of(docs)
    return c.select("doc_id", F.lit("pdf_table_cell").alias("kind"), "page", F.lit(None).cast("int").alias("block"), "table", "row", "col", "text", "pos")


def _rendered(docs: DataFrame) -> DataFrame:
    lines = _pos(docs).select("doc_id", F.lit("pdf_block").alias("kind"), "page", F.col("k").alias("block"), *(F.lit(None).cast("int").alias(x) for x in ("table", "row", "col")), "text", "pos")
    return _fv(dl.rendered_lines(lines), "pos", "line")


document_cases("rendered_lines", _rendered, [("甲\n\n乙\n--\n丙", [("100", "[PDF:P:1:B:0] 甲"), ("102", "[PDF:P:1:B:2] 乙"), ("200", "[PDF:P:2:B:0] 丙")])])
document_cases("rendered_cells", lambda d: _fv(dl.rendered_lines(_items_of(d)), "pos", "line"), [("甲|乙\n|丙", [("0", "[PDF:T:1:T:0:R:0:C:0] 甲"), ("1", "[PDF:T:1:T:0:R:0:C:1] 乙"), ("101", "[PDF:T:1:T:0:R:1:C:1] 丙")])])


def _typed(field: Column, text: Column) -> Column:
    return F.when(field == "price", values.money(text)).when(field == "term", values.duration(text)).otherwise(values.typed("text", text))


def _proposals(docs: DataFrame) -> DataFrame:
    """Before ==: a table; after it proposals: row, column, field, value, evidence, parted by bars."""
    both = docs.select("doc_id", F.split("text", "\n==\n").alias("p"))
    items = _items_of(both.select("doc_id", F.col("p")[0].alias("text")))
    p = both.select("doc_id", F.posexplode(F.split(F.col("p")[1], "\n")).alias("n", "t")).withColumn("x", F.split("t", r"\|"))
    claims = p.select("doc_id", F.lit("pdf_table_cell").alias("kind"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("block"), F.lit(0).alias("table"), F.col("x")[0].cast("int").alias("row"), F.col("x")[1].cast("int").alias("col"), "n", F.col("x")[2].alias("field"), F.col("x")[3].alias("value"), F.col("x")[4].alias("evidence"))
    return _fv(dl.judged_proposals(claims, items, _typed), "n", "verdict")


document_cases("judged_proposals", _proposals, [
    ("限价 5万元|工期90天\n==\n0|0|price|5万元|限价5万元\n0|0|price|50000元|限价 5万元\n0|9|price|5万元|限价\n0|1|term|90天|工期为90天\n0|1|price|工期|工期90天\n0|1|name|别的|工期90天", [("0", "accepted"), ("1", "accepted"), ("2", "no such place"), ("3", "evidence is not there"), ("4", "no value of the field"), ("5", "value is not in the evidence")]),
])
document_cases("marker_meanings", lambda d: _fv(dl.marker_meanings(_pos(d), [("SUBSTANTIVE", ("实质性",)), ("PROOF", ("证明材料",)), ("SCORING", ("扣分",))]), "mark", "means"), [
    ("带*的条款为实质性要求\n标注★的须提供证明材料\n★不满足扣分", [("*", "SUBSTANTIVE"), ("★", "PROOF")]), ("★重要", []), ("▲扣分", [("▲", "SCORING")]),
])
document_cases("marker_evidence", lambda d: _fv(dl.marker_evidence(dl.marker_occurrences(_pos(d))), "about", F.concat_ws("/", "pos", "mark", "times")), [("★1.2 甲\n*1.2 甲\n★乙\n丙", [("1.2", "100/★/2"), ("乙", "102/★/1")]), ("无", [])])
document_cases("clause_order", lambda d: _fv(dl.clause_order(_pos(d).select("doc_id", F.col("pos").alias("id"), "text", F.lit("").alias("section"), rq.extracted_values(F.col("text")).alias("values")), ("保证金",), ("前附表",)), "id", "place"), [
    ("普通\n保证金见http://x\n保证金5万元\n保证金", [("102", "1"), ("103", "2"), ("101", "3"), ("100", "4")]),
])
document_cases("identity_columns", lambda d: _fv(dl.identity_columns(cells_of(d).withColumn("width", F.when(F.col("col") == 0, 10.0).otherwise(100.0))), F.concat_ws(".", "table", "col"), F.lit("identity")), [
    ("1|这是一段很长很长的文字说明内容|短\n2|另一段很长很长的文字说明内容呢|短", [("0.0", "identity")]), ("|甲\n|乙", [("0.1", "identity")]), (None, []),
])


def _schedule_atoms(docs: DataFrame) -> DataFrame:
    """Lines that begin with > are deciding rows: >clause value; others atoms."""
    rows = _atom_rows(docs)
    d = rows.where("text like '>%'").select("doc_id", F.col("atom").alias("row_id"), F.regexp_extract("text", r"^>([0-9.]+)", 1).alias("clause"), "page", F.regexp_replace("text", r"^>[0-9.]+\s*", "").alias("value"))
    return _fv(dl.schedule_atoms(d, rows.where("text not like '>%'")), "row_id", F.coalesce("atom", F.lit("none")))


document_cases("schedule_atoms", _schedule_atoms, [("1.2 工期30天\n1.2 工期30天整\n>1.2 30天\n>1.3 30天", [("A102", "A100"), ("A103", "none")]), ("1.2 工期30天\n--\n>1.2 30天", [("A200", "none")])])


def _review(docs: DataFrame) -> DataFrame:
    """A whole run: requirements to atoms to concerns, with what is rejecting and the risk of each."""
    units = rq.index(docs.select("doc_id", F.lit(0).alias("pos"), "text"), LEXICON)
    own = cn.classified(cn.atoms(units.select("doc_id", "id", "text")), _CONCERNS).join(units.select("doc_id", "id", "mandatory", "high_risk", "clause", "risk"), ["doc_id", "id"])
    own = own.withColumns({"scope": cr.consequence(F.col("text"), _SCOPES), "n": F.col("k")}).withColumn("rejected", F.col("scope") == "RESPONSE_REJECTION")
    flagged = cr.criticality(own.withColumns({"marker": F.lit(False), "means": F.lit(""), "wording": F.col("text").contains("实质性"), "legal": F.lit(False), "referred": F.lit(False)}))
    level = cr.strongest_of(flagged, ["doc_id", "concern"])
    groups = cn.actionable(cn.grouped(own), ("UNCLASSIFIED",)).join(level, ["doc_id", "concern"])
    risk = cr.risk(F.lit("medium"), F.col("level"), F.col("rejects"), F.lit("BID_RESPONSE"))
    return _fv(groups, "concern", F.concat_ws("/", F.col("actionable").cast("string"), "level", risk))


document_cases("review_rows", _review, [
    ("投标人必须提交保证金5万元。\n未提交保函的，将否决其投标。", [("BOND", "true/SUBSTANTIVE_REJECTION/veto")]), ("投标人必须响应实质性条款的要求。", [("UNCLASSIFIED", "true/SUBSTANTIVE/high")]), ("普通说明", []),
])


def _marked_levels(docs: DataFrame) -> DataFrame:
    """Atoms with their level where the document says what its marks mean."""
    a, m = _split_marks(docs)
    means = dl.marker_meanings(_pos(docs), [("SUBSTANTIVE", ("实质性",)), ("PROOF", ("证明材料",))]).where("mark = '★'").select("doc_id", "means")
    routes = cr.marked_atoms(a, m).select("doc_id", "atom").distinct().withColumn("marker", F.lit(True))
    own = a.join(routes, ["doc_id", "atom"], "left").join(means, "doc_id", "left")
    flags = own.withColumns({"marker": F.coalesce("marker", F.lit(False)), "means": F.coalesce("means", F.lit("")), **{c: F.lit(False) for c in ("wording", "legal", "referred", "rejected")}})
    return _fv(cr.criticality(flags), "atom", F.concat_ws("/", "level", "basis"))


document_cases("marked_levels", _marked_levels, [("★1.2 供货期\n1.2 供货\n带★的为实质性要求", [("A101", "SUBSTANTIVE/SOURCE_MARKER"), ("A102", "ORDINARY")]), ("★1.2 供货期\n1.2 供货\n其他", [("A101", "ORDINARY"), ("A102", "ORDINARY")])])


@query(f"""WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, regexp_matches(trim(text, ' '), '([、，,：:（(]|[（(]?[0-9]{{1,2}}[）)、.])$') AS cut, len(list_filter(list_transform(regexp_split_to_array(text, '[。；;，,\\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 24)) > len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[。；;，,\\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 24))) AS twice FROM lines""")
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    tag = lambda df, name: df.select("doc_id", "pos", F.lit(True).alias(name))
    both = rows.select("doc_id", "pos").join(tag(qa.cut_lists(rows), "cut"), ["doc_id", "pos"], "left").join(tag(qa.said_twice(rows), "twice"), ["doc_id", "pos"], "left")
    return both.select("doc_id", "pos", F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce("twice", F.lit(False)).alias("twice"))


_BOXES = {"doc_id": "l_suppkey", "table": "l_partkey % 3", "row": "l_linenumber", "col": "l_quantity", "x0": "l_partkey % 7", "y0": "l_orderkey % 5", "x1": "l_partkey % 7 + 5", "y1": "l_orderkey % 5 + 5"}


@query(f"""SELECT doc_id, "table", min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM ({_sql('lineitem', {(f'"{k}"' if k in ('table', 'row') else k): v for k, v in _BOXES.items()})}) GROUP BY doc_id, "table", x0, y0, x1, y1 HAVING count(*) > 1""")
def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return dl.merged_ranges(_read(spark, d, "lineitem").selectExpr(*(f"{x} as `{n}`" for n, x in _BOXES.items())))


_DRAWN = {"page": "l_suppkey", "id": "l_orderkey * 10 + l_linenumber", "x0": "l_partkey % 50", "x1": "l_partkey % 50 + l_quantity", "y0": "l_orderkey % 90", "y1": "l_orderkey % 90 + l_linenumber % 4"}
_KIND_SQL = f"SELECT *, CASE WHEN y1 - y0 <= 1.5 AND x1 - x0 >= 5 THEN 'horizontal' WHEN x1 - x0 <= 1.5 AND y1 - y0 >= 5 THEN 'vertical' ELSE 'artwork' END AS kind FROM ({_sql('lineitem', _DRAWN)})"


@query(f"SELECT page, count(*) FILTER (WHERE kind = 'artwork') AS artwork, count(*) AS drawings FROM ({_KIND_SQL}) GROUP BY page")
def artwork_counts(spark: SparkSession, d: str) -> DataFrame:
    return dl.artwork_counts(dl.vector_lines(_made(spark, d, "lineitem", _DRAWN)))


_TRACE = {"page": "o_custkey", "mode": "o_orderkey % 3", "x0": "CAST(o_orderkey % 4 * 10 AS DOUBLE)", "x1": "CAST(o_orderkey % 4 * 10 + 10 AS DOUBLE)", "y0": "CAST(o_orderkey % 5 AS DOUBLE) / 2"}
_SPANS = {"page": "o_custkey", "id": "o_orderkey", "x0": "CAST(o_orderkey % 30 AS DOUBLE)", "x1": "CAST(o_orderkey % 30 + 8 AS DOUBLE)", "y0": "CAST(o_orderkey % 7 AS DOUBLE) / 2"}


@query(f"""WITH t AS ({_sql('orders', _TRACE)}), s AS ({_sql('orders', _SPANS)}), d AS (SELECT DISTINCT page, x0, x1, y0 FROM t a WHERE mode IN (1, 2) AND EXISTS (SELECT 1 FROM t f WHERE f.mode = 0 AND f.page = a.page AND f.x0 = a.x0 AND f.x1 = a.x1 AND abs(f.y0 - a.y0) <= 0.6))
SELECT s.page, s.id FROM s JOIN d ON d.page = s.page AND abs(d.y0 - s.y0) <= 0.6 AND d.x0 < s.x1 AND d.x1 > s.x0 GROUP BY s.page, s.id, s.x1, s.x0 HAVING sum(least(s.x1, d.x1) - greatest(s.x0, d.x0)) >= 0.5 * (s.x1 - s.x0)""")
def bold_by_stroke(spark: SparkSession, d: str) -> DataFrame:
    return dl.bold_by_stroke(_made(spark, d, "orders", _TRACE), _made(spark, d, "orders", _SPANS))


_TOKENS, _TARGETS = {"doc_id": "o_custkey", "table": "o_orderkey % 3", "token": "o_orderpriority"}, {"doc_id": "o_custkey", "target": "o_orderkey", "text": "concat(o_orderpriority, '/', CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' ELSE '' END)"}


@query(f"""WITH s AS ({_sql('orders', {(f'"{k}"' if k == 'table' else k): v for k, v in _TOKENS.items()})}), t AS ({_sql('orders', _TARGETS)}), n AS (SELECT doc_id, "table", count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT s.doc_id, s."table", t.target, count(*) AS k FROM s JOIN t ON t.doc_id = s.doc_id AND contains(t.text, s.token) GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, "table" ORDER BY k DESC, target) = 1)
SELECT n.doc_id, n."table", b.target, round(coalesce(b.k, 0) / n.n, 4) AS share FROM n LEFT JOIN b ON b.doc_id = n.doc_id AND b."table" = n."table" """)
def best_tables(spark: SparkSession, d: str) -> DataFrame:
    return dl.best_tables(_read(spark, d, "orders").selectExpr(*(f"{x} as `{n}`" for n, x in _TOKENS.items())), _made(spark, d, "orders", _TARGETS))


_VIEW = {"doc_id": "o_custkey", "id": "o_orderkey", "marked": "o_orderkey % 5 = 0", "substantive": "o_orderkey % 7 = 0", "rejects": "o_orderkey % 11 = 0", "type": "o_orderpriority", "risk": "CASE WHEN o_orderkey % 13 = 0 THEN 'veto' ELSE 'low' END", "stage": "CASE WHEN o_orderkey % 3 = 0 THEN 'CONTRACT_RISK_NOTICE' ELSE 'BID_RESPONSE' END"}


@query(f"""SELECT doc_id, id FROM ({_sql('orders', _VIEW)}) WHERE stage <> 'CONTRACT_RISK_NOTICE' AND (marked OR substantive OR rejects OR type IN ('1-URGENT') OR risk IN ('veto'))""")
def mandatory_view(spark: SparkSession, d: str) -> DataFrame:
    return dl.mandatory(_made(spark, d, "orders", _VIEW), ("1-URGENT",), ("veto",)).select("doc_id", "id")


_CITED = {"doc_id": "o_custkey", "page": "o_orderkey % 3", "id": "o_orderkey", "excerpt": "CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END"}


@query(f"""WITH c AS (SELECT *, replace(excerpt, ' ', '') AS k FROM ({_sql('orders', _CITED)}) WHERE trim(excerpt) <> ''), g AS (SELECT doc_id, page, k, min(excerpt) AS excerpt, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM c GROUP BY doc_id, page, k)
SELECT doc_id, printf('EV%04d', row_number() OVER (PARTITION BY doc_id ORDER BY page, k)) AS evidence, page, excerpt, ids FROM g""")
def evidence_index(spark: SparkSession, d: str) -> DataFrame:
    return dl.evidence_index(_made(spark, d, "orders", _CITED)).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


_CHECKED = {"doc_id": "o_custkey", "check_id": "o_orderpriority", "status": "CASE WHEN o_orderkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END"}
_FACTED = {"doc_id": "o_custkey", "field": "o_orderpriority", "status": "CASE WHEN o_orderkey % 5 = 0 THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END"}


@query(f"""SELECT doc_id, 'fact' AS kind, field AS name, status AS why FROM ({_sql('orders', _FACTED)}) WHERE status <> 'RESOLVED' UNION ALL SELECT doc_id, 'check', check_id, status FROM ({_sql('orders', _CHECKED)}) WHERE status <> 'PASS'""")
def exceptions_view(spark: SparkSession, d: str) -> DataFrame:
    return dl.exceptions(_made(spark, d, "orders", _FACTED), _made(spark, d, "orders", _CHECKED))


_RULED = {"doc_id": "l_suppkey", "canonical": "l_partkey % 2 = 0", "applicable": "l_partkey % 3 <> 0", "delivered": "l_quantity > 10", "visible": "l_linenumber < 5"}


@query(f"""SELECT doc_id, count(*) AS raw, count(*) FILTER (WHERE canonical) AS canonical, count(*) FILTER (WHERE canonical AND applicable) AS applicable, count(*) FILTER (WHERE canonical AND applicable AND delivered) AS delivered, count(*) FILTER (WHERE canonical AND applicable AND delivered AND visible) AS visible FROM ({_sql('lineitem', _RULED)}) GROUP BY doc_id""")
def rule_ledger(spark: SparkSession, d: str) -> DataFrame:
    return qa.ledger(_made(spark, d, "lineitem", _RULED))


@query("SELECT count(*) FILTER (WHERE l_quantity > 40) AS large, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linenumber = 1) AS first FROM lineitem")
def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    return qa.flagged(_read(spark, d, "lineitem"), {"large": F.col("l_quantity") > 40, "returned": F.col("l_returnflag") == "R", "first": F.col("l_linenumber") == 1})


def _unit_rows(docs: DataFrame) -> DataFrame:
    """Pages as in _pos(); lines with bars are rows of one table a page."""
    rows = _pos(docs)
    bar = F.col("text").contains("|")
    cells = rows.where(bar).select("doc_id", "page", F.col("page").alias("table"), F.col("k").alias("row"), "pos", F.posexplode(F.split("text", r"\|")).alias("col", "text"))
    return _fv(cn.units_of(rows.where(~bar), cells), "unit", F.concat_ws("/", "kind", "clause", "heading", "text"))


document_cases("built_units", _unit_rows, [
    ("第一章 总则\n1.2|工期|30天\n|质保|2年\n--\n1.3.1 正文内容说明文字，完整", [("EU0001", "block//第一章 总则/第一章 总则"), ("EU0002", "row/1.2/第一章 总则/1.2 | 工期 | 30天"), ("EU0003", "row/1.2/第一章 总则/质保 | 2年"), ("EU0004", "block/1.3.1/第一章 总则/1.3.1 正文内容说明文字，完整")]),
])
_FACETS = [("c", "COST", "费用"), ("a", "ACCEPT", "验收")]
document_cases("atom_facets", lambda d: _fv(cn.facets(cn.classified(_atom_rows(d), [cn.ConcernRule("ACCEPT", all_of=("合格",))]), _FACETS), "atom", "concern"), [("含费用，经验收", [("A100.c", "COST"), ("A100.a", "ACCEPT")]), ("含费用，经验收\n合格", [("A100.c", "COST")]), ("其他", [])])


def _owned(docs: DataFrame) -> DataFrame:
    rows = _atom_rows(docs).withColumn("id", F.col("n"))
    found = cn.numbers(rows.select("doc_id", "id", "text"), [cn.Role("MONEY", "元"), cn.Role("SPAN", "天|年")])
    members = cn.classified(rows, _CONCERNS).select("doc_id", "concern", "id")
    return _fv(cn.owned_numbers(found, members, [("BOND", "MONEY"), ("UNCLASSIFIED", "SPAN")]), "concern", F.array_join("numbers", ","))


document_cases("owned_numbers", _owned, [("保证金5万元，30天\n保函5万元和6万元\n工期9天", [("BOND", "MONEY:5万元,MONEY:6万元"), ("UNCLASSIFIED", "SPAN:9天")]), ("保函30天", [])])
document_cases("rendered_points", lambda d: _fv(cn.rendered(cn.classified(_atom_rows(d), _CONCERNS), {"BOND": "Check the bond: {text} (page {page}, {clause})"}), "atom", "rendered"), [("1.2 保证金", [("A100", "Check the bond: 1.2 保证金 (page 1, 1.2)")]), ("其他{text}", [("A100", "其他{text}")])])


def _primary(docs: DataFrame) -> DataFrame:
    rows = cn.classified(_atom_rows(docs), _CONCERNS).withColumn("mandatory", F.col("text").contains("必须"))
    return _fv(cn.primary_sources(rows, {"BOND": ("保证金", "金额")}), "concern", F.concat_ws("/", "atom", "members"))


document_cases("primary_sources", _primary, [("提交保函\n保证金金额\n必须交保证金5元", [("BOND", "A101/3")]), ("保证金一\n必须交保证金二", [("BOND", "A101/2")]), ("保证金一\n保证金5元", [("BOND", "A101/2")]), ("甲\n乙", [("UNCLASSIFIED", "A100/2")])])

_REL = {"doc_id": "o_custkey", "id": "o_orderkey", "concern": "CASE o_orderkey % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'SEGMENT' ELSE 'OTHER' END", "atom": "o_orderkey"}


@query(f"""WITH i AS ({_sql('orders', _REL)}), f AS (SELECT c_custkey AS doc_id, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 2 = 0), x AS (SELECT *, CASE concern WHEN 'NAME' THEN 'name' WHEN 'SEGMENT' THEN 'segment' END AS field FROM i)
SELECT x.doc_id, x.id, x.concern, x.field, f.value AS fact, CASE WHEN x.id % 5 = 0 THEN 'D' || x.id END AS decision FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.field = x.field""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    facts = c.selectExpr("c_custkey doc_id", "'name' field", "c_name value", "'RESOLVED' status").unionByName(c.selectExpr("c_custkey doc_id", "'segment' field", "c_mktsegment value", "CASE WHEN c_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'NOT_FOUND' END status"))
    decisions = _read(spark, d, "orders").where("o_orderkey % 5 = 0").selectExpr("o_custkey doc_id", "o_orderkey atom", "concat('D', o_orderkey) value")
    return cn.related(_made(spark, d, "orders", _REL), facts, decisions, {"NAME": "name", "SEGMENT": "segment"})


_LINE = {"page": "o_custkey", "line": "o_orderkey", "x0": "o_orderkey % 50 + 2", "x1": "o_orderkey % 50 + 6", "y0": "o_orderkey % 30 + 2", "y1": "o_orderkey % 30 + 4"}
_IN = {"page": "o_custkey", "block": "o_orderkey", "x0": "o_orderkey % 40", "x1": "o_orderkey % 40 + 30", "y0": "o_orderkey % 20", "y1": "o_orderkey % 20 + 15 + o_orderkey % 5"}


@query(f"""WITH s AS ({_sql('orders', _LINE, 'o_orderkey % 2 = 1')}), b AS ({_sql('orders', _IN, 'o_orderkey % 2 = 0')}), m AS (SELECT s.page, s.line, b.block, row_number() OVER (PARTITION BY s.page, s.line ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.block) AS k FROM s JOIN b ON s.page = b.page AND s.x0 >= b.x0 - 1 AND s.y0 >= b.y0 - 1 AND s.x1 <= b.x1 + 1 AND s.y1 <= b.y1 + 1)
SELECT s.page, s.line, m.block FROM s LEFT JOIN m ON m.page = s.page AND m.line = s.line AND m.k = 1""")
def lines_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    from papyra.operators import geometry as ge

    return ge.lines_of_blocks(_made(spark, d, "orders", _LINE, "o_orderkey % 2 = 1"), _made(spark, d, "orders", _IN, "o_orderkey % 2 = 0"))

_BLK = {"doc_id": "o_custkey", "page": "o_orderkey % 2", "pos": "o_orderkey", "x0": "o_orderkey % 30", "x1": "o_orderkey % 30 + 10", "y0": "o_orderkey % 50", "y1": "o_orderkey % 50 + 4", "text": "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END"}
_TBL = {"doc_id": "o_custkey", "page": "o_orderkey % 2", "x0": "0", "x1": "25", "y0": "o_orderkey % 40", "y1": "o_orderkey % 40 + 6"}
_CELL = {"doc_id": "o_custkey", "page": "o_orderkey % 2", "table": "0", "row": "o_orderkey % 3", "col": "o_orderkey", "pos": "o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 10000000 END", "text": "concat(' ', o_orderstatus)"}
_QCELL = {(f'"{k}"' if k in ("table", "row") else k): v for k, v in _CELL.items()}


@query(f"""WITH b AS ({_sql('orders', _BLK)}), t AS ({_sql('orders', _TBL, 'o_orderkey % 5 = 0')}), c AS ({_sql('orders', _QCELL, 'o_orderkey % 2 = 0')}),
f AS (SELECT doc_id, page, pos, text, '' AS context, 'block' AS kind FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 - 1 AND t.x1 + 1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 - 1 AND t.y1 + 1)
UNION ALL SELECT doc_id, page, pos, text, string_agg(trim(text, ' '), ' | ') OVER (PARTITION BY doc_id, page, "table", "row" ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'cell' FROM c)
SELECT doc_id, page, pos, text, context, kind FROM f WHERE replace(text, ' ', '') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY kind, text) = 1""")
def source_fragments(spark: SparkSession, d: str) -> DataFrame:
    from papyra.operators import geometry as ge

    cells = _read(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr(*(f"{x} as `{n}`" for n, x in _CELL.items()))
    return ge.source_fragments(_made(spark, d, "orders", _BLK), cells, _made(spark, d, "orders", _TBL, "o_orderkey % 5 = 0"))


def _retrieval(docs: DataFrame) -> DataFrame:
    from papyra.operators import evidence as ev
    from papyra.plans.clauses import RULES, WORDS, _paged

    rows = _paged(docs)
    top = ev.scored(rows, RULES, WORDS)
    states = ev.states(ev.pruned(top, WORDS), top, docs.select(F.col("doc_id").alias("key")), RULES, rows, WORDS, elsewhere=("R3",))
    out = ev.retrieval_stats(states, top).withColumnRenamed("key", "doc_id")
    return _fv(out, F.lit("stats"), F.concat_ws("/", "found", "several", "review", "missing", "hits"))


document_cases("retrieval_stats", _retrieval, [("投标人必须在截止时间前提交投标保证金，金额为五万元整。", [("stats", "1/0/0/2/1")]), ("联合体示例，必须按照格式填写下面的各个表格。", [("stats", "0/0/1/2/1")]), (None, [("stats", "0/0/0/3/0")])])


def _tender_index(docs: DataFrame) -> DataFrame:
    from papyra.functions.lexicons import TENDERS

    units = rq.index(docs.select("doc_id", F.lit(0).alias("pos"), "text"), TENDERS)
    return _fv(units, "id", F.concat_ws("|", "type", "mandatory", "high_risk", F.array_join("markers", ","), "clause", F.array_join("merged", ",")))


document_cases("tender_requirements", _tender_index, [
    ("3.4.2 供应商不按本章第3.4.1项要求提交响应保证金的，评审小组将否决其响应。", [("SR0001", "REJECTION|false|true|否决|3.4.2|")]), ("投标人必须提供营业执照。投标人必须 提供营业执照。", [("SR0001", "OTHER|true|false|必须,须提供||SR0002")]),
    ("评标委员会应当推荐三名候选人。", []), ("评标委员会应当要求投标人说明理由。", [("SR0001", "OTHER|true|false|应当||")]), ("目录....1", []), ("失信被执行人、经营异常名录中的单位，不得存在下列情形。", [("SR0001", "REJECTION|true|false|不得||")]),
    ("代理机构应当公告结果信息。", []), ("质保期不少于24个月；", [("SR0001", "OTHER|true|false|不少于||")]),
])
