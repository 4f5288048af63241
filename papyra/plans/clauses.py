"""Clauses, requirements, evidence and concerns on written cases: texts of documents, each with the rows that were written down for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import concerns as cn
from papyra.operators import criticality as cr
from papyra.operators import evidence as ev
from papyra.operators import facts as fa
from papyra.operators import fragments as fr
from papyra.operators import requirements as rq
from papyra.plans.cases import _ALL, _NAME, _OWNER, cases, document_cases

#: A small lexicon of the demonstration queries.
LEXICON = rq.Lexicon(
    strong=("否决", "无效投标"), mandatory=("必须", "应当", "不得"), exclusion=("失信",), criteria=("评审标准",), verbs=("提供", "提交", "填写"), navigation=("目录",), governing=("下列", "以下"),
    buyers=("采购人", "招标人"), bidders=("投标人", "供应商"),
    topics=(("REJECTION", "bond missing", ("保证金",)), ("BOND", "bond", ("保证金",)), ("PRICE", "ceiling", ("最高限价",)), ("FORMAT", "form", ("格式",))),
    others=(("payment", ("付款",)), ("contract", ("合同",))), modules=(("BOND", "commercial"), ("PRICE", "commercial"), ("REJECTION", "rejection")), risks=(("REJECTION", "veto"), ("BOND", "high")),
)

_arr = lambda c: F.array_join(c, " ¦ ")
_fv = lambda df, f, v: df.select("doc_id", F.col(f).cast("string").alias("field") if isinstance(f, str) else f.cast("string").alias("field"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value"))


def cells_of(docs: DataFrame) -> DataFrame:
    """Tables written as text: tables apart by a line of ##, rows by lines, cells by bars; each table is on a page of its own, from 1."""
    table = docs.select("doc_id", F.posexplode(F.split("text", "\n##\n")).alias("table", "t"))
    row = table.select("doc_id", "table", F.posexplode(F.split("t", "\n")).alias("row", "r"))
    cell = row.select("doc_id", "table", "row", F.posexplode(F.split("r", r"\|")).alias("col", "text"))
    return cell.withColumns({"text": F.trim("text"), "page": F.col("table") + 1, "pos": F.col("table") * 10_000 + F.col("row") * 100 + F.col("col")})


cases("source_clauses", lambda c: _arr(rq.clauses(c)), [
    ("甲方应当提交文件一式三份。乙方不得转包给其他人；3.1投标人须知前附表内容 3.2报价的各项要求说明", "甲方应当提交文件一式三份。 ¦ 乙方不得转包给其他人； ¦ 3.1投标人须知前附表内容 ¦ 3.2报价的各项要求说明"),
    ("*1.4.5 供货期为三十个日历天整", "*1.4.5 供货期为三十个日历天整"), ("按本章第3.4.1项要求提交保证金的，将被否决；短", "按本章第3.4.1项要求提交保证金的，将被否决； 短"), ("检测实验报告需要由第三方提供 第四条", "检测实验报告需要由第三方提供 ¦ 第四条"),
    ("投标人应当具备相应资质。★\n供应商应当提供检测报告", "投标人应当具备相应资质。 ¦ ★ 供应商应当提供检测报告"), (" ", ""), (None, None), ("A", "A"),
])
cases("clause_values", lambda c: _arr(rq.extracted_values(c)), [
    ("合同价500万元，付款30%，质保24个月，2026年7月28日09时00分", "500万元 ¦ 30% ¦ 24个月"), ("3份，5台，第3名", "3份 ¦ 5台"), ("技术得分40分，扣2分", "40分 ¦ 2分"), ("1.12 分包", ""), ("90 日历天 90日历天", "90日历天"), (None, None), ("1,000.50元", "1,000.50元"), ("3 倍和 12 小时", "12小时 ¦ 3倍"),
])
cases("clause_numbers", rq.clause_number, [("*1.4.5 供货期", "1.4.5"), ("第 3.2 条 报价", "3.2"), ("见 A1.2", "A1.2"), ("见A1.2", ""), ("（2）其他", "（2）"), ("三、说明", "三、"), ("没有", ""), (None, ""), ("12 个月", "")])
cases("clause_shapes", lambda c: F.concat_ws(",", rq.ends_sentence(c).cast("string"), rq.governs(c, ("下列",)).cast("string"), rq.binds_only(c, ("采购人",), ("供应商",)).cast("string")), [
    ("有下列情形之一的：", "false,true,false"), ("采购人负责。", "true,false,true"), ("采购人和供应商；", "true,false,false"), ("说明:", "false,true,false"), ("普通，", "false,false,false"),
])


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(0).alias("pos"), "text")


_UNITS = [
    ("投标人必须提交保证金5万元。采购人负责开标会议的组织", [("SR0001", "BOND|bond|high|commercial||5万元|投标人必须提交保证金5万元。")]),
    ("有下列情形之一的，否决投标：（1）投标文件不完整的情形", [("SR0001", "REJECTION|other rejection|veto|rejection|||有下列情形之一的，否决投标：（1）投标文件不完整的情形")]),
    ("目录 第一章", []), ("供应商应当按最高限价报价。\n供应商应当按 最高限价报价。", [("SR0001", "PRICE|ceiling|medium|commercial|||供应商应当按最高限价报价。")]),
    ("★1.4.5 供货期限的特别说明内容\n投标人必须签订合同。", [("SR0001", "OTHER|contract|medium|document|||投标人必须签订合同。"), ("SR0002", "OTHER|other|medium|document|1.4.5||★1.4.5 供货期限的特别说明内容")]),
    ("招标人必须付款给第三方机构。", []), ("普通的说明文字，没有要求。", []), (None, []), ("失信的投标人不得参加本项目。", [("SR0001", "REJECTION|other rejection|veto|rejection|||失信的投标人不得参加本项目。")]),
    ("投标人须满足以下要求：\n甲级资质的企业法人；\n提交履约担保的承诺书。", []),
    ("投标人应当满足以下要求：\n甲级资质的企业法人；", [("SR0001", "OTHER|other|medium|document|||投标人应当满足以下要求："), ("SR0002", "OTHER|other|medium|document|||投标人应当满足以下要求： 甲级资质的企业法人；")]),
]


def _index(docs: DataFrame) -> DataFrame:
    u = rq.index(_whole(docs), LEXICON)
    return _fv(u, "id", F.concat_ws("|", "type", "topic", "risk", "module", "clause", F.array_join("values", ","), "text"))


document_cases("requirement_index", _index, _UNITS)
document_cases("requirement_stats", lambda d: _fv(rq.stats(_whole(d), LEXICON), F.lit("n"), F.concat_ws(",", "clauses", "kept", "rescued", "navigation", "heading", "short", "procedural")), [
    ("投标人必须提交保证金5万元。采购人负责开标会议的组织", [("n", "2,1,0,0,1,0,0")]), ("目录 第一章", [("n", "1,0,0,1,0,0,0")]), ("招标人必须付款给第三方机构。", [("n", "1,0,0,0,0,0,1")]), ("★1.4.5 供货期限的特别说明内容\n投标人必须签订合同。", [("n", "2,1,1,0,0,0,0")]),
    (" ", [("n", "1,0,0,0,0,1,0")]), ("必须", [("n", "1,0,0,0,0,1,0")]), (None, []),
])
document_cases("requirement_types", lambda d: _fv(rq.histogram(rq.index(_whole(d), LEXICON), "type"), "type", "n"), [(t, sorted({k: str(sum(v.startswith(k + "|") for _, v in found)) for k in {v.split("|")[0] for _, v in found}}.items())) for t, found in _UNITS])
document_cases("source_mentions", lambda d: _fv(rq.mentions(fr.fragments(d), "数据库"), F.lit("found"), "found"), [("安装 数据库\n其他", [("found", "true")]), ("安装软件", [("found", "false")]), (None, [])])

# Evidence.
WORDS = ev.Words(operative=("必须", "不得", "应当"), informative=("必须", "不得", "保证金", "工期", "联合体"), heading_modules=("format",), signals=("电子投标",))
RULES = [
    ev.Rule("R1", (("bond", ("保证金", "投标保证金")), ("money", ("金额",))), focus=("保证金",), positive=("必须",), negative=("无效",), priority=("前附表",)),
    ev.Rule("R2", (("joint", ("联合体",)),), focus=("联合体",), exclusions=("示例",)),
    ev.Rule("R3", (("mark", ("★", "CA")),), module="format"),
]


def _paged(docs: DataFrame) -> DataFrame:
    return fr.fragments(docs)


def _states(docs: DataFrame) -> DataFrame:
    rows = _paged(docs)
    top = ev.scored(rows, RULES, WORDS)
    out = ev.states(ev.pruned(top, WORDS), top, docs.select(F.col("doc_id").alias("key")), RULES, rows, WORDS, elsewhere=("R3",))
    return out.select(F.col("key").alias("doc_id"), F.col("rule").alias("field"), F.concat_ws(":", "state", "choices").alias("value"))


_EVIDENCE = [
    ("投标人必须在截止时间前提交投标保证金，金额为五万元整。", ["FOUND:1", "NOT_FOUND:0", "NOT_FOUND:0"]),
    ("投标人必须在截止时间前提交投标保证金，金额为五万元整。\n投标人必须在截止时间前提交投标保证金，金额为五万元整！", ["FOUND:1", "NOT_FOUND:0", "NOT_FOUND:0"]),
    ("本项目不接受联合体投标，必须独立参加本次采购活动。\n采用电子投标的方式进行。", ["NOT_FOUND:0", "FOUND:1", "NOT_APPLICABLE:0"]),
    ("联合体示例，必须按照格式填写下面的各个表格。", ["NOT_FOUND:0", "NEEDS_REVIEW:0", "NOT_FOUND:0"]), (None, ["NOT_FOUND:0"] * 3), ("★ 必须用CA签章", ["NOT_FOUND:0", "NOT_FOUND:0", "FOUND:1"]),
]
document_cases("evidence_states", _states, [(t, list(zip(("R1", "R2", "R3"), w, strict=True))) for t, w in _EVIDENCE])
document_cases("evidence_fates", lambda d: _fv(ev.pruned(ev.scored(_paged(d), RULES, WORDS), WORDS), F.concat_ws("/", "rule", "pos"), "fate"), [
    (_EVIDENCE[0][0], [("R1/0", "kept")]), (_EVIDENCE[1][0], [("R1/0", "kept"), ("R1/1", "duplicate")]), (_EVIDENCE[2][0], [("R2/0", "kept")]),
    ("必须提交保证金甲，无效的处理办法在合同里另有详细约定说明。\n必须提交保证金乙，否则按照相关的法律规定处理并且公告全体人员。", [("R1/0", "kept"), ("R1/1", "redundant")]),
])
cases("own_sections", lambda c: ev.own_section(F.split(c, r"\|")[0], F.split(c, r"\|")[1]), [("3.2 授权书|3.4 保证金", ""), ("3.4 保证金|3.4.1 金额", "3.4 保证金"), ("总则|3.4 保证金", "总则"), ("3.2 授权书|没有编号", "3.2 授权书"), ("3.4.1 金额|*3.4 保证金", "3.4.1 金额"), ("3 总|34 其他", "")])
cases("near_duplicates", lambda c: ev.contains_duplicate(tx.key(F.split(c, r"\|")[0]), tx.key(F.split(c, r"\|")[1])).cast("string"), [
    ("投标人必须提交保证金|投标人，必须提交保证金。", "true"), ("短|短的", "false"), ("一二三四五六七八九十一二三四五六七八九十|前一二三四五六七八九十一二三四五六七八九十后", "true"), ("|", "false"), ("甲乙丙|丁戊己", "false"),
])

# Tables as sources of facts, schedules and prices.
document_cases("table_label_facts", lambda d: fa.table_label(cells_of(d), _ALL), [
    ("项目名称|甲楼|工期|30天", [("name", "甲楼"), ("term", "30天")]), ("项目名称||甲楼", [("name", "甲楼")]), ("项目名称||||甲楼", []), ("项目名称|工期|30天", [("term", "30天")]), ("其他|甲楼", []), ("项目名称：|“甲楼”", [("name", "甲楼")]), ("限价|见附件", []), (None, []), ("招标人|名称：甲局", [("owner", "甲局")]),
])
_SCHEDULE = "1.2|工期|30天\n*1.4|质保|24|个月\n说明|甲|乙\n1.9|空|"
document_cases("schedule_rows", lambda d: _fv(cr.schedule_rows(cells_of(d)), "id", F.concat_ws("/", "clause", "marker", "item", "value")), [
    (_SCHEDULE, [("SCH0001", "1.2//工期/30天"), ("SCH0002", "1.4/*/质保/24；个月")]), ("1.2|工期|30天\n说明|甲|乙", []), ("甲|乙\n##\n3.1|a|b\n3.2|c|d", [("SCH0001", "3.1//a/b"), ("SCH0002", "3.2//c/d")]), (None, []),
])
document_cases("carried_clauses", lambda d: _fv(cr.carried_clauses(cells_of(d)), F.concat_ws(".", "table", "row"), "clause"), [("甲|x\n1.2|y\n乙|z\n*3.4|u\n丙|v", [("0.0", ""), ("0.1", "1.2"), ("0.2", "1.2"), ("0.3", "3.4"), ("0.4", "3.4")]), ("1.2|a\n##\n甲|b", [("0.0", "1.2"), ("1.0", "")])])
document_cases("price_rows", lambda d: _fv(cn.price_rows(cells_of(d), ("序号", "单价", "数量")), F.concat_ws(".", "table", "row"), F.to_json("cells")), [
    ("序号|名称|单价\n1|泵|5元\n合计|x|5元\n##\n2|阀|3元\n##\n3|管|1元", [("0.1", '{"0 序号":"1","1 名称":"泵","2 单价":"5元"}'), ("1.0", '{"0 序号":"2","1 名称":"阀","2 单价":"3元"}')]), ("1|泵|5元", []), ("序号|单价\n1|泵|5元", []),
])


def _clauses_and_schedule(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Before ==: a schedule; after it a line for each clause, its number before a colon."""
    both = docs.select("doc_id", F.split("text", "\n==\n").alias("p"))
    schedule = cr.schedule_rows(cells_of(both.select("doc_id", F.col("p")[0].alias("text"))), least=1)
    line = both.select("doc_id", F.posexplode(F.split(F.col("p")[1], "\n")).alias("k", "line"))
    own = line.select("doc_id", F.format_string("A%d", "k").alias("atom"), F.regexp_extract("line", "^([0-9.]+):", 1).alias("clause"), F.regexp_replace("line", "^[0-9.]+:", "").alias("text"))
    return own.withColumn("relation", cr.relation(F.col("text"), "见?前附表(?:规定)?", ("如",), ("应", "须"))), schedule, own


def _decided(docs: DataFrame) -> DataFrame:
    clauses, schedule, _ = _clauses_and_schedule(docs)
    return _fv(cr.decided(clauses, schedule), "atom", F.concat_ws("/", "relation", "via", "row_id", "value", "superseded"))


def _applied(docs: DataFrame) -> DataFrame:
    clauses, schedule, own = _clauses_and_schedule(docs)
    return _fv(cr.applied(own, cr.decided(clauses, schedule)), "atom", F.concat_ws("/", "text", "superseded", "origin"))


_APPLY = "1.2|工期|30天\n1.3|质保|见合同\n1.5|保证金|长长的五万元整\n1.5|保证金|五万\n==\n1.2:工期见前附表\n1.3:质保见前附表\n1.5.2:投标人应按前附表规定的形式和金额提交保证金\n1.2:与此无关\n9.9:见前附表"
document_cases("applicable_sources", _decided, [(_APPLY, [("A0", "RESOLVES_REFERENCE/own/SCH0001/30天/true"), ("A2", "SPECIALIZES/parent/SCH0004/五万/false")]), ("1.2|工期|30天\n==\n1.2:如分包见前附表，以下另有详细的约定内容", [("A0", "OVERRIDES/own/SCH0001/30天/true")])])
document_cases("applied_atoms", _applied, [("1.2|工期|30天\n==\n1.2:工期见前附表\n1.3:不变", [("A0", "工期见前附表/true/source"), ("A1", "不变/false/source"), ("SCH-SCH0001", "30天/false/schedule")])])
cases("parent_clauses", cr.parent_of, [("1.2.3", "1.2"), ("1.2", "1"), ("1", None), (None, None)])
cases("clause_references", lambda c: _arr(cr.references(c)), [("不按本章第3.4.1项、第 5.2 条和第3.4.1项", "3.4.1 ¦ 5.2"), ("第三章", ""), ("3.4.1 自己", ""), (None, None)])
_SCOPES = cr.Scopes(cue="否决|无效|不予受理|拒绝", rejection="否决其(?:投标|响应)|(?:投标|响应)无效", award="取消[^。]{0,8}资格|解除合同", late="逾期(?:送达|上传)", refused="不予受理|拒绝|无效", scoring="得分|扣分|评分", liability="违约金|赔偿")
cases("consequence_scopes", lambda c: cr.consequence(c, _SCOPES), [
    ("将否决其投标", "RESPONSE_REJECTION"), ("取消中标资格", "POST_AWARD"), ("逾期送达的不予受理", "LATE_SUBMISSION"), ("逾期送达", "INFORMATIONAL"), ("缺项扣分", "SCORING_ONLY"), ("支付违约金", "CONTRACT_LIABILITY"), ("拒绝说明", "INFORMATIONAL"), ("普通", ""), (None, ""), ("扣分且投标无效", "RESPONSE_REJECTION"),
])

# Concerns.
cases("atom_sentences", lambda c: _arr(cn.sentences(c, 12)), [("甲提供；乙提交。", "甲提供； ¦ 乙提交。"), ("一二三四五，六七八九十，甲乙丙丁戊", "一二三四五，六七八九十， ¦ 甲乙丙丁戊"), ("没有停顿的很长很长的一句话啊", "没有停顿的很长很长的一句话啊"), ("", ""), (None, None), ("a!b?c", "a! ¦ b? ¦ c")])
document_cases("atoms", lambda d: _fv(cn.atoms(d.withColumn("id", F.lit("SR0007"))), "atom", "text"), [("甲提供；乙提交。", [("SRA0007.1", "甲提供；"), ("SRA0007.2", "乙提交。")]), ("甲提供", [("SRA0007", "甲提供")]), (None, [])])
_CONCERNS = [cn.ConcernRule("SCORING", all_of=("评分", "标准")), cn.ConcernRule("BOND", any_of=("保证金", "保函"), none_of=("履约",)), cn.ConcernRule("PERFORMANCE", all_of=("履约",))]
document_cases("concern_classes", lambda d: _fv(cn.classified(d, _CONCERNS), F.lit("c"), "concern"), [("提交保函", [("c", "BOND")]), ("履约保证金", [("c", "PERFORMANCE")]), ("评分的标准：保证金", [("c", "SCORING")]), ("其他", [("c", "UNCLASSIFIED")]), (None, [("c", "UNCLASSIFIED")])])
cases("scoring_tiers", lambda c: F.array_join(F.transform(cn.tiers(c), lambda x: F.concat_ws("→", x["condition"], x["score"])), " ¦ "), [
    ("1、免预付款的得12分；2、预付款比例不大于15%的得8分；3、大于15%的得4分。", "免预付款→12分 ¦ 预付款比例不大于15%→8分 ¦ 大于15%→4分"), ("1、只有一项得5分", ""), ("没有编号得5分", ""), ("（1）优得5分；（2）良得3分", "优→5分 ¦ 良→3分"), (None, None),
])
cases("fill_slots", lambda c: F.array_join(F.transform(cn.fill_slots(c), lambda x: F.concat_ws("=", x["kind"], x["label"])), " ¦ "), [("投标人：____（盖章） 日期＿＿＿", "line=投标人 ¦ line=日期 ¦ hint=盖章"), ("无空", ""), ("___", "line="), (None, None)])
_ROLES = [cn.Role("BOND", "元", ("保证金",)), cn.Role("PRICE", "元", ("限价",)), cn.Role("RETENTION", "[%％]", ("质保金",)), cn.Role("DURATION", "天|个月|月|年", ("工期", "供货期")), cn.Role("SCORE", "分", ("得", "评")), cn.Role("QUANTITY", "台|套|份|项|个")]
document_cases("numeric_evidence", lambda d: _fv(cn.numbers(d.withColumn("id", F.lit(1)), _ROLES), "value", "role"), [
    ("投标保证金5万元，工期 90 日历天", [("5万元", "BOND"), ("90日历天", "DURATION")]), ("见第3页和第 4.2 条", []), ("共3台，另3台", [("3台", "QUANTITY")]), ("5%质保金", [("5%", "RETENTION")]), ("3.4.1 项要求", []), ("优得4分", [("4分", "SCORE")]), ("限价1,000.5元", [("1,000.5元", "PRICE")]), (None, []),
])
cases("unowned_parts", lambda c: _arr(cn.unowned(F.split(F.split(c, r"\|")[0], ","), F.split(F.split(c, r"\|")[1], ","))), [("a,b,c|a,c", "b"), ("a|a,b", ""), ("x,x|y", "x")])


def _pos(docs: DataFrame) -> DataFrame:
    """Lines as rows; pages are parted by a line of --."""
    page = docs.select("doc_id", F.posexplode(F.split("text", "\n--\n")).alias("p", "t"))
    return page.select("doc_id", (F.col("p") + 1).alias("page"), F.posexplode(F.split("t", "\n")).alias("k", "text")).withColumn("pos", F.col("page") * 100 + F.col("k"))


document_cases("completed_sentences", lambda d: _fv(cn.completed(_pos(d)), "pos", "whole"), [("甲\n乙。\n丙", [("100", "甲乙。"), ("101", "乙。"), ("102", "丙")]), ("一\n二\n三\n四", [("100", "一二三"), ("101", "二三四"), ("102", "三四"), ("103", "四")]), ("甲\n--\n乙。", [("100", "甲"), ("200", "乙。")])])
_head = lambda c: c.startswith("#")
document_cases("expiring_headings", lambda d: _fv(cr.headings_with_expiry(_pos(d), _head(F.col("text"))), "pos", "heading"), [("#A\nx\n--\ny\n--\nz", [("100", "#A"), ("101", "#A"), ("200", "#A"), ("300", "")]), ("x\n#B", [("100", ""), ("101", "#B")])])
document_cases("list_heads", lambda d: _fv(cr.inherited(_pos(d), F.col("text").endswith("："), F.col("text").startswith("（")), "pos", "head").where("value is not null"), [("下列：\n（1）甲\n（2）乙\n丙\n（3）丁", [("100", "100"), ("101", "100"), ("102", "100")]), ("（1）甲", [])])
document_cases("page_sections", lambda d: _fv(ev.page_sections(_pos(d)), "pos", "section"), [("正文\n第一章 总则\n--\n后文", [("100", "第一章 总则"), ("101", "第一章 总则"), ("200", "")]), ("一、甲\n二、乙", [("100", "二、乙"), ("101", "二、乙")])])


def _atom_rows(docs: DataFrame) -> DataFrame:
    rows = _pos(docs)
    return rows.select("doc_id", F.col("pos").alias("n"), F.concat(F.lit("A"), F.col("pos").cast("string")).alias("atom"), rq.clause_number(F.col("text")).alias("clause"), "page", "pos", "text", tx.squeezed(F.col("text")).alias("key"))


document_cases("adopted_concerns", lambda d: _fv(cn.adopting(cn.classified(_atom_rows(d).withColumn("clause", F.lit("1.1")), _CONCERNS), ("上述", "其")), "atom", "concern"), [("提交保函\n上述文件须密封\n普通", [("A100", "BOND"), ("A101", "BOND"), ("A102", "UNCLASSIFIED")]), ("保函\n履约\n上述", [("A100", "BOND"), ("A101", "PERFORMANCE"), ("A102", "UNCLASSIFIED")])])


def _groups(docs: DataFrame) -> DataFrame:
    own = cn.classified(_atom_rows(docs), _CONCERNS).withColumns({"mandatory": F.col("text").contains("必须"), "high_risk": F.col("text").contains("否决")})
    return _fv(cn.actionable(cn.grouped(own), ("UNCLASSIFIED",)), "concern", F.concat_ws("/", F.array_join("atoms", "+"), "mandatory", "high_risk", "actionable"))


document_cases("concerns", _groups, [("保函一\n其他\n必须保函二", [("BOND", "A100+A102/true/false/true"), ("UNCLASSIFIED", "A101/false/false/false")]), ("必须说明", [("UNCLASSIFIED", "A100/true/false/true")])])


def _split_marks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    every = _atom_rows(docs)
    star = F.col("text").startswith("★")
    marks = every.where(star).select("doc_id", F.concat(F.lit("M"), F.col("pos").cast("string")).alias("mark"), "clause", "page", F.translate("key", "★", "").alias("key"))
    return every.where(~star), marks


def _marked(docs: DataFrame) -> DataFrame:
    a, m = _split_marks(docs)
    return _fv(cr.marked_atoms(a, m), F.concat_ws("/", "atom", "mark"), "route")


document_cases("marked_atoms", _marked, [("★1.2 供货期\n1.2 其他\n供货期内必须完成安装调试工作\n★必须完成安装调试", [("A101/M100", "clause"), ("A102/M103", "holds")]), ("★必须完成\n必须完成", [("A101/M100", "text")]), ("★必须完成安装调试并且验收\n--\n必须完成安装调试", []), ("★必须完成安装调试并且验收\n必须完成安装调试", [("A101/M100", "within")])])


def _adopted(docs: DataFrame) -> DataFrame:
    a, m = _split_marks(docs)
    return _fv(cr.adopted(m, cr.marked_atoms(a, m)), "mark", F.concat_ws("/", "donor", "atom"))


_LONG = "必须完成安装调试并且通过最终验收"
document_cases("adopted_marks", _adopted, [(f"★{_LONG}\n{_LONG}\n--\n★{_LONG}后交付", [("M200", "M100/A101")]), (f"★短\n★{_LONG}", [])])


def _rejections(docs: DataFrame) -> DataFrame:
    rows = _atom_rows(docs)
    rules = rows.select("doc_id", F.concat(F.lit("RJ"), F.col("pos").cast("string")).alias("rule"), "text", cr.consequence(F.col("text"), _SCOPES).alias("scope")).where("scope != ''")
    return _fv(cr.rejection_targets(rules, rows), "atom", "rule")


document_cases("rejection_targets", _rejections, [("3.4.1 提交保证金\n不按第3.4.1项的，否决其投标\n第3.4.1项扣分", [("A100", "RJ101")]), ("3.4.1 提交\n不按第3.4.1项的扣分", []), ("3.5 甲\n3.4 乙\n不按第3.4项和第3.5项的，投标无效", [("A100", "RJ102"), ("A101", "RJ102")])])


def _references(docs: DataFrame) -> DataFrame:
    rows = _atom_rows(docs)
    heads = rows.where("clause != '' and char_length(text) <= 12").select("doc_id", "pos", F.col("clause").alias("number"), (F.size(F.split("clause", r"\."))).alias("level"))
    cites = rows.select("doc_id", "atom", F.explode(cr.references(F.col("text"))).alias("cites"))
    return _fv(cr.section_references(cites, heads), "atom", F.concat_ws("-", "start", F.coalesce(F.col("stop").cast("string"), F.lit("end"))))


document_cases("section_references", _references, [("1.1 甲\n1.1.1 乙\n1.2 丙\n须满足第1.1条的全部要求和规定内容", [("A103", "100-102")]), ("1.1 甲\n须满足第1.1条的全部要求和规定内容", [("A101", "100-end")]), ("须满足第9.1条的全部要求和规定内容", [])])


def _units(docs: DataFrame) -> DataFrame:
    """Rows that begin with > are atoms, the others units."""
    rows = _atom_rows(docs)
    atoms = rows.where("text like '>%'").withColumn("key", F.translate("key", ">", ""))
    return _fv(cn.evidence_units(atoms, rows.where("text not like '>%'").withColumnRenamed("atom", "unit")), "atom", "unit")


document_cases("evidence_units", _units, [("甲提供保函\n甲提供保函原件\n>提供保函", [("A102", "A100")]), ("甲提供保函\n--\n>提供保函\n--\n提供保函乙", [("A200", "A100")]), ("无关\n>提供保函", []), ("提供\n--\nx\n--\n>提供保函", [])])


def _used(docs: DataFrame) -> DataFrame:
    rows = _atom_rows(docs)
    e = rows.where("text like '>%'").select("doc_id", F.col("atom").alias("evidence"), "page", F.translate("key", ">", "").alias("excerpt"))
    return _fv(cn.used_by(e, rows.where("text not like '>%'").select("doc_id", F.col("atom").alias("id"), "page", F.col("key").alias("excerpt")), 4), "evidence", F.array_join("used", "+"))


document_cases("evidence_usage", _used, [(">提供保函原件\n甲提供保函\n乙提供保函件\n--\n丙提供保函", [("A100", "A101+A102")]), (">提供\n无关", [("A100", "")])])


def _suppressed(docs: DataFrame) -> DataFrame:
    rows = fr.fragments(docs)
    both = fa.same_line(rows, _ALL).unionByName(fa.title(rows, _NAME, ("工程",), ()))
    return _fv(fa.suppressed(both, "name", "title", ("same_line", "next_line", "multiline", "table_label")), "method", "value")


document_cases("suppressed_titles", _suppressed, [("甲市第二水厂改造工程\n项目名称：甲楼", [("same_line", "甲楼")]), ("甲市第二水厂改造工程", [("title", "甲市第二水厂改造工程")]), ("甲市第二水厂改造工程\n工期：5天", [("title", "甲市第二水厂改造工程"), ("same_line", "5天")])])
_BOND = fa.Field("bond", "money", ("保证金", "保证金形式"))
document_cases("rerouted_bonds", lambda d: fa.rerouted(fa.same_line(fr.fragments(d), [_BOND]), "bond", "bond_form", ("保证金形式", "提交形式")), [("保证金：5万元", [("bond", "5万元")]), ("保证金形式：银行保函", [("bond_form", "银行保函")]), ("保证金：银行保函", [("bond", "银行保函")]), ("保证金形式：转账5万元", [("bond", "转账5万元")])])
_FULL = [_NAME, _OWNER, fa.Field("term", "duration", ("工期",)), fa.Field("due", "date", ("截止时间",)), fa.Field("open", "date", ("开标时间",))]


def _resolved(docs: DataFrame) -> DataFrame:
    facts = fa.facts(fr.fragments(docs), docs.select(F.col("doc_id").alias("key")), _FULL)
    return facts.select(F.col("key").alias("doc_id"), "field", F.concat_ws("/", "status", "value", F.format_number("confidence", 3), "reason").alias("value")).where("field != 'open'")


def _not(*fields: str) -> list[tuple[str, str]]:
    return [(f, "NOT_FOUND") for f in fields]


document_cases("resolved_facts", _resolved, [
    ("项目名称：甲市大楼\n工期：90天", [("name", "RESOLVED/甲市大楼/0.950/one candidate"), ("term", "RESOLVED/90日历天/0.950/one candidate"), *_not("owner", "due")]),
    ("项目名称：甲市大楼\n项目名称：乙市大楼", [("name", "NEEDS_REVIEW/0.950/values differ"), *_not("owner", "term", "due")]),
    ("工期为90天，如下", [("term", "NEEDS_REVIEW/0.700/keyword alone"), *_not("name", "owner", "due")]),
    ("工期为90天，如下\n工期：90 日历天", [("term", "RESOLVED/90日历天/0.960/candidates agree"), *_not("name", "owner", "due")]),
    ("截止时间：另行通知", [("due", "NEEDS_REVIEW/0.950/no valid value"), *_not("name", "owner", "term")]),
    ("招标人\n甲局", [("owner", "RESOLVED/甲局/0.910/candidates agree"), *_not("name", "term", "due")]),
    ("项目名称：甲市第二水厂\n项目名称：甲市第二水厂改造工程", [("name", "RESOLVED/甲市第二水厂改造工程/0.950/one candidate"), *_not("owner", "term", "due")]),
    (None, _not("name", "owner", "term", "due")),
])

