"""Functions of one text on written cases: each customer gets a case by its key, the SQL has the result that was written down for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import values
from papyra.operators import facts as fa
from papyra.operators import fragments as fr
from papyra.plans.catalog import _QUERIES, _SQL, _read


def _literal(x: str | None) -> str:
    if x is None:
        return "NULL"
    plain = x.replace("'", "''")
    marks = sorted({c for c in plain if ord(c) < 32 or ord(c) == 127})
    out = f"'{plain}'"
    for c in marks:
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})"


def cases(name: str, fn: Callable[[Column], Column], rows: list[tuple[str | None, str | None]]) -> None:
    """Registers ``fn`` on the texts of ``rows``, each with its result as a string."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        case = (F.col("c_custkey") % len(rows)).cast("int")
        given = F.element_at(F.array(*(F.lit(t) for t, _ in rows)), case + 1)
        return _read(spark, d, "customer").select(F.col("c_custkey").alias("key"), given.alias("given")).select("key", fn(F.col("given")).cast("string").alias("value"))

    _QUERIES[name] = query
    _SQL[name] = f"SELECT c_custkey AS key, CASE c_custkey % {len(rows)} " + " ".join(f"WHEN {i} THEN {_literal(w)}" for i, (_, w) in enumerate(rows)) + " END AS value FROM customer"


cases("money_cases", values.money, [
    ("1,000,000元", "1000000"), ("人民币　１２．５０ 万元", "125000"), ("二十万元", "200000"), ("贰拾叁万伍仟元整", "235000"), ("一亿零五十万元", "100500000"), ("十元", "10"), ("3元或5元", None),
    ("", None), (None, None), ("没有", None), ("0.10元", "0.1"), ("最高限价：￥ 1,234.56 元（含税）", "1234.56"), ("1.2.3元", None), ("三元或五元", None), ("5万", "50000"), ("约 7 元，即柒元", "7"), ("两千零三元", "2003"),
])
cases("date_cases", values.date_time, [
    ("2026年3月1日", "2026-03-01"), ("2026年 3月1日10时00分", "2026-03-01 10:00"), ("2026年3月1日10时", None), ("2026-02-30", None), ("2026/2/3 9:05:07", "2026-02-03 09:05:07"), ("2026-1-2 25:00", None),
    ("详见公告", None), (None, None), ("２０２６年３月１日（北京时间）", "2026-03-01"), ("2026年3月1日。", "2026-03-01"), ("2026年3月1日9：30", "2026-03-01 09:30"), ("2026-3/1", "2026-03-01"), ("2024年2月29日", "2024-02-29"), ("2025年2月29日", None),
    ("26年3月1日", None), ("同投标截止时间", None), ("2026-03-01T08:00", "2026-03-01 08:00"), ("2026年13月1日", None), ("2026年3月1日至5日", None), ("", None),
])
cases("duration_cases", values.duration, [("90天", "90日历天"), ("3 个月", "3个月"), ("2.0年", "2年"), ("1.5 年", "1.5年"), ("不限", None), (None, None), ("合同签订后３０ 日历天内", "30日历天"), ("2026年", "2026年"), ("6月或12月", "6个月"), ("十天", None)])
cases("yes_no_cases", lambda c: values.yes_no(c).cast("string"), [("不接受联合体", "false"), ("接受", "true"), ("是否", "false"), ("另行通知", None), (None, None), ("不可以", "false"), ("允许分包", "true"), ("禁止转包", "false"), ("是", "true")])
cases("valid_money_cases", lambda c: F.concat_ws(",", values.is_valid("money", c).cast("string"), values.is_resolved("money", c).cast("string")), [("5元", "true,true"), ("500", "false,true"), ("12.5", "false,true"), ("五百", "false,false"), (None, "false,false"), ("3元或5元", "false,false")])
cases("normalized_text_cases", tx.normalized, [("a\r\nb", "a\nb"), ("\n\n  a \t b  \n\n c \n", "a b\n\nc"), ("a\x07b\x7fc", "abc"), (None, None), ("   ", ""), ("x\ty", "x y"), ("　名　", "名"), ("a\n \n \nb", "a\n\n\nb")])
cases("display_text_cases", tx.displayed, [("\n a\t b \n", " a\t b "), ("a\r\n\r\nb", "a\n\nb"), ("a\x01b", "ab"), (None, None), ("\n\n", "")])
cases("nfkc_cases", lambda c: tx.collapsed(tx.nfkc(c)), [("ＡＢ１２", "AB12"), ("①②㈱", "12(株)"), ("ﬁn", "fin"), ("㎡", "m2"), (None, None), ("plain text", "plain text"), ("a　 b", "a b"), ("２０℃", "20°C")])
cases("text_keys", lambda c: F.concat_ws("|", tx.collapsed(c), tx.squeezed(c), tx.key(c)), [("a  b，c。", "a b，c。|ab，c。|abc"), ("“x” (y)", "“x” (y)|“x”(y)|xy"), ("", "||"), ("\t1 2　3\n", "1 2 3|123|123")])
cases("navigation_cases", lambda c: F.coalesce(tx.is_navigation(c), F.lit(False)).cast("string"), [
    ("第一章 总则........3", "true"), ("第一章...3\n第二章...9", "true"), ("等等……", "false"), ("a.b.c.d", "false"), ("plain", "false"), (None, "false"), ("第一章……………12", "true"), ("3.1.4.1 条款", "false"), ("见 3.1 ... 和 4.2 ...", "true"),
])
cases("page_furniture_cases", lambda c: F.concat_ws(",", tx.is_page_number(c).cast("string"), tx.is_running_head(c, ["招标文件", "采购文件"]).cast("string")), [
    ("第 3 页", "true,false"), ("第3页 共10页", "true,false"), ("12", "true,false"), ("1234", "false,false"), ("某项目 招标文件", "false,true"), ("见招标文件。", "false,false"), ("已完成。附招标文件", "false,false"), ("采购文件 ", "false,true"), ("甲" * 140 + "招标文件", "false,false"),
])
cases("heading_cases", lambda c: F.concat_ws(",", tx.is_structural_heading(c).cast("string"), tx.is_styled_heading(c, F.lit(None).cast("string"), ["招标公告"]).cast("string")), [
    ("第一章 总则", "true,false"), ("第三章", "true,true"), ("3.1、投标报价", "true,false"), ("3.1 投标报价", "true,false"), ("一、说明", "true,false"), ("招标公告", "false,true"), ("1. 应当提交，否则无效", "false,false"), ("普通文字", "false,false"), ("", "false,false"), ("第2节", "true,true"),
])
cases("bare_label_cases", lambda c: tx.is_bare_label(c, ["必须", "不得"], ["保证金", "工期"]).cast("string"), [("投标保证金", "true"), ("工期", "true"), ("必须交保证金", "false"), ("保证金5万", "false"), ("保证金：", "false"), ("其他", "false"), ("保证金" * 9, "false")])
cases("snippet_cases", lambda c: tx.snippet(c, ["key", "other"], 20, 5), [("short  text", "short text"), ("0123456789 the key is here and more text", "… the key is here and"), ("key first and then a long tail", "key first and then a…"), ("nothing of interest in this text", "nothing of interest …"), (None, None)])
cases("clip_cases", lambda c: tx.clipped(c, 10), [("0123456789", "0123456789"), ("01234567890", "0123456..."), ("012345 890123", "012345..."), (None, None)])
cases("number_tokens", lambda c: F.concat_ws("|", tx.number_token(c)["family"], tx.number_token(c)["mark"], tx.number_token(c)["level"].cast("string"), tx.number_token(c)["rest"]), [
    ("第三章 总则", "chapter|第三章|1|总则"), ("1.2.3 投标", "decimal|1.2.3|3|投标"), ("（一）资格", "bracket|（一）|1|资格"), ("二、说明", "chinese|二、|1|说明"), ("3. 报价", "arabic|3.|1|报价"), ("没有编号", ""), (" 4）其他", "arabic|4）|1|其他"), ("2.1报价", "decimal|2.1|2|报价"),
])


def document_cases(name: str, find: Callable[[DataFrame], DataFrame], rows: list[tuple[str | None, list[tuple[str, str]]]]) -> None:
    """Registers ``find``, from a table of documents (doc_id, text) to candidates, on the texts of ``rows``, each with its fields and values."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        case = (F.col("c_custkey") % len(rows)).cast("int")
        docs = _read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(*(F.lit(t) for t, _ in rows)), case + 1).alias("text"))
        return find(docs).select(F.col("doc_id").alias("key"), "field", "value")

    given = ", ".join(f"({i}, {_literal(f)}, {_literal(v)})" for i, (_, found) in enumerate(rows) for f, v in found)
    _QUERIES[name] = query
    _SQL[name] = f"SELECT c_custkey AS key, field, value FROM customer JOIN (VALUES {given}) AS w(i, field, value) ON c_custkey % {len(rows)} = w.i"


_NAME, _PRICE, _JOINT = fa.Field("name", "text", ("项目名称", "工程名称"), multiline=True), fa.Field("price", "money", ("最高限价", "限价")), fa.Field("joint", "yes_no", ("联合体投标", "联合体"))
_OWNER, _TERM = fa.Field("owner", "text", ("招标人",), entity=True, multiline=True), fa.Field("term", "duration", ("工期",))
_PLATFORM, _LOT = fa.Field("platform", "text", ("电子平台",)), fa.Field("lot", "text", ("标段名称",))
_ALL = [_NAME, _PRICE, _JOINT, _OWNER, _TERM]
_KNOWN = fa.all_labels(_ALL)

cases("cleaned_values", fa.cleaned, [("，甲项目。", "甲项目"), ("“甲项目”", "甲项目"), ("（“甲”）", "甲"), ("甲（一期）", "甲（一期）"), ("  ", ""), (None, None), ("「『x』」", "x"), ('"', '"'), ("甲。”", "甲。”"), ("(a)(b)", "a)(b")])
cases("no_values", lambda c: fa.is_no_value(c, _KNOWN, ("功能要求",)).cast("string"), [
    ("甲公司", "false"), ("招标人", "true"), ("供应商：", "true"), ("见前附表", "true"), ("(盖单位章)", "true"), ("（如有）", "true"), ("（一期）", "false"), ("____", "true"), ("某项目（二期", "true"), ("元", "true"), ("功能要求", "true"), (None, "true"), ("", "true"),
    ("项目名称", "true"), ("承包单位\n合同主要内容\n合同金额", "true"), ("承包单位：甲\n金额：5", "false"), ("30 日历天", "false"), ("日历天", "true"),
])
cases("entities", fa.entity, [("甲局", "甲局"), ("名称：乙公司\n地址：丙路", "乙公司"), ("联系人：丁\r\n名 称: 戊院", "戊院"), (None, None), ("名称：", "名称：")])
cases("header_blocks", lambda c: fa.is_header_block(c, F.lit("项目名称"), _KNOWN).cast("string"), [
    ("项目名称\n承包单位\n合同主要内容", "true"), ("项目名称\n最高限价", "true"), ("项目名称\n某某大楼", "false"), ("项目名称：甲\n工期：5天", "false"), ("项目名称", "false"), ("承包单位\n项目名称\n金额", "false"), ("项目名称\n承包单位，甲\n内容", "false"),
])
document_cases("same_line_facts", lambda d: fa.same_line(fr.fragments(d), _ALL), [
    ("项目名称：甲楼 最高限价：10万元", [("name", "甲楼"), ("price", "10万元")]), ("工期: “90日历天”。", [("term", "90日历天")]), ("项目名称：\n最高限价：见附件", []), ("招标人：（盖单位章）", []), (None, []), ("本工期较短", []), ("说明 限价：5元；", [("price", "5元")]),
])
document_cases("next_line_facts", lambda d: fa.next_line(fr.fragments(d), _ALL), [
    ("项目名称\n甲楼", [("name", "甲楼")]), ("工期：\n\n30天\n其他", [("term", "30天")]), ("项目名称\n最高限价：5元", []), ("项目名称\n第三章", []), ("限价\n限价", []), ("招标人\n招标人", []), ("项目名称", []), (None, []),
])
document_cases("multiline_facts", lambda d: fa.multiline(fr.fragments(d), _ALL), [
    ("项目名称：甲市\n第二水厂\n改造项目\n多余", [("name", "甲市第二水厂改造项目")]), ("项目名称\n甲楼\n工期：3天", [("name", "甲楼")]), ("项目名称：甲楼", []), ("项目名称：甲楼\n一、总则", []), ("招标人\n名称：甲局\n1、说明", [("owner", "甲局")]), ("工期\n3天", []), ("项目名称\n甲\n乙\n丙\n丁", [("name", "甲乙丙")]), (None, []),
])
document_cases("keyword_facts", lambda d: fa.keyword(fr.fragments(d), _ALL), [
    ("本项目工期为90天，不得延误", [("term", "90天")]), ("不接受联合体投标", [("joint", "不接受")]), ("允许 联合体", [("joint", "允许")]), ("最高限价是5元；", [("price", "5元")]), ("工期指定由甲方", []), ("项目名称包括甲、乙", [("name", "甲")]), ("是否接受联合体", []), ("", []),
])
document_cases("title_facts", lambda d: fa.title(fr.fragments(d), _NAME, ("项目", "工程", "采购"), ("合同", "应当")), [
    ("甲市第二水厂改造工程", [("name", "甲市第二水厂改造工程")]), ("改造工程", []), ("本合同所指甲市改造工程", []), ("一、甲市第二水厂改造工程", []), ("甲市，第二水厂改造工程", []), ("甲市第二水厂 设备采购\n正文。", [("name", "甲市第二水厂设备采购")]), ("甲市第二水厂改造说明", []),
])
document_cases("platform_facts", lambda d: fa.platforms(fr.fragments(d), _PLATFORM, ("电子", "交易", "采购"), ("上传", "操作手册")), [
    ("甲省公共交易平台（省交易平台）公告\n省交易平台", [("platform", "甲省公共交易平台")]), ("在“乙市电子采购平台”发布", [("platform", "乙市电子采购平台")]), ("电子平台", []), ("请上传电子交易平台", []), ("丙县交易平台\n丙县交易平台", [("platform", "丙县交易平台")]), ("发布平台", []),
])
document_cases("lot_facts", lambda d: fa.lots(fr.fragments(d).withColumn("page", F.lit(1)), _LOT, ("最高限价", "投标保证金"), ("投标人资格要求", "招标范围"), ("项目名称",)), [
    ("最高限价：三标段 100万元", [("lot", "三标段")]), ("3.1三标段投标人资格要求", [("lot", "三标段")]), ("项目名称：甲楼\n二标段", [("lot", "二标段")]), ("二标段", []), ("同一标段招标范围", []), ("投标保证金为第一标段", [("lot", "第一标段")]), ("本标段", []),
])
