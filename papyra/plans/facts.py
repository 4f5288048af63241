"""Typed values and labelled facts as queries on the standard tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import values
from papyra.operators import facts as fa
from papyra.operators import fragments as fr
from papyra.plans.catalog import _read, query

_FIELDS = [fa.Field("name", "text", ("客户名称", "名称")), fa.Field("balance", "money", ("账户余额", "余额")), fa.Field("segment", "text", ("所属行业",)), fa.Field("term", "duration", ("期限",))]


def _trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:.2f}}', {x}), '0+$', ''), '\\.$', '')"


@query(f"SELECT l_orderkey, l_linenumber, {_trimmed('l_extendedprice')} AS amount FROM lineitem")
def money_values(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("合计人民币 ¥"), F.format_number("l_extendedprice", 2), F.lit("　元（含税）"))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.money(text).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 09:05' AS due FROM orders")
def date_values(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = F.concat(F.year(day), F.lit("年 "), F.month(day), F.lit("月"), F.day(day), F.lit("日９时05分（北京时间）"))
    return _read(spark, d, "orders").select("o_orderkey", values.date_time(text).alias("due"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '日历天' ELSE '个月' END AS span FROM lineitem")
def duration_values(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 2 == 0, "天").otherwise(" 个月")
    text = F.concat(F.lit("交货期："), F.col("l_quantity").cast("bigint"), F.lit(".0"), unit)
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.duration(text).alias("span"))


@query(f"""WITH c AS (SELECT c_custkey AS key, c_name, c_mktsegment, {_trimmed('abs(c_acctbal)')} AS b FROM customer)
SELECT key, 'name' AS field, c_name AS normalized, 'RESOLVED' AS status FROM c
UNION ALL SELECT key, 'balance', b, 'RESOLVED' FROM c
UNION ALL SELECT key, 'segment', CASE WHEN key % 3 <> 0 THEN c_mktsegment END, CASE WHEN key % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END FROM c
UNION ALL SELECT key, 'term', NULL, 'NOT_FOUND' FROM c""")
def label_facts(spark: SparkSession, d: str) -> DataFrame:
    lines = [F.concat(F.lit("客户名称："), F.col("c_name"), F.lit("　所属行业: "), F.col("c_mktsegment")), F.lit("账户余额"), F.concat(F.format_number(F.abs("c_acctbal"), 2), F.lit("元")), F.when(F.col("c_custkey") % 3 == 0, "所属行业：OTHER").otherwise("备注")]
    docs = _read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))
    return fa.facts(fr.fragments(docs), docs.select(F.col("doc_id").alias("key")), _FIELDS).select("key", "field", "normalized", "status")
