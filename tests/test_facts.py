"""Typed values and facts on texts whose results are known."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import values
from papyra.operators import facts as fa
from papyra.operators import fragments as fr

CASES = {
    "money": [("1,000,000元", "1000000"), ("人民币　１２．５０ 万元", "125000"), ("二十万元", "200000"), ("贰拾叁万伍仟元整", "235000"), ("一亿零五十万元", "100500000"), ("十元", "10"), ("3元或5元", None), ("", None), (None, None), ("没有", None), ("0.10元", "0.1")],
    "date": [("2026年3月1日", "2026-03-01"), ("2026年 3月1日10时00分", "2026-03-01 10:00"), ("2026年3月1日10时", None), ("2026-02-30", None), ("2026/2/3 9:05:07", "2026-02-03 09:05:07"), ("2026-1-2 25:00", None), ("详见公告", None), (None, None), ("2026年3月1日（北京时间）", "2026-03-01"), ("2026年3月1日。", "2026-03-01"), ("2026年3月1日（北京时间）。", None)],
    "duration": [("90天", "90日历天"), ("3 个月", "3个月"), ("2.0年", "2年"), ("不限", None), (None, None)],
    "yes_no": [("不接受联合体", "false"), ("接受", "true"), ("是否", "false"), ("另行通知", None), (None, None)],
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_typed(spark, kind):
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(CASES[kind])], "i int, text string, want string")
    got = df.withColumn("got", values.typed(kind, F.col("text"))).orderBy("i").collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


FIELDS = [fa.Field("project", "text", ("项目名称",)), fa.Field("price", "money", ("最高限价", "限价")), fa.Field("due", "date", ("截止时间",))]


def test_facts(spark):
    texts = [
        (1, "项目名称：甲 最高限价：10万元\n截止时间\n2026年3月1日"),
        (2, "项目名称：甲\n项目名称：乙\n限价：5元\n最高限价： 5.00 元"),
        (3, "截止时间\n项目名称：丙\n最高限价：另行通知"),
        (4, None), (5, ""), (None, "项目名称：丁"),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    keys = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"))
    got = {(r.key, r.field): (r.status, r.normalized) for r in fa.facts(fr.fragments(docs), keys, FIELDS).collect()}
    assert len(got) == 15
    assert [got[1, f.name] for f in FIELDS] == [("RESOLVED", "甲"), ("RESOLVED", "100000"), ("RESOLVED", "2026-03-01")]
    assert [got[2, f.name] for f in FIELDS] == [("NEEDS_REVIEW", None), ("RESOLVED", "5"), ("NOT_FOUND", None)]
    assert [got[3, f.name] for f in FIELDS] == [("RESOLVED", "丙"), ("NEEDS_REVIEW", None), ("NOT_FOUND", None)]
    assert {got[k, f.name] for k in (4, 5) for f in FIELDS} == {("NOT_FOUND", None)}
    assert fa.facts(fr.fragments(docs.where("false")), keys.where("false"), FIELDS).count() == 0
