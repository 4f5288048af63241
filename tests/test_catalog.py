"""Every query of the library's own operators gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from papyra import registry

SF = "/root/testdata/sf0.001"


def plain(rows):
    out = []
    for r in rows:
        values = ["" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]
        out.append(tuple(values))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    theirs = duck.sql(registry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = plain(tuple(r) for r in ours.select(*columns).collect())
    assert got == plain(theirs.select(*[f'"{c}"' for c in columns]).fetchall())


def test_scoring_tiers_with_nulls_apart(spark, duck):
    """The comparison of all queries takes a null for an empty string; this one doesn't."""
    got = {r.key: r.value for r in registry.queries()["scoring_tiers"](spark, SF).collect()}
    assert got == dict(duck.sql(registry.oracle_sql()["scoring_tiers"]).fetchall())
    assert None in got.values() and "" in got.values()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nulls_and_empty_texts(spark):
    from papyra.operators import fragments as fr

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A\n\nb c."), (None, "x")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.pos, r.text) for r in fr.fragments(docs).where("doc_id is not null").collect()) == [(3, 0, "A"), (3, 2, "b c.")]
    assert [r.section for r in fr.section_carry(fr.fragments(docs.where("doc_id = 3"))).orderBy("pos").collect()] == ["A", "A"]
