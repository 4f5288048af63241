"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.plans import cases, catalog, checks, clauses, facts, layout, results  # noqa: F401 (the others add their queries to the catalog)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rule_scores_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.queries()


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql()
