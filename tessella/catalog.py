"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import curation, evaluation, gate_checks, more

PLANS = (curation, evaluation, gate_checks, more)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy of each document stays."""
    return curation.k2_dedup_decisions(spark, sf_dir)
