"""Sinks: tables with their statistics, checked before they are published; reports; frozen thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(folder: str, **frames: DataFrame) -> dict[str, int]:
    """Writes each frame as Parquet under its name and returns the numbers of rows, counted from what was written."""
    out = {}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return out


def published(folder: str, violations: DataFrame, **frames: DataFrame) -> dict[str, int]:
    """Writes the violations first; tables follow only if there are none, else this raises."""
    broken = tables(folder, violations=violations)["violations"]
    if broken:
        raise ValueError(f"{broken} rules are broken; see {folder}/violations")
    return tables(folder, **frames)


def statistics(folder: str, name: str, row: DataFrame) -> dict:
    """A one-row frame as a JSON document."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"statistics are one row, not {len(found)}")
    document = found[0].asDict(recursive=True)
    text(row.sparkSession, f"{folder}/{name}", json.dumps(document, sort_keys=True, default=str))
    return document


def text(spark: SparkSession, folder: str, content: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def summary_csv(df: DataFrame, folder: str) -> None:
    """A report of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report of a few rows as a Markdown table; more rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def freeze_thresholds(spark: SparkSession, folder: str, t_clear: float, t_retake: float, version: str) -> None:
    if not t_clear < t_retake:
        raise ValueError("t_clear is not below t_retake")
    spark.createDataFrame([(version, float(t_clear), float(t_retake))], "version string, t_clear double, t_retake double").coalesce(1).write.mode("overwrite").json(folder)


def load_thresholds(spark: SparkSession, folder: str) -> tuple[str, float, float]:
    r = spark.read.schema("version string, t_clear double, t_retake double").json(folder).first()
    if r is None or not r.t_clear < r.t_retake:
        raise ValueError("these thresholds are not in order")
    return r.version, r.t_clear, r.t_retake


def versioned_thresholds(table: DataFrame, folder: str, version: str) -> None:
    """Thresholds of a policy, appended under a version; an earlier version is never overwritten."""
    table.withColumn("version", F.lit(version)).write.mode("error").parquet(f"{folder}/version={version}")
