"""The gate and duplicate detection on streams: an extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import gate


def checks(stream: DataFrame, rules: Sequence[gate.Rated], key: str = "sample_id", time: str = "ts") -> DataFrame:
    """Rows of checks: a map of each row, without state."""
    items = F.array(*[c.row() for c in rules])
    return stream.select(F.col(key).alias("sample_id"), F.col(time).alias("ts"), F.explode(items).alias("c")).select("sample_id", "ts", "c.*")


def decisions(stream: DataFrame, rules: Sequence[gate.Rated], key: str = "sample_id", time: str = "ts") -> DataFrame:
    """(sample_id, ts, decision) of each row, without state: the worst effect of its checks."""
    effects = F.array(*[c.row()["decision_effect"] for c in rules])
    name = F.when(F.array_contains(effects, "retake"), "retake").when(F.array_contains(effects, "warning"), "warning").otherwise("pass")
    return stream.select(F.col(key).alias("sample_id"), F.col(time).alias("ts"), name.alias("decision"))


def decision_counts(decided: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions counted by windows of time; rows later than the watermark are left out, which bounds the state."""
    return decided.withWatermark("ts", late).groupBy(F.window("ts", window), "decision").agg(F.count("*").alias("n"))


def first_copies(stream: DataFrame, keys: Sequence[str] = ("dataset", "md5"), time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
