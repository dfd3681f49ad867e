"""Rules that good tables do not break: each gives the rows that do, as (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_where(df: DataFrame, rule: str, wrong: Column, key: str = "sample_id") -> DataFrame:
    return df.filter(wrong).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, rule: str, key: str = "sample_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def orphans(df: DataFrame, parent: DataFrame, rule: str, key: str = "sample_id") -> DataFrame:
    return df.join(parent.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def together(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def manifest(samples: DataFrame, labels: DataFrame, spatial: DataFrame) -> DataFrame:
    """Unique ids, parents, values of 0 and 1, available labels, predictions that pass for human, boxes within the image."""
    sized = spatial.join(samples.select("sample_id", "width", "height"), "sample_id", "left")
    inside = (F.col("x_min") >= 0) & (F.col("y_min") >= 0) & (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max")) & (F.col("x_max") <= F.col("width")) & (F.col("y_max") <= F.col("height"))
    predicted = (F.col("label_source") == "model_prediction") & F.col("supervision_tier").isin("gold", "human")
    return together(
        duplicates(samples, "sample_id_unique"), orphans(labels, samples, "labels_have_samples"), orphans(spatial, samples, "spatial_has_samples"),
        rows_where(labels, "value_is_0_or_1", F.col("value").isNull() | ~F.col("value").isin(0, 1)), rows_where(labels, "label_available", ~F.coalesce("label_available", F.lit(False))),
        rows_where(labels, "prediction_is_no_gold", predicted), rows_where(sized.filter("annotation_type = 'bbox'"), "box_in_image", ~F.coalesce(inside, F.lit(False))),
    )


def clean(samples: DataFrame, decided: DataFrame, labels: DataFrame, conflicts: DataFrame, assigned: DataFrame) -> DataFrame:
    """One sample kept of each group, parents, no conflicted fact left or used, predictions pseudo, no holdout in train."""
    kept = decided.groupBy("duplicate_group_id").agg(F.count_if("keep").alias("n")).filter("n <> 1").select(F.lit("one_kept_of_each_group").alias("rule"), F.col("duplicate_group_id").alias("key"))
    left = labels.join(conflicts, (labels["sample_id"] == conflicts["canonical_sample_id"]) & labels["canonical_task"].eqNullSafe(conflicts["canonical_task"]) & labels["canonical_label"].eqNullSafe(conflicts["label"]), "left_semi")
    return together(
        duplicates(samples, "sample_id_unique"), kept, rows_where(decided, "kept_is_canonical", F.col("keep") != (F.col("sample_id") == F.col("canonical_sample_id"))),
        orphans(labels, samples, "labels_have_samples"), left.select(F.lit("conflict_left_in_labels").alias("rule"), F.col("sample_id").alias("key")),
        rows_where(assigned, "prediction_is_pseudo", (F.col("label_source") == "model_prediction") & (F.col("supervision_pool") != "pseudo")),
        rows_where(assigned, "holdout_trains_nothing", (F.col("supervision_pool") == "external_holdout") & (F.col("eligible_for_train") | F.col("eligible_for_val"))),
    )


def splits(table: DataFrame) -> DataFrame:
    """Unique samples, legal names, and no group or digest in two splits."""
    spans = lambda key: table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit(f"{key}_in_one_split").alias("rule"), F.col(key).alias("key"))
    return together(duplicates(table, "sample_id_unique"), rows_where(table, "split_is_known", ~F.col("split").isin("train", "val", "test", "external_holdout")), spans("split_group_id"), spans("md5"))


def checks(table: DataFrame) -> DataFrame:
    """Invariants of gate results: what was not evaluated finds nothing and passes nothing; a retake has a reason."""
    idle = F.col("evaluation_state") != "evaluated"
    return together(
        rows_where(table, "not_evaluated_finds_nothing", idle & F.col("finding").isNotNull()),
        rows_where(table, "not_evaluated_is_no_pass", idle & F.coalesce(F.col("decision_effect") == "pass", F.lit(False))),
        rows_where(table, "retake_has_a_reason", (F.col("decision_effect") == "retake") & F.col("reason_code").isNull()),
    )


def assert_empty(found: DataFrame, what: str = "rules are broken") -> None:
    """Raises with up to ten of the rows found."""
    rows = found.limit(10).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")
