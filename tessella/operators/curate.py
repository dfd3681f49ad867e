"""Duplicates, reconciliation of facts, pools of supervision.

Tables (see tessella.schemas): samples, labels (facts), spatial annotations, decisions, assignments. A fact is
(sample_id, canonical_task, canonical_label, value). Nulls in keys are equal to each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.policy import CleaningPolicy

#: Fixed value: ranks of the tiers of supervision; others rank below all.
TIERS = {"gold": 3, "silver": 2, "weak": 1, "pseudo": 0}


def duplicate_groups(samples: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """samples with duplicate_group_id, is_duplicate and the canonical_sample_id of rows with one digest in one dataset (or in
    all, by policy): the first by the policy's tie breakers, then by sample_id.

    Groups are aggregated, which combines before the shuffle, and joined back, which can split a hot group; a window would
    hold all copies of a text in one task.
    """
    scope = ["dataset", "md5"] if policy.within_dataset else ["md5"]
    dataset = F.col("dataset") if policy.within_dataset else F.lit("all")
    order = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in policy.tie_breakers], F.col("sample_id").alias("id"))
    groups = samples.groupBy(*[F.col(c).alias(f"_{c}") for c in scope]).agg(F.count("*").alias("_n"), F.min(order)["id"].alias("canonical_sample_id"))
    on = F.lit(True)
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = samples.drop("duplicate_group_id").join(groups, on).withColumn("duplicate_group_id", X.group_id(dataset, "md5", policy.group_template)).withColumn("is_duplicate", F.col("_n") > 1).drop("_n", *[f"_{c}" for c in scope])
    return out if policy.singleton_groups else out.withColumn("duplicate_group_id", F.when(F.col("is_duplicate"), F.col("duplicate_group_id")))


def decisions(samples: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """Which sample of each group stays."""
    grouped = duplicate_groups(samples, policy).filter("duplicate_group_id is not null")
    keep = F.col("sample_id") == F.col("canonical_sample_id")
    return grouped.select(
        "sample_id", "dataset", "md5", "duplicate_group_id", "is_duplicate", "canonical_sample_id", keep.alias("keep"),
        F.when(keep, "canonical").otherwise("duplicate_alias").alias("decision"),
        F.when(~F.col("is_duplicate"), "unique").when(keep, "first_by_policy").otherwise("same_digest").alias("reason"),
        F.lit(policy.version).alias("policy_version"),
    )


def clean_samples(samples: DataFrame, decided: DataFrame) -> DataFrame:
    """The samples that stay, with their group."""
    kept = decided.filter("keep").select("sample_id", F.col("duplicate_group_id").alias("_group"))
    return samples.drop("duplicate_group_id").join(kept, "sample_id").withColumnRenamed("_group", "duplicate_group_id")


def collisions(samples: DataFrame) -> DataFrame:
    """Digests that more than one dataset has."""
    found = samples.filter("md5 is not null").groupBy("md5").agg(F.sort_array(F.collect_set("dataset")).alias("names"), F.count("*").alias("n_samples"))
    return found.filter(F.size("names") > 1).select("md5", F.array_join("names", "|").alias("datasets"), F.size("names").alias("n_datasets"), "n_samples")


def top_collisions(found: DataFrame, k: int = 100) -> DataFrame:
    """A report: the k largest, and whether there are more."""
    total = found.agg(F.count("*").alias("n_groups"))
    top = found.orderBy(F.desc("n_samples"), "md5").limit(k)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("n_groups") > k)  # one row


def dedup_statistics(samples: DataFrame, decided: DataFrame) -> DataFrame:
    """By dataset: samples, distinct digests, groups of several, what stays and what goes."""
    joined = samples.select("sample_id", "dataset", "md5").join(decided.select("sample_id", "keep", "is_duplicate", "duplicate_group_id"), "sample_id")
    return joined.groupBy("dataset").agg(
        F.count("*").alias("samples_before"), F.count_if("keep").alias("samples_after"), F.count_if(~F.col("keep")).alias("removed"),
        F.countDistinct("md5").alias("distinct_digests"), F.countDistinct(F.when(F.col("is_duplicate"), F.col("duplicate_group_id"))).alias("groups_of_several"),
    )


def on_canonical(facts: DataFrame, decided: DataFrame) -> DataFrame:
    """Facts moved to the sample that stands for their group; origin_sample_id is where they were. Facts of unknown samples go."""
    moved = facts.join(decided.select("sample_id", "canonical_sample_id", "duplicate_group_id"), "sample_id")
    return moved.withColumnRenamed("sample_id", "origin_sample_id")


def value_conflicts(facts: DataFrame) -> DataFrame:
    """Facts of one canonical sample with more than one value."""
    found = facts.groupBy("canonical_sample_id", "canonical_task", X.norm_label("canonical_label").alias("label")).agg(
        F.sort_array(F.collect_set(X.norm_value("value"))).alias("values"), F.sort_array(F.collect_set("origin_sample_id")).alias("origins")
    )
    return found.filter(F.size("values") > 1).select(
        "canonical_sample_id", "canonical_task", "label", F.lit("value_mismatch").alias("kind"),
        F.array_join(F.transform("values", lambda v: v.cast("string")), "|").alias("values"), F.array_join("origins", "|").alias("origins"),
    )


def binary_conflicts(facts: DataFrame) -> DataFrame:
    """Tasks of one canonical sample with both true and false, unless one and the same origin says both."""
    label = X.norm_label("canonical_label")
    found = facts.withColumn("label", label).filter("label in ('true', 'false')").groupBy("canonical_sample_id", "canonical_task").agg(
        F.sort_array(F.collect_set(F.when(F.col("label") == "true", F.col("origin_sample_id")))).alias("origins_true"),
        F.sort_array(F.collect_set(F.when(F.col("label") == "false", F.col("origin_sample_id")))).alias("origins_false"),
    )
    both = (F.size("origins_true") > 0) & (F.size("origins_false") > 0)
    differ = (F.col("origins_true") != F.col("origins_false")) | (F.size(F.array_union("origins_true", "origins_false")) > 1)
    return found.filter(both & differ).select(
        "canonical_sample_id", "canonical_task", F.lit("binary_true_false").alias("kind"),
        F.array_join("origins_true", "|").alias("origins_true"), F.array_join("origins_false", "|").alias("origins_false"),
    )


def tier_rank(c: Column | str) -> Column:
    c = X.col(c)
    out = F.lit(-1)
    for name, rank in TIERS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


#: What a surviving fact is told apart by.
FACT_KEY = ("canonical_task", "label", "value", "label_source", "source_field", "supervision_tier")


def reconciled(facts: DataFrame) -> DataFrame:
    """Facts without conflicts, one for each key; the best tier stands, then the first by source, and all origins are kept."""
    wrong = value_conflicts(facts).select("canonical_sample_id", "canonical_task", "label").unionByName(
        binary_conflicts(facts).select("canonical_sample_id", "canonical_task").withColumn("label", F.explode(F.array(F.lit("true"), F.lit("false"))))
    )
    own = facts.withColumn("label", X.norm_label("canonical_label")).withColumn("value", X.norm_value("value"))
    wrong = wrong.distinct().select(*[F.col(c).alias(f"_{c}") for c in ("canonical_sample_id", "canonical_task", "label")])
    kept = own.join(wrong, F.expr("canonical_sample_id <=> _canonical_sample_id and canonical_task <=> _canonical_task and label <=> _label"), "left_anti")
    keys = ["canonical_sample_id", *FACT_KEY]
    last = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    order = F.struct((-tier_rank("supervision_tier")).alias("t"), *[last(c).alias(f"o_{c}") for c in ("source_dataset", "label_source", "source_field", "source_label", "origin_sample_id")])
    return kept.groupBy(*keys).agg(
        F.min_by(F.struct("source_label", "source_dataset"), order).alias("best"), F.array_join(F.sort_array(F.collect_set("origin_sample_id")), "|").alias("origins"),
        F.size(F.collect_set("origin_sample_id")).cast("long").alias("n_origins"), F.count("*").alias("n_facts"),
    ).select(*keys, F.col("best.source_label").alias("source_label"), F.col("best.source_dataset").alias("source_dataset"), "origins", "n_origins", "n_facts")


def reconciliation_statistics(facts: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: facts before and after, conflicts of both kinds, facts that several origins share, facts that add to a sample's first."""
    per = clean.groupBy("canonical_sample_id").agg((F.countDistinct("canonical_task", "label", "value") - 1).alias("more"))
    counts = [
        facts.agg(F.count("*").alias("facts_before")),
        clean.agg(F.count("*").alias("facts_after"), F.count_if(F.col("n_origins") > 1).alias("identical")),
        per.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("complementary")),
        value_conflicts(facts).agg(F.count("*").alias("value_conflicts")),
        binary_conflicts(facts).agg(F.count("*").alias("binary_conflicts")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out


CORNERS = ("x_min", "y_min", "x_max", "y_max")


def reconciled_spatial(annotations: DataFrame, digits: int = 6) -> DataFrame:
    """Annotations moved to canonical samples, one for each geometry (corners rounded half to even), numbered within the sample."""
    corners = [F.bround(F.col(c), digits).alias(f"g_{c}") for c in CORNERS]
    keys = ["canonical_sample_id", "annotation_task", "canonical_label", "annotation_type", "mask_path", *[f"g_{c}" for c in CORNERS]]
    merged = annotations.select("*", *corners).groupBy(*keys).agg(
        F.min_by("annotation_id", F.struct("origin_sample_id", "annotation_id")).alias("annotation_id"),
        F.array_join(F.sort_array(F.collect_set("origin_sample_id")), "|").alias("origins"), F.count("*").alias("n_annotations"),
    )
    order = W.partitionBy("canonical_sample_id").orderBy(*[F.col(c).asc_nulls_last() for c in keys[1:]])
    return merged.withColumn("ordinal", F.row_number().over(order) - 1)


def multi_instances(clean: DataFrame) -> DataFrame:
    """Samples with several geometries of one task and label: legal, and reported."""
    return clean.groupBy("canonical_sample_id", "annotation_task", "canonical_label").agg(F.count("*").alias("n_instances")).filter("n_instances > 1")


def resolved_masks(masks: DataFrame) -> DataFrame:
    """Of several masks of a sample the only one of its own origin; a sample where that fails is unresolved."""
    own = F.col("origin_sample_id") == F.col("canonical_sample_id")
    counts = masks.groupBy(F.col("canonical_sample_id").alias("_of")).agg(F.count("*").alias("n"), F.count_if(own).alias("n_own"))
    out = masks.join(counts, F.col("canonical_sample_id").eqNullSafe(F.col("_of")))
    kept = (F.col("n") == 1) | ((F.col("n_own") == 1) & own)
    state = F.when(F.col("n") == 1, "single").when(F.col("n_own") == 1, F.when(own, "own_origin").otherwise("dropped")).otherwise("unresolved")
    return out.select(*masks.columns, state.alias("resolution"), kept.alias("kept"))


def assignments(labels: DataFrame, spatial: DataFrame, samples: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """A row for each label, each spatial annotation, and each sample that has neither, with its pool and eligibility."""
    base = ["sample_id", "origin_sample_id", "dataset", "canonical_task", "canonical_label", "label_source", "supervision_tier"]
    null = lambda c: F.lit(None).cast("string").alias(c)
    units = labels.select(*base, F.lit("label").alias("unit_type")).unionByName(
        spatial.select("sample_id", "origin_sample_id", "dataset", F.col("annotation_task").alias("canonical_task"), "canonical_label", "label_source", "supervision_tier", F.lit("spatial").alias("unit_type"))
    )
    orphans = samples.join(units.select("sample_id"), "sample_id", "left_anti").select(
        "sample_id", F.col("sample_id").alias("origin_sample_id"), "dataset", *[null(c) for c in base[3:]], F.lit("sample").alias("unit_type")
    )
    rules = policy.table(labels.sparkSession)  # a row for each dataset that the policy names
    out = units.unionByName(orphans).join(F.broadcast(rules), "dataset", "left")
    unknown = F.col("pool").isNull()
    pool = F.when(unknown, policy.default_pool).otherwise(F.col("pool"))
    reason = F.when(unknown, "default_policy").otherwise("dataset_policy")
    for source, override in policy.label_source_pools.items():
        hit = F.col("label_source") == source
        pool, reason = F.when(hit, override).otherwise(pool), F.when(hit, "label_source_override").otherwise(reason)
    off = F.lit(False)
    if policy.tasks:
        off = F.col("canonical_task").isNotNull() & ~F.col("canonical_task").isin(*policy.tasks)
        pool, reason = F.when(off, "excluded").otherwise(pool), F.when(off, "task_not_listed").otherwise(reason)
    predicted = F.coalesce(F.col("label_source") == "model_prediction", F.lit(False))
    out = out.withColumn("_pool", pool).withColumn("_reason", reason)
    pool = F.when(predicted, "pseudo").when((F.col("unit_type") == "spatial") & (F.col("label_source") == "unknown_mask_origin"), "auxiliary").otherwise(F.col("_pool"))
    reason = F.when(predicted, "model_prediction").when((F.col("unit_type") == "spatial") & (F.col("label_source") == "unknown_mask_origin"), "unknown_mask_origin").otherwise(F.col("_reason"))
    shut = F.col("_pool").isin("excluded", "external_holdout")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        "sample_id", "origin_sample_id", "dataset", "unit_type", "canonical_task", "canonical_label", "label_source", "supervision_tier", pool.alias("supervision_pool"),
        (flag("train") & ~shut).alias("eligible_for_train"),
        (flag("val") & ~shut & ~predicted).alias("eligible_for_val"),
        (flag("test") & ~predicted & (F.col("_pool") != "excluded")).alias("eligible_for_test"),
        reason.alias("reason"), F.lit(policy.version).alias("policy_version"),
    )


def pool_counts(assigned: DataFrame, by: Sequence[str] = ("supervision_pool", "unit_type")) -> DataFrame:
    return assigned.groupBy(*by).agg(F.count("*").alias("n"))
