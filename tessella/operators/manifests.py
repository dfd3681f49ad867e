"""Manifests that a training run would read: masks with their pictures and splits, labelled samples with their splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import curate, validate
from tessella.policy import SPLITS


def mask_candidates(spatial: DataFrame, task: str, kind: str, datasets: Sequence[str]) -> DataFrame:
    """Annotations of one task and type from some datasets."""
    return spatial.filter((F.col("annotation_task") == task) & (F.col("annotation_type") == kind) & F.col("source_dataset").isin(*datasets))


def segmentation(masks: DataFrame, samples: DataFrame, splits: DataFrame, assigned: DataFrame, task: str) -> DataFrame:
    """A row for each mask of mask_candidates() with its picture, split and pool, and `problem`, null where the row is good.

    masks: (sample_id, annotation_id, mask_path, source_dataset, origin_sample_id, foreground_ratio, mask_width, mask_height);
    of several masks of a sample the one of its own origin counts. A sample without a pool of the task has `unknown`.
    """
    resolved = curate.resolved_masks(masks.withColumn("canonical_sample_id", F.col("sample_id")))
    pools = assigned.filter((F.col("unit_type") == "spatial") & (F.col("canonical_task") == task)).groupBy("sample_id").agg(F.max("supervision_pool").alias("pool"))
    meta = samples.select("sample_id", "md5", "width", "height", F.col("source_image_path").alias("image_path"), F.lit(True).alias("has_sample"))
    split = splits.select("sample_id", "split", "split_group_id", F.lit(True).alias("has_split"))
    rows = resolved.filter(F.col("kept") | (F.col("resolution") == "unresolved")).join(meta, "sample_id", "left").join(split, "sample_id", "left").join(pools, "sample_id", "left")
    return rows.select(
        "sample_id", F.col("source_dataset").alias("dataset"), "split", "split_group_id", "md5", "image_path", "mask_path", "width", "height", "foreground_ratio", "annotation_id", "origin_sample_id",
        F.coalesce("pool", F.lit("unknown")).alias("supervision_pool"), _mask_problem().alias("problem"),
    )


def _mask_problem() -> Column:
    return (
        F.when(F.col("resolution") == "unresolved", "several_masks").when(F.col("has_sample").isNull(), "no_sample").when(F.col("has_split").isNull(), "no_split")
        .when(~F.col("split").isin(*SPLITS), "unexpected_split").when(F.col("image_path").isNull(), "missing_image").when(F.col("mask_path").isNull(), "missing_mask")
        .when((F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height")), "shape_mismatch").when(F.col("foreground_ratio") <= 0, "empty_mask")
    )


def usable(manifest: DataFrame) -> DataFrame:
    return manifest.filter("problem is null").drop("problem")


def segmentation_audit(manifest: DataFrame, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """By dataset and overall: rows, good ones by split, problems, full masks and extreme shares of foreground."""
    good = F.col("problem").isNull()
    both = manifest.withColumn("scope", F.explode(F.array("dataset", F.lit("overall"))))
    extreme = (F.col("foreground_ratio") < low) | (F.col("foreground_ratio") > high)
    return both.groupBy("scope").agg(
        F.count("*").alias("n"), *[F.count_if(good & (F.col("split") == s)).alias(f"n_{s}") for s in SPLITS], F.count_if(~good).alias("n_problems"),
        F.count_if(good & (F.col("foreground_ratio") >= 1)).alias("n_full"), F.count_if(good & extreme).alias("n_extreme"), F.avg(good.cast("double")).alias("pairing_rate"),
    )


def segmentation_violations(manifest: DataFrame) -> DataFrame:
    """What a manifest of good rows may not show: (rule, key)."""
    rows = usable(manifest)
    leak = lambda key: rows.groupBy(key).agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit(f"{key}_in_one_split").alias("rule"), F.col(key).cast("string").alias("key"))
    return validate.together(
        manifest.filter("problem is not null").select(F.col("problem").alias("rule"), F.col("sample_id").alias("key")), validate.duplicates(rows, "sample_id_unique"), leak("sample_id"), leak("md5"),
    )


def labelled(samples: DataFrame, labels: DataFrame, splits: DataFrame, dataset: str, task: str, positive: str, negative: str) -> DataFrame:
    """The samples of a dataset with a label of the task and their split, not yet eligible; a label that is neither is an error."""
    label = F.lower(F.trim("canonical_label"))
    y = F.when(label == positive, 1).when(label == negative, 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("canonical_label", F.lit("null")))).cast("int"))
    own = labels.filter(F.col("canonical_task") == task).select("sample_id", y.alias("label"))
    out = samples.filter(F.col("dataset") == dataset).join(own, "sample_id").join(splits.select("sample_id", "split"), "sample_id")
    return out.withColumn("eligible", F.lit(False)).withColumn("exclusion_reason", F.lit("pending"))


def labelled_violations(rows: DataFrame, labels: DataFrame, barred: Sequence[str] = ()) -> DataFrame:
    """(rule, key): samples with two labels, ids and digests in several splits, tasks that may not be there, missing splits."""
    spark = rows.sparkSession
    leak = lambda key: rows.groupBy(key).agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit(f"{key}_in_one_split").alias("rule"), F.col(key).cast("string").alias("key"))
    wanted = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    missing = wanted.join(rows.select("split").distinct(), "split", "left_anti").select(F.lit("split_is_missing").alias("rule"), F.col("split").alias("key"))
    found = [validate.duplicates(rows, "one_label"), leak("sample_id"), leak("md5"), missing]
    if barred:
        found.append(labels.filter(F.col("canonical_task").isin(*barred)).join(rows.select("sample_id").distinct(), "sample_id", "left_semi").select(F.lit("barred_task").alias("rule"), F.col("sample_id").alias("key")))
    return validate.together(*found)


def with_preflight(rows: DataFrame, found: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """rows with what a preflight found(sample_id, ok, reason) of each, and one row with its success rate and whether that is
    `least` or more. A sample that the preflight has not seen stays pending."""
    seen = rows.drop("eligible", "exclusion_reason").join(found.select("sample_id", "ok", "reason"), "sample_id", "left")
    out = seen.withColumn("eligible", F.coalesce("ok", F.lit(False))).withColumn("exclusion_reason", F.when(F.col("ok").isNull(), "pending").when(~F.col("ok"), F.coalesce("reason", F.lit("failed")))).drop("ok", "reason")
    rate = out.agg(F.count("*").alias("n"), F.avg(F.col("eligible").cast("double")).alias("rate")).withColumn("passed", F.coalesce(F.col("rate") >= least, F.lit(False)))
    return out, rate


def confounding(rows: DataFrame, split: str, path: str = "source_image_path") -> DataFrame:
    """Eligible rows of one split that have a picture, with the batch of its folder and its extension."""
    parts = F.split(F.regexp_replace(path, r"\\\\", "/"), "/")
    batch = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise("unknown")
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return rows.filter(F.col("eligible") & (F.col("split") == split) & F.col(path).isNotNull()).withColumn("folder_batch", batch).withColumn("file_extension", extension)


def diagnosis_pool(parts: dict[str, DataFrame]) -> DataFrame:
    """Domains under one another, with their name in domain_group; columns that a domain lacks are null."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("domain_group", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
