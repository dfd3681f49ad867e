"""The given tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.policy import CleaningPolicy, DatasetRule, SplitPolicy

POLICY = CleaningPolicy(
    version="1",
    datasets={"en": DatasetRule("gold_candidate"), "fr": DatasetRule("silver", val=False), "de": DatasetRule("silver", val=False, test=False), "es": DatasetRule("external_holdout", train=False, val=False)},
    label_source_pools={"src3": "auxiliary"},
    tasks=("quality", "toxic"),
)
SPLIT = SplitPolicy(holdout_datasets=("es",), core_tasks=("quality", "toxic"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as samples; the dataset is the language, the digest that of the text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("::", "lang", F.col("doc_id").cast("string")).alias("sample_id"), F.col("lang").alias("dataset"), F.col("source"), F.md5("text").alias("md5"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_image_path"), F.lit(None).cast("string").alias("patient_id"), F.col("doc_id"), F.col("n_chars"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as facts: two tasks, positive where 1."""
    known = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    long = known.select("doc_id", "lang", "source", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (canonical_task, value)"))
    return long.select(
        F.concat_ws("::", "lang", F.col("doc_id").cast("string")).alias("sample_id"), F.col("lang").alias("dataset"), "canonical_task", F.concat(F.lit("is_"), "canonical_task").alias("canonical_label"),
        "value", F.col("source").alias("label_source"), F.lit("silver").alias("supervision_tier"), F.col("lang").alias("source_dataset"), F.lit("labels").alias("source_field"), F.col("canonical_task").alias("source_label"),
    )


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as facts of one canonical sample, with conflicting values."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("canonical_sample_id"), F.col("l_linenumber").cast("string").alias("origin_sample_id"), F.col("l_returnflag").alias("canonical_task"),
        F.col("l_linestatus").alias("canonical_label"), (F.col("l_discount") >= 0.05).cast("int").alias("value"), F.when(F.col("l_tax") > 0.04, "gold").otherwise("silver").alias("supervision_tier"),
        F.lit("human").alias("label_source"), F.lit(None).cast("string").alias("source_field"), F.col("l_suppkey").cast("string").alias("source_label"), F.lit("lines").alias("source_dataset"),
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as true and false facts of users."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("canonical_sample_id"), F.col("event_id").cast("string").alias("origin_sample_id"), F.col("event_type").alias("canonical_task"),
        F.when(F.col("value") >= 50, " TRUE").otherwise("false").alias("canonical_label"), F.lit(1).alias("value"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("canonical_sample_id"), F.col("l_linenumber").cast("string").alias("origin_sample_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("annotation_id"),
        F.col("l_returnflag").alias("annotation_task"), F.col("l_linestatus").alias("canonical_label"), F.lit("bbox").alias("annotation_type"), F.lit(None).cast("string").alias("mask_path"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("x_min"), F.lit(0.0).alias("y_min"), F.col("l_quantity").alias("x_max"), F.floor(F.col("l_discount") * 20).cast("double").alias("y_max"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality as the label, and a score that the text's length gives."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("dataset"), "source", F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.col("n_chars")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers about labelled texts. They are taken before the join, which then moves no text."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^.,]", "")).alias("stops"),
    )
    known = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return known.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id"), F.col("lang").alias("dataset"), "source", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("chars"),
        "words", "lines", (F.col("stops") / F.col("n_chars")).alias("stops"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage groups of the clean samples, tied by digest and by the digest of the text in lower case, as a stand-in for a patient."""
    from tessella.operators import curate, split

    own = samples(spark, sf_dir)
    decided = curate.decisions(own, POLICY)
    heads = table(spark, sf_dir, "documents").select(F.concat_ws("::", "lang", F.col("doc_id").cast("string")).alias("sample_id"), F.md5(F.lower("text")).alias("patient_id"))
    raw = own.drop("patient_id").join(heads, "sample_id")
    policy = SplitPolicy(holdout_datasets=SPLIT.holdout_datasets, core_tasks=SPLIT.core_tasks, patient_datasets=("en", "fr", "de", "es"))
    return split.leakage_groups(curate.clean_samples(own, decided), decided, raw, policy)
