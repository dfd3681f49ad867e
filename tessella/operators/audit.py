"""Audits of sources and of what models learn from them, and the decisions that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import metrics as M


def scan_report(files: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Of inspected files(dataset, path, md5, width, height, stem, error): counts, most frequent sizes and stems, largest copies."""
    n = files.groupBy("dataset").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("error").isNull()).alias("readable"), F.count_if(F.col("error").isNotNull()).alias("corrupt"), F.countDistinct("md5").alias("unique_digests"),
    )
    copies = files.groupBy("dataset", "md5").agg(F.count("*").alias("n")).filter("n > 1")
    extra = copies.groupBy("dataset").agg(F.count("*").alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("extra_files"))
    most = lambda key: M.first_of_each(files.filter(F.col(key).isNotNull()).groupBy("dataset", key).agg(F.count("*").alias("n")), ["dataset"], [F.desc("n"), key], top)
    sized = files.withColumn("size", F.concat_ws("x", "width", "height"))
    sizes = M.first_of_each(sized.filter("error is null").groupBy("dataset", "size").agg(F.count("*").alias("n")), ["dataset"], [F.desc("n"), "size"], top)
    return {"counts": n.join(extra, "dataset", "left").fillna(0, ["duplicate_groups", "extra_files"]), "sizes": sizes, "stems": most("stem"), "copies": M.first_of_each(copies, ["dataset"], [F.desc("n"), "md5"], top)}


def pairing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both sides, of one only, and the share of the first that is paired."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))
    return n.withColumn("rate", M.ratio(F.col("paired"), F.col("paired") + F.col("only_first")))


def name_drift(first: Sequence[str], second: Sequence[str]) -> list[tuple[int, str | None, str | None]]:
    """Where two lists of class names differ."""
    n = max(len(first), len(second))
    a, b = [*first, *[None] * (n - len(first))], [*second, *[None] * (n - len(second))]
    return [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]


def hash_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def diagnostic_classifier(df: DataFrame, features: Sequence[str], label: str, key: str = "sample_id", folds: int = 5, kind: str = "logistic") -> DataFrame:
    """Scores of each row by a model that has not seen its fold: missing values are medians, features scaled, classes weighed alike.

    Folds go by hash, so a row's fold is the same in every run. Returns (key, label, score, fold).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = df.groupBy(label).agg(F.count("*").alias("n"))
    weights = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"), F.count("*").alias("k")))).select(F.col(label).alias("_y"), (F.col("total") / (F.col("k") * F.col("n"))).alias("_w"))  # a row for each class
    rows = hash_folds(df, key, folds).join(F.broadcast(weights), F.col(label) == F.col("_y")).withColumn("_y", F.col(label).cast("double"))
    rows = rows.withColumns({f: F.col(f).cast("double") for f in features})
    filled = [f"_f_{f}" for f in features]
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-3, maxIter=100) if kind == "logistic" else RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=50, seed=7)
    steps = Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), model])
    out = None
    for fold in range(folds):
        scored = steps.fit(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold))
        part = scored.select(key, F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


def identity_accuracy(scored: DataFrame) -> DataFrame:
    """One row: accuracy over all folds, its mean and deviation between folds."""
    per = scored.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"))


def gate_status(value: Column, target: float, minimum: float) -> Column:
    """target_met, minimum_met or failed."""
    return F.when(value.isNull(), "unknown").when(value >= target, "target_met").when(value >= minimum, "minimum_met").otherwise("failed")


def gap_reduction(before: Column, after: Column) -> Column:
    """1 - after / before; null for no gap before."""
    return F.when(F.abs(before) > 1e-12, 1 - after / before)


def candidate_verdict(drop: Column, gain: Column, most_drop: float = 0.01, least_gain: float = 0.1) -> Column:
    """A candidate is taken if it loses little at home and gains enough abroad."""
    return F.when(drop.isNull() | gain.isNull(), "incomplete").when(drop > most_drop, "rejected_regression").when(gain < least_gain, "rejected_no_gain").otherwise("accepted")


def data_action(level: Column, match_rate: Column, support: Column) -> Column:
    """What to do about a confounded source."""
    return F.when(level == "SEVERE", "recollect").when((level == "HIGH") & (match_rate < 0.5), "collect_matched").when(level.isin("HIGH", "MODERATE"), F.when(support < 0.8, "restrict_to_support").otherwise("reweight")).otherwise("keep")


def evidence(effect: Column) -> Column:
    """Names for the size of an effect."""
    x = F.abs(effect)
    return F.when(x.isNull(), "unknown").when(x >= 0.8, "strong").when(x >= 0.5, "moderate").when(x >= 0.2, "weak").otherwise("none")


def verdict(bugs: Column, concerns: Column) -> Column:
    return F.when(bugs > 0, "fix_first").when(concerns >= 3, "hold").when(concerns > 0, "proceed_with_care").otherwise("proceed")


def regression(now: DataFrame, reference: DataFrame, warn: float = 0.01, fail: float = 0.02) -> DataFrame:
    """(domain, metric now, before, delta, status): how far a metric fell by domain."""
    j = now.select("domain", F.col("metric").alias("now")).join(reference.select("domain", F.col("metric").alias("before")), "domain", "full_outer").withColumn("delta", F.col("now") - F.col("before"))
    return j.withColumn("status", F.when(F.col("delta").isNull(), "missing").when(F.col("delta") < -fail, "failed").when(F.col("delta") < -warn, "warning").otherwise("ok"))
