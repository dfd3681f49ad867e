"""Reports of evaluations and audits: bundles of metrics, strata, concerns and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators import gate, metrics, stats
from tessella.operators.order import percentiles, with_percentiles


def decision_report(decided: DataFrame, limit: float = 0.25) -> DataFrame:
    """By dataset and overall: decisions, the share of retakes, and whether that calls for a review."""
    both = decided.select(F.explode(F.array("dataset", F.lit("overall"))).alias("dataset"), "decision")
    counts = both.groupBy("dataset").agg(F.count("*").alias("n"), *[F.count_if(F.col("decision") == k).alias(f"n_{k}") for k in gate.RANK])
    return counts.withColumn("retake_rate", F.col("n_retake") / F.col("n")).withColumn("review", F.col("retake_rate") >= limit)


def by_stratum(df: DataFrame, stratum: str, score: str, clear: float, retake: float) -> DataFrame:
    """By stratum: the median of a score, and the shares of its upper and middle bands."""
    v = F.col(score)
    out = df.groupBy(stratum).agg(F.count("*").alias("n"), F.avg((v >= retake).cast("double")).alias("true_rate"), F.avg(((v > clear) & (v < retake)).cast("double")).alias("uncertain_rate"))
    return with_percentiles(out, df, score, {"median": 0.5}, [stratum])


def band_violations(rows: DataFrame, clear: float, retake: float) -> DataFrame:
    """Rows of a check of a probability whose finding or effect is not that of its band; a clear one may pass or have no effect."""
    band = X.band("score", clear, retake, ("clear", "uncertain", "stain"))
    e, f = F.coalesce("decision_effect", F.lit("")), F.coalesce("finding", F.lit(""))
    right = F.when(band == "clear", (f == "false") & e.isin("", "pass")).when(band == "uncertain", (f == "uncertain") & (e == "warning")).otherwise((f == "true") & (e == "retake"))
    return rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("band", band).filter(~right).select("sample_id", "band", "finding", "decision_effect")


def recommendation(samples: gate.Evaluated, base: Sequence[str], cast: str, occlusion: str, others: Sequence[str], bugs: int, shifted: bool) -> DataFrame:
    """One row: what follows from the retakes that checks add to those of `base`. others: the checks beside `cast` that may
    ask for a retake too; bugs: violations found before; shifted: whether scores differ between domains. Limits are the
    fixed values of the rule."""
    asked = {n: samples.worst([n]) == 2 for n in (cast, occlusion)}
    before, after = samples.worst(base) == 2, samples.worst() == 2
    one = samples.rows.agg(
        F.count_if(after & ~before).alias("newly_rejected"), F.count_if(after & ~before & asked[cast] & (samples.worst(others) < 2)).alias("alone"),
        F.count_if(asked[cast]).alias("cast_retakes"), F.count_if(asked[occlusion]).alias("occlusion_retakes"),
    )
    concerns = F.concat_ws(
        "|", F.when(F.lit(shifted) & (F.col("alone") >= F.greatest(F.lit(20), F.floor(0.4 * F.greatest("newly_rejected", F.lit(1))))), "DOMAIN_CONCERN"),
        F.when(F.col("cast_retakes") >= 20, "CAST_CONCERN"), F.when(F.col("occlusion_retakes") >= 10, "OCCLUSION_CONCERN"),
    )
    said = F.when(F.lit(bugs > 0), "BUG_FOUND").when(F.instr("concerns", "|") > 0, "MULTIPLE_CONCERNS").when(F.col("concerns") != "", F.col("concerns")).otherwise("READY")
    return one.withColumn("concerns", concerns).select(said.alias("recommendation"), "concerns", "newly_rejected", "cast_retakes", "occlusion_retakes")


def _one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def ranking_summary(scores: DataFrame) -> DataFrame:
    """One row: AUROC, average precision, Brier, calibration error and the metrics at 0.5."""
    at = metrics.confusion(scores, 0.5).select("precision", "recall", "specificity", "f1", "accuracy", "balanced_accuracy")
    return _one_row(metrics.auroc(scores), metrics.average_precision(scores), metrics.brier(scores), metrics.calibration_error(scores), at)


def frozen_test(scores: DataFrame, clear: float, retake: float, target: dict[str, float], minimum: dict[str, float], least_coverage: float = 0.30) -> DataFrame:
    """One row: the ranking and the three states under thresholds that were frozen before, missed and false cases, and whether
    the target, the minimum or neither is met. Limits: auroc, stain_precision, stain_recall, clear_purity."""
    band = X.band("score", clear, retake, ("clear", "uncertain", "stain"))
    missed = scores.agg(F.count_if((F.col("label") == 1) & (band != "stain")).alias("false_negatives"), F.count_if((F.col("label") == 0) & (band == "stain")).alias("false_positives"))
    one = _one_row(ranking_summary(scores), metrics.three_state(scores, clear, retake), missed)

    def meets(limits: dict[str, float]) -> Column:
        out = F.lit(True)
        for name in ("auroc", "stain_precision", "stain_recall", "clear_purity"):
            out = out & (F.coalesce(F.col(name), F.lit(0.0)) >= limits.get(name, 0.85))
        return out

    return one.withColumn("status", F.when(meets(target), "TARGET_PASS").when(meets(minimum), "MINIMUM_PASS").otherwise("NEEDS_IMPROVEMENT")).withColumn("low_coverage", F.col("coverage") < least_coverage)


def ranking_by_stratum(scores: DataFrame, strata: DataFrame, clear: float, retake: float) -> DataFrame:
    """By stratum of strata(sample_id, decision), null where a sample has none: cases, AUROC and the share of the middle band."""
    joined = scores.join(strata.select("sample_id", F.col("decision").alias("stratum")), "sample_id", "left")
    v = F.col("score")
    n = joined.groupBy("stratum").agg(F.count("*").alias("n"), F.avg(((v > clear) & (v < retake)).cast("double")).alias("uncertain_rate"))
    a = metrics.auroc(joined, ["stratum"]).withColumnRenamed("stratum", "_of")
    return n.join(a, F.col("stratum").eqNullSafe(F.col("_of")), "left").drop("_of")


def evaluation_report(images: DataFrame, value: str = "dice") -> DataFrame:
    """By domain and overall: images, the mean and the percentiles of a metric, empty and nearly full predictions; and the
    distance of each domain's mean from the best one's."""
    both = images.withColumn("scope", F.explode(F.array("dataset", F.lit("overall"))))
    out = both.groupBy("scope").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.count_if("empty_prediction").alias("n_empty"), F.count_if("near_full_prediction").alias("n_near_full"))
    out = with_percentiles(out, both, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["scope"])
    best = out.filter("scope <> 'overall'").agg(F.max("mean").alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("gap", F.when(F.col("scope") != "overall", F.col("best") - F.col("mean"))).drop("best")  # one row


def running_means(rows: DataFrame, values: Sequence[str], domain: str = "dataset") -> DataFrame:
    """Means of several metrics by domain and overall."""
    out = rows.rollup(domain).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values], F.grouping(domain).alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(domain)).alias("scope"), "n", *values)


def class_balance(labelled: DataFrame) -> DataFrame:
    """By split and overall: cases, positive and negative, and the share of positives."""
    both = labelled.select(F.explode(F.array("split", F.lit("overall"))).alias("split"), "label")
    n = both.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return n.withColumn("positive_rate", F.col("positive") / F.col("n"))


def supervision_counts(facts: DataFrame) -> DataFrame:
    """By task and label: facts of yes, facts of no, and samples that say nothing of it."""
    total = facts.agg(F.countDistinct("sample_id").alias("all"))
    n = facts.groupBy("canonical_task", "canonical_label").agg(F.count_if(F.col("value") == 1).alias("positive"), F.count_if(F.col("value") == 0).alias("negative"), F.countDistinct("sample_id").alias("known"))
    return n.crossJoin(F.broadcast(total)).select("canonical_task", "canonical_label", "positive", "negative", (F.col("all") - F.col("known")).alias("unknown"))  # one row


def tail_proposals(df: DataFrame, score: str) -> DataFrame:
    """One row: 98th and 99.5th percentiles as warning and retake; a retake not above the warning is raised to 1.2 times it plus 0.01."""
    q = percentiles(df, score, [0.98, 0.995, 0.5, 0.95]).select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("warning", "_retake", "p50", "p95"))])
    raised = F.when(F.col("_retake") <= F.col("warning"), F.col("warning") * 1.2 + 0.01).otherwise(F.col("_retake"))
    return _one_row(df.agg(F.count(score).alias("n")), q).select("n", "warning", raised.alias("retake"), "p50", "p95")


def sweep_rates(rows: DataFrame, by: Sequence[str] = ("direction", "strength")) -> DataFrame:
    """Of synthetic cases: the share that is detected (warned of or retaken), the share retaken, and unavailable ones."""
    e = F.coalesce("decision_effect", F.lit(""))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(e.isin("warning", "retake")).alias("detected"), F.count_if(e == "retake").alias("retaken"), F.count_if(F.col("evaluation_state") == "unavailable").alias("unavailable"))
    return n.withColumn("detection_rate", F.col("detected") / F.col("n")).withColumn("retake_rate", F.col("retaken") / F.col("n"))


def domain_comparison(df: DataFrame, features: Sequence[str], domain: str, a: str, b: str) -> DataFrame:
    """Features in which two domains differ: medians, their difference and Cohen's d of the second against the first, by |d|."""
    two = df.filter(F.col(domain).isin(a, b)).withColumn("label", (F.col(domain) == b).cast("int"))
    long = stats.long_form(two, ["label"], features)
    d = stats.cohens_d(long).select("feature", "d")
    sides = long.select("feature", F.when(F.col("label") == 0, F.col("value")).alias("v0"), F.when(F.col("label") == 1, F.col("value")).alias("v1"))
    out = with_percentiles(with_percentiles(d, sides, "v0", {"median_a": 0.5}, ["feature"]), sides, "v1", {"median_b": 0.5}, ["feature"])
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("d")), "feature"))  # a row for each feature
    return out.select("feature", "median_a", "median_b", (F.col("median_b") - F.col("median_a")).alias("difference"), "d", rank.alias("rank"))


def shift_report(scores: DataFrame, clear: float, retake: float, domain: str = "dataset", shifted: float = 0.20, apart: float = 0.25) -> DataFrame:
    """By domain: cases in each band and their shares, and for all rows alike whether a domain has too many in the upper
    band, and whether two domains are too far apart in it."""
    band = X.band("score", clear, retake, ("clear", "uncertain", "stain"))
    n = scores.groupBy(domain).agg(F.count("*").alias("n"), *[F.count_if(band == k).alias(f"n_{k}") for k in ("clear", "uncertain", "stain")], F.count_if(F.col("score").isNull()).alias("n_missing"))
    known = F.col("n") - F.col("n_missing")
    n = n.withColumn("stain_rate", F.when(known > 0, F.col("n_stain") / known)).withColumn("uncertain_rate", F.when(known > 0, F.col("n_uncertain") / known))
    n = with_percentiles(n, scores, "score", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, [domain])
    flags = n.agg(F.coalesce(F.max("stain_rate") > shifted, F.lit(False)).alias("possible_shift"), F.coalesce(F.max("stain_rate") - F.min("stain_rate") >= apart, F.lit(False)).alias("identity_shift"))
    return n.crossJoin(F.broadcast(flags))  # one row


def coarse_confounding(df: DataFrame, label: str, limits: dict[str, float]) -> DataFrame:
    """One row: medians of both classes, their gaps, and whether a gap is over its limit."""
    out = df.agg(F.count("*").alias("n"))
    for name in limits:
        for y in (0, 1):
            out = with_percentiles(out, df.select(F.when(F.col(label) == y, F.col(name).cast("double")).alias("v")), "v", {f"{name}_{y}": 0.5})
    gaps = {f"{name}_gap": F.abs(F.col(f"{name}_1") - F.col(f"{name}_0")) for name in limits}
    over = F.lit(False)
    for name, limit in limits.items():
        over = over | F.coalesce(gaps[f"{name}_gap"] > limit, F.lit(False))
    return out.withColumns(gaps).withColumn("suspected", over)


def style_sensitivity(rows: DataFrame) -> DataFrame:
    """rows(sample_id, dataset, base_1, styled_1, base_2, styled_2), logits of two models before and after a change of style:
    by dataset and overall the means over samples of their mean change, and how far the second model improves on the first."""
    per = rows.groupBy("dataset", "sample_id").agg(*[F.avg(F.abs(F.col(f"styled_{m}") - F.col(f"base_{m}"))).alias(f"delta_{m}") for m in (1, 2)])
    both = per.select(F.explode(F.array("dataset", F.lit("overall"))).alias("scope"), "delta_1", "delta_2")
    out = both.groupBy("scope").agg(F.count("*").alias("n"), F.avg("delta_1").alias("delta_1"), F.avg("delta_2").alias("delta_2"))
    return out.withColumn("improvement", F.when(F.col("delta_1") > 1e-8, 1 - F.col("delta_2") / F.col("delta_1")))


def round_robin(df: DataFrame, k: int, domain: str = "dataset", key: str = "sample_id") -> DataFrame:
    """A report: k rows taken from the domains in turn, in the order of their keys."""
    ranked = metrics.first_of_each(df, [domain], [key], k)
    return ranked.orderBy("rank", domain).limit(k).drop("rank")


def heads(df: DataFrame, per_domain: dict[str, int], domain: str = "dataset", key: str = "sample_id") -> DataFrame:
    """A report: the first rows of each named domain, so many of each."""
    ranked = metrics.first_of_each(df.filter(F.col(domain).isin(*per_domain)), [domain], [key], max(per_domain.values()))
    most = F.lit(0)
    for name, n in per_domain.items():
        most = F.when(F.col(domain) == name, n).otherwise(most)
    return ranked.filter(F.col("rank") <= most).drop("rank")


def review_lists(df: DataFrame, lists: dict[str, tuple[str, bool]], k: int = 20, key: str = "sample_id") -> DataFrame:
    """A report: the k rows of greatest (or, where False, least) value for each list name -> (column, greatest)."""
    out = None
    for name, (column, greatest) in lists.items():
        found = df.filter(F.col(column).isNotNull()).orderBy(F.desc(column) if greatest else F.asc(column), key).limit(k).select(F.lit(name).alias("list"), key, F.col(column).cast("double").alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def largest_effects(effects: DataFrame, k: int = 10) -> DataFrame:
    """A report: the k effects of greatest size."""
    return effects.filter(F.col("d").isNotNull()).orderBy(F.desc(F.abs("d")), "feature").limit(k)


def no_leaking_features(features: Sequence[str], more: Sequence[str] = ()) -> None:
    """Raises where a classifier would be given a column that names a sample, its place or its label."""
    barred = {"sample_id", "md5", "source_image_path", "path", "filename", "split", "dataset", "label", "canonical_label", "folder_batch", "file_extension", *more}
    found = [f for f in features if f in barred]
    if found:
        raise ValueError(f"these may not be features: {found}")
