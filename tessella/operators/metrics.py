"""Metrics of scores and of masks, as aggregates. Scores: (label 0/1, score), and grouping columns where named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scalars as X
from tessella.operators.order import percentiles, running, with_percentiles


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def confusion(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Counts and the ratios from them; a ratio without cases is 0."""
    hit = F.col("score") >= threshold
    n = scores.groupBy(*by).agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("label") == 0)).alias("tn"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = n.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("specificity", ratio(tn, tn + fp)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def _by_score(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cases and positives of each distinct score: what every ranking metric needs, combined before the shuffle."""
    return scores.filter("score is not null and label is not null").groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))


def auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with ties; null where a class is missing."""
    q = running(_by_score(scores, by).withColumn("q", F.col("n") - F.col("p")), by, "score", {"upto": "q"}).withColumn("less", F.col("upto") - F.col("q"))
    wins = F.sum(F.col("p") * (F.col("less") + (F.col("n") - F.col("p")) / 2))
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return q.groupBy(*by).agg(wins.alias("w"), pos.alias("pos"), neg.alias("neg")).select(*by, ratio(F.col("w"), (F.col("pos") * F.col("neg")).cast("double"), None).alias("auroc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the step of recall over distinct scores, the highest first."""
    q = running(_by_score(scores, by), by, "score", {"cp": "p", "cn": "n"}, descending=True)
    out = q.groupBy(*by).agg(F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("s"), F.sum("p").alias("pos"))
    return out.select(*by, ratio(F.col("s"), F.col("pos"), None).alias("average_precision"))


def brier(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"))


def calibration_error(scores: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    per = scores.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def three_state(scores: DataFrame, clear: float, retake: float, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, purity of the clear and precision and recall of the retaken."""
    s = scores.withColumn("band", X.band("score", clear, retake, ("clear", "uncertain", "stain")))
    n = s.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("band") == "clear").alias("n_clear"), F.count_if(F.col("band") == "uncertain").alias("n_uncertain"), F.count_if(F.col("band") == "stain").alias("n_stain"),
        F.count_if((F.col("band") == "clear") & (F.col("label") == 0)).alias("clear_right"), F.count_if((F.col("band") == "stain") & (F.col("label") == 1)).alias("stain_right"), F.count_if(F.col("label") == 1).alias("pos"),
    )
    return n.select(
        *by, "n", "n_clear", "n_uncertain", "n_stain", ratio(F.col("clear_right"), F.col("n_clear")).alias("clear_purity"), ratio(F.col("stain_right"), F.col("n_stain")).alias("stain_precision"),
        ratio(F.col("stain_right"), F.col("pos")).alias("stain_recall"), ratio(F.col("n_clear") + F.col("n_stain"), F.col("n")).alias("coverage"),
    )


def mask_metrics(tp: Column, fp: Column, fn: Column, eps: float = 1e-7) -> dict[str, Column]:
    """Dice, IoU, precision and recall from counts of pixels; an empty truth is an error."""
    truth = F.when(tp + fn > 0, tp).otherwise(F.raise_error(F.lit("an empty mask of truth")).cast("double"))
    return {"dice": (2 * truth + eps) / (2 * tp + fp + fn + eps), "iou": (truth + eps) / (tp + fp + fn + eps), "precision": (truth + eps) / (tp + fp + eps), "recall": (truth + eps) / (tp + fn + eps)}


#: Percent points of the summaries.
POINTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def quantile_summary(df: DataFrame, value: str, by: Sequence[str] = (), points: Sequence[int] = POINTS) -> DataFrame:
    """Count, missing, mean, population deviation, extremes and interpolated percentiles."""
    v = F.col(value).cast("double")
    out = df.groupBy(*by).agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_percentiles(out, df, value, {f"p{p:02d}": p / 100 for p in points}, by)


def scoped_summary(df: DataFrame, values: Sequence[str], scope: str) -> DataFrame:
    """Summaries of several columns for each scope and overall, in long form."""
    long = df.select(scope, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value")) for v in values])).alias("f")).select(scope, "f.*")
    both = long.select("feature", F.explode(F.array(F.col(scope), F.lit("overall"))).alias("scope"), "value")
    out = both.groupBy("feature", "scope").agg(F.count("value").alias("count"), F.avg("value").alias("mean"))
    return with_percentiles(out, both, "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["feature", "scope"])


def nearest_rank(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The value at place round((n - 1) q), half to even, of the sorted values; by running counts, so that no list is gathered."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    r = running(n, by, "value", {"upto": "c"})
    total = n.groupBy(*by).agg(F.sum("c").alias("n"))
    r = r.join(total, list(by)) if by else r.crossJoin(F.broadcast(total))  # one row
    at = F.bround((F.col("n") - 1) * F.lit(q), 0)
    return r.filter((F.col("upto") - F.col("c") <= at) & (F.col("upto") > at)).select(*by, "value", "n")


def size_buckets(df: DataFrame, value: str) -> DataFrame:
    """small, medium (both edges included) and large by the 33rd and 66th percentiles."""
    edges = percentiles(df, value, [0.33, 0.66]).withColumnRenamed("q", "e")
    e = F.col("e")
    return df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.when(F.col(value) < e[0], "small").when(F.col(value) <= e[1], "medium").otherwise("large")).drop("e")  # one row


def worst(df: DataFrame, value: str, k: int, key: str = "sample_id") -> DataFrame:
    """A report: the k rows of least value, ties by key."""
    return df.orderBy(value, key).limit(k)


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """A report: the first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
