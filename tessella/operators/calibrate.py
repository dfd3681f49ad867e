"""Thresholds from scores and from features of good samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import metrics as M
from tessella.operators.order import percentiles, running, with_percentiles


def no_test(df: DataFrame) -> DataFrame:
    """df, in which a row of the test split is an error."""
    return df.withColumn("split", F.when(F.col("split") == "test", F.raise_error(F.lit("thresholds may not see the test split"))).otherwise(F.col("split")))


def dual_thresholds(scores: DataFrame, purity: float = 0.95, precision: float = 0.95, steps: int = 100) -> DataFrame:
    """One row: t_clear and t_retake on a grid of 1/steps, the pair of greatest coverage whose sides reach their targets.

    Scores are counted by grid cell first, so the pairs are of cells, whatever the number of scores. Of equal coverage the
    greater t_clear, then the lesser t_retake. Where one side has no threshold, the fixed fallbacks of the rule stand.
    """
    spark = scores.sparkSession
    grid = spark.range(1, steps).select((F.col("id") / float(steps)).alias("t"))
    up = scores.filter("score is not null").groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    # of each score the first grid point at or above it, and the last at or below
    cells = up.withColumn("above", F.ceil(F.round(F.col("score") * steps, 9)).cast("long")).withColumn("below", F.floor(F.round(F.col("score") * steps, 9)).cast("long"))
    total = cells.agg(F.sum("n").alias("total"))
    ids = spark.range(1, steps).select(F.col("id").alias("g"))
    clear = ids.join(cells.groupBy(F.col("above").alias("g")).agg(F.sum("n").alias("n"), F.sum("p").alias("p")).unionByName(cells.filter("above < 1").select(F.lit(1).cast("long").alias("g"), "n", "p")).groupBy("g").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "g", "left").fillna(0)
    retake = ids.join(cells.groupBy(F.col("below").alias("g")).agg(F.sum("n").alias("n"), F.sum("p").alias("p")).unionByName(cells.filter(F.col("below") >= steps).select(F.lit(steps - 1).cast("long").alias("g"), "n", "p")).groupBy("g").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "g", "left").fillna(0)
    one = W.partitionBy(F.lit(0))  # a row for each grid point
    clear = clear.withColumn("n", F.sum("n").over(one.orderBy("g"))).withColumn("p", F.sum("p").over(one.orderBy("g")))
    retake = retake.withColumn("n", F.sum("n").over(one.orderBy(F.desc("g")))).withColumn("p", F.sum("p").over(one.orderBy(F.desc("g"))))
    low = clear.filter((F.col("n") > 0) & (1 - F.col("p") / F.col("n") >= purity - 1e-12)).select(F.col("g").alias("lo"), F.col("n").alias("n_lo"))
    high = retake.filter((F.col("n") > 0) & (F.col("p") / F.col("n") >= precision - 1e-12)).select(F.col("g").alias("hi"), F.col("n").alias("n_hi"))
    pairs = F.broadcast(low).crossJoin(F.broadcast(high)).filter("lo < hi")  # at most steps**2 pairs
    best = pairs.agg(F.max(F.struct((F.col("n_lo") + F.col("n_hi")).alias("covered"), F.col("lo"), (-F.col("hi")).alias("minus"))).alias("best"))
    sides = low.agg(F.max("lo").alias("any_lo")).crossJoin(high.agg(F.min("hi").alias("any_hi")))
    out = best.crossJoin(sides).crossJoin(total)
    found = F.col("best").isNotNull()
    t_clear = F.when(found, F.col("best.lo") / float(steps)).when(F.col("any_lo").isNotNull() & F.col("any_hi").isNull(), F.least(F.col("any_lo") / float(steps), F.lit(0.79))).when(F.col("any_lo").isNotNull(), F.lit(0.49)).otherwise(0.2)
    t_retake = F.when(found, -F.col("best.minus") / float(steps)).when(F.col("any_hi").isNotNull() & F.col("any_lo").isNull(), F.greatest(F.col("any_hi") / float(steps), F.lit(0.21))).when(F.col("any_hi").isNotNull(), F.lit(0.5)).otherwise(0.8)
    return out.select(t_clear.alias("t_clear"), t_retake.alias("t_retake"), F.when(found, F.col("best.covered") / F.col("total")).alias("coverage"), F.when(found, "targets_met").otherwise("fallback").alias("status"))


def tail_thresholds(df: DataFrame, tails: dict[str, tuple[float, float]], floors: dict[str, float] | None = None) -> DataFrame:
    """(feature, warning, retake) from percentiles of good samples, tails: feature -> both points; a floor bounds a warning from below."""
    out = None
    for name, (warn, retake) in tails.items():
        row = percentiles(df, name, [warn, retake])
        w = F.greatest(F.col("q")[0], F.lit((floors or {}).get(name, float("-inf"))))
        row = row.select(F.lit(name).alias("feature"), w.alias("warning"), F.col("q")[1].alias("retake"))
        out = row if out is None else out.unionByName(row)
    return out


def capped_threshold(df: DataFrame, value: str, share: float = 0.02) -> DataFrame:
    """One row: the least threshold that floor(share n) of the values at most reach, and the 95th percentile as a warning."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = running(counted, [], "v", {"upto": "n"}, descending=True).withColumn("before", F.col("upto") - F.col("n"))
    total = with_percentiles(df.agg(F.count(value).alias("total")), df, value, {"warning": 0.95})
    allowed = F.floor(F.col("total") * share)
    return ranked.crossJoin(F.broadcast(total)).filter((F.col("before") <= allowed) & (F.col("upto") > allowed)).select(F.col("v").alias("largest_allowed"), "warning", "total", allowed.alias("allowed"))


def style_ranges(df: DataFrame, values: Sequence[str], domain: str, reference: str, low: float, high: float) -> DataFrame:
    """(domain, feature, ratio): means of each domain over the reference domain's, kept within [low, high]."""
    long = df.select(F.col(domain).alias("domain"), F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value")) for v in values])).alias("f")).select("domain", "f.*")
    mean = with_percentiles(long.groupBy("domain", "feature").agg(F.avg("value").alias("mean")), long, "value", {"p05": 0.05, "p95": 0.95}, ["domain", "feature"])
    base = mean.filter(F.col("domain") == reference).select("feature", F.col("mean").alias("base"))
    return mean.join(F.broadcast(base), "feature").select("domain", "feature", "p05", "p95", F.greatest(F.lit(low), F.least(F.lit(high), M.ratio(F.col("mean"), F.col("base"), None))).alias("ratio"))  # a row for each feature
