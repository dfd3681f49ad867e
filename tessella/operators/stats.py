"""Audits of shift and confounding: effect sizes, distances of distributions, strata, matches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.order import following, percentiles, running, with_percentiles


def long_form(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value), one row for each feature."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.explode(items).alias("f")).select(*keys, "f.feature", "f.value")


def _moments(long: DataFrame, label: str) -> DataFrame:
    side = lambda y, f: f(F.when(F.col(label) == y, F.col("value")))
    return long.groupBy("feature").agg(*[side(y, f).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])


def cohens_d(long: DataFrame, label: str = "label") -> DataFrame:
    """Difference of means over the deviation pooled by degrees of freedom: null below two cases a side, 0 for no deviation."""
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return _moments(long, label).withColumn("sd", pooled).select("feature", "n0", "n1", _effect().alias("d"))


def cohens_d_mean_variance(long: DataFrame, label: str = "label") -> DataFrame:
    """The other formula: over the root of the mean of both variances."""
    return _moments(long, label).withColumn("sd", F.sqrt((F.col("v1") + F.col("v0")) / 2)).select("feature", "n0", "n1", _effect().alias("d"))


def _effect() -> Column:
    return F.when((F.col("n0") < 2) | (F.col("n1") < 2), None).when(F.col("sd") < 1e-12, 0.0).otherwise((F.col("m1") - F.col("m0")) / F.col("sd"))


def robust_difference(long: DataFrame, label: str = "label") -> DataFrame:
    """Difference of medians over 1.4826 times the median absolute deviation of all values."""
    sides = long.select("feature", "value", F.when(F.col(label) == 0, F.col("value")).alias("v0"), F.when(F.col(label) == 1, F.col("value")).alias("v1"))
    m = sides.select("feature").distinct()
    for name, v in (("m0", "v0"), ("m1", "v1"), ("m", "value")):
        m = with_percentiles(m, sides, v, {name: 0.5}, ["feature"])
    away = long.join(F.broadcast(m), "feature").select("feature", F.abs(F.col("value") - F.col("m")).alias("away"))  # a row for each feature
    s = 1.4826 * F.col("mad")
    return with_percentiles(m, away, "away", {"mad": 0.5}, ["feature"]).select("feature", (F.col("m1") - F.col("m0")).alias("difference"), F.when(s < 1e-12, 0.0).otherwise((F.col("m1") - F.col("m0")) / s).alias("robust_d"))


def distances(long: DataFrame, label: str = "label") -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein distances of the two sides, over cumulative counts of distinct values."""
    n = long.filter("value is not null").groupBy("feature", "value").agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b"))
    total = n.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    cumulated = running(n, ["feature"], "value", {"ca": "a", "cb": "b"}).join(F.broadcast(total), "feature")  # a row for each feature
    q = following(cumulated, ["feature"], "value", "next")
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    return q.filter("na > 0 and nb > 0").groupBy("feature").agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("value"))).alias("wasserstein"))


def quantile_strata(df: DataFrame, value: str, label: str, bins: int = 5) -> DataFrame:
    """Rate of the label in quantile bins (closed to the right, the first at both ends; equal edges are one)."""
    edges = percentiles(df, value, [i / bins for i in range(bins + 1)]).select(F.array_sort(F.array_distinct("q")).alias("e"))
    b = F.size(F.filter("e", lambda x: x < F.col(value)))
    binned = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(b, F.lit(1)) - 1)  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(label).alias("rate"), F.min(value).alias("low"), F.max(value).alias("high"))


def strata_verdict(strata: DataFrame) -> DataFrame:
    """One row: span of the rates, whether they only rise or only fall, and whether that confounds (span 0.25, or 0.15 and monotone)."""
    step = F.col("rate") - F.lag("rate").over(W.partitionBy(F.lit(0)).orderBy("bin"))  # a row for each bin
    v = strata.withColumn("step", step).agg((F.max("rate") - F.min("rate")).alias("span"), F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("down"))
    monotone = F.col("up") | F.col("down")
    return v.select("span", monotone.alias("monotone"), ((F.col("span") >= 0.25) | (monotone & (F.col("span") >= 0.15))).alias("confounded"))


def metadata_rates(df: DataFrame, keys: Sequence[str], label: str, least: int = 20, top: int = 30) -> DataFrame:
    """A report: the largest groups of each key with their rate, and whether a group of enough cases is nearly one-sided."""
    items = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("null")).alias("group")) for k in keys])
    n = df.select(F.explode(items).alias("k"), F.col(label).alias("y")).groupBy("k.key", "k.group").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "group"))).filter(F.col("rank") <= top)
    return ranked.withColumn("extreme", (F.col("n") >= least) & ((F.col("rate") >= 0.95) | (F.col("rate") <= 0.05))).drop("rank")


def near_duplicates(df: DataFrame, digest: str, label: str) -> DataFrame:
    """One row: groups of one perceptual digest, those of one label and those across labels."""
    g = df.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels")).filter("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), F.count_if(F.col("labels") > 1).alias("cross_label"), F.count_if(F.col("labels") <= 1).alias("same_label")).withColumn("concern", F.col("cross_label") > 0)


def common_support(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the range of scores that both sides have, and the share of each side in it."""
    side = lambda y, f: f(F.when(F.col(label) == y, F.col(score)))
    r = df.agg(F.greatest(side(0, F.min), side(1, F.min)).alias("low"), F.least(side(0, F.max), side(1, F.max)).alias("high"))
    inside = F.col(score).between(F.col("low"), F.col("high"))
    rate = lambda y: F.avg(F.when(F.col(label) == y, inside.cast("double")))
    return df.crossJoin(F.broadcast(r)).agg(F.first("low").alias("low"), F.first("high").alias("high"), rate(0).alias("rate0"), rate(1).alias("rate1"), F.avg(inside.cast("double")).alias("rate"))  # one row


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values become the median; then mean 0 and population deviation 1 (a deviation under 1e-8 counts as 1)."""
    f = lambda c: F.col(c).cast("double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f(c).alias("value")) for c in features])).alias("f")).select("f.*")
    per = percentiles(long, "value", [0.5], ["feature"])
    med = per.agg(*[F.max(F.when(F.col("feature") == c, F.get("q", F.lit(0)))).alias(f"med_{c}") for c in features])
    filled = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(f(c), F.col(f"med_{c}")) for c in features}).drop(*med.columns)  # one row
    s = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    scaled = filled.crossJoin(F.broadcast(s))
    return scaled.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")) for c in features}).drop(*s.columns)


def caliper_candidates(df: DataFrame, features: Sequence[str], label: str, caliper: float, key: str = "sample_id") -> DataFrame:
    """(positive, negative, distance) of all pairs within the caliper, found by cells of that width on the first two features."""
    z = standardised(df, features)
    keys = list(features[:2])
    cell = lambda c: F.floor(F.col(c) / caliper).cast("long")
    z = z.withColumn("cell", F.array(*[cell(c) for c in keys]))
    around = F.array(*[F.array(*[F.lit(d).cast("long") for d in ([a] if len(keys) == 1 else [a, b])]) for a in (-1, 0, 1) for b in ((0,) if len(keys) == 1 else (-1, 0, 1))])
    pos = z.filter(F.col(label) == 1).select(F.col(key).alias("positive"), *[F.col(c).alias(f"p_{c}") for c in features], "cell", F.explode(around).alias("off"))
    pos = pos.withColumn("cell", F.zip_with("cell", "off", lambda a, b: a + b)).drop("off")
    neg = z.filter(F.col(label) == 0).select(F.col(key).alias("negative"), *[F.col(c).alias(f"n_{c}") for c in features], "cell")
    d = F.sqrt(sum((F.col(f"p_{c}") - F.col(f"n_{c}")) * (F.col(f"p_{c}") - F.col(f"n_{c}")) for c in features))
    return pos.join(neg, "cell").withColumn("distance", d).filter(F.col("distance") <= caliper).select("positive", "negative", "distance")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        used, out = set(), []
        for p, own in pairs.sort_values(["positive", "distance", "negative"], kind="stable").groupby("positive", sort=True):
            for n, d in zip(own.negative, own.distance, strict=True):
                if n not in used:
                    used.add(n)
                    out.append((p, n, d))
                    break
        yield pd.DataFrame(out, columns=["positive", "negative", "distance"])


def matched(candidates: DataFrame) -> DataFrame:
    """Each positive in order of its key gets its nearest negative not yet taken. Positives that share no negative, even
    through others, are matched apart: components of the candidate graph go to tasks of their own."""
    from tessella.operators.graph import connected

    edges = candidates.select(F.concat(F.lit("p"), "positive").alias("a"), F.concat(F.lit("n"), "negative").alias("b"))
    named = candidates.withColumn("node", F.concat(F.lit("p"), "positive")).join(connected(edges), "node")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    return named.select("root", *candidates.columns).groupBy("root").applyInPandas(lambda pairs: next(_greedy(iter([pairs]))), schema)


def caliper_matches(df: DataFrame, features: Sequence[str], label: str, caliper: float, key: str = "sample_id") -> DataFrame:
    """matched(caliper_candidates(...)) without the table of pairs, which grows with the square of the rows of a dense place.

    Cells of the caliper's width are linked where they can hold a pair, and all cells of a key; each component of cells is
    matched in one task, which holds the points of its negatives and reads its positives as a stream, in order of keys.
    """
    from tessella.operators.graph import checkpointed, connected
    from tessella.operators.matching import Greedy

    z = standardised(checkpointed(df.select(key, label, *features)), features)
    z = z.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select((F.col(label) == 1).cast("int").alias("side"), F.col(key).alias("key"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(features)])
    names = z.columns[2:]
    for c in names:
        z = z.filter(~F.isnan(c) & (F.abs(c) < float("inf")))
    width = caliper * (1 + 1e-6) or 1.0  # wider than the caliper by more than a quotient is rounded
    spans = names[:3]
    z = z.withColumn("cell", F.array(*[F.floor(F.col(c) / width).cast("long") for c in spans]))
    node = lambda side, cell: F.concat(F.when(F.col(side) == 1, "p").otherwise("n"), F.array_join(F.col(cell).cast("array<string>"), ","))
    z = checkpointed(z.withColumn("node", node("side", "cell")))
    cells = z.select("side", "cell", "node").distinct()
    around = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in product((-1, 0, 1), repeat=len(spans))])
    pos = cells.filter("side = 1").select(F.col("node").alias("a"), "cell", F.explode(around).alias("off")).select("a", F.zip_with("cell", "off", lambda x, y: x + y).alias("cell"))
    edges = pos.join(cells.filter("side = 0").select(F.col("node").alias("b"), "cell"), "cell").select("a", "b")
    several = z.groupBy("side", "key").agg(F.min("node").alias("b"), F.max("node").alias("other")).filter("b <> other").drop("other")
    edges = edges.unionByName(z.join(several, ["side", "key"]).select(F.col("node").alias("a"), "b"))
    rows = z.join(connected(edges), "node").select("root", "side", "key", *names).repartition("root").sortWithinPartitions("root", "side", "key")
    kind = z.schema["key"].dataType.simpleString()
    return rows.mapInArrow(Greedy(caliper).match, f"positive {kind}, negative {kind}, distance double")


def ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks, by counts of distinct values."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    r = running(n, [], value, {"upto": "c"}).select(value, (F.col("upto") - (F.col("c") - 1) / 2).alias(name))
    return df.join(r, value)


def spearman(df: DataFrame, a: str, b: str, least: int = 20) -> DataFrame:
    """One row: rank correlation, null under `least` pairs."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = ranks(ranks(pairs, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.when(F.col("n") >= least, F.col("r")).alias("rho"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation with missing values as medians."""
    med = percentiles(df, a, [0.5]).select(F.get("q", F.lit(0)).alias("ma")).crossJoin(percentiles(df, b, [0.5]).select(F.get("q", F.lit(0)).alias("mb")))  # one row each
    f = df.crossJoin(F.broadcast(med))  # one row
    return f.agg(F.corr(F.coalesce(F.col(a).cast("double"), "ma"), F.coalesce(F.col(b).cast("double"), "mb")).alias("r"))


def centroid_distances(vectors: DataFrame, domain: str, vector: str) -> DataFrame:
    """(a, b, distance) between the centroids of domains."""
    mean = vectors.select(F.col(domain).alias("d"), F.posexplode(vector).alias("i", "x")).groupBy("d", "i").agg(F.avg("x").alias("m"))
    a, b = mean.select(F.col("d").alias("a"), "i", F.col("m").alias("ma")), mean.select(F.col("d").alias("b"), "i", F.col("m").alias("mb"))
    return a.join(b, "i").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))).alias("distance"))


def confounding_level(auroc: Column, support: Column, match_rate: Column) -> Column:
    """NONE to SEVERE from how well the acquisition tells the classes apart."""
    return F.when(auroc.isNull(), "UNKNOWN").when((auroc >= 0.9) & ((support < 0.8) | (match_rate < 0.2)), "SEVERE").when(auroc >= 0.9, "HIGH").when(auroc >= 0.8, "MODERATE").when(auroc >= 0.65, "LOW").otherwise("NONE")


def probability_shift(scores: DataFrame, cohort: str, score: str = "score") -> DataFrame:
    """By cohort: median, mean, tails, and the share over 0.5."""
    out = scores.groupBy(cohort).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.avg((F.col(score) >= 0.5).cast("double")).alias("high_rate"))
    return with_percentiles(out, scores, score, {"p05": 0.05, "median": 0.5, "p95": 0.95}, [cohort]).select(cohort, "n", "mean", "p05", "median", "p95", "high_rate")


def mode_ablation(long: DataFrame, base: str) -> DataFrame:
    """(cohort, mode, median, delta) against the base mode; and which mode moves a cohort most."""
    m = percentiles(long, "score", [0.5], ["cohort", "mode"]).select("cohort", "mode", F.get("q", F.lit(0)).alias("median"))
    b = m.filter(F.col("mode") == base).select("cohort", F.col("median").alias("of_base"))
    d = m.join(b, "cohort").withColumn("delta", F.col("median") - F.col("of_base"))
    w = W.partitionBy("cohort")
    top = F.max_by("mode", F.struct(F.abs("delta").alias("x"), F.col("mode").alias("y"))).over(w)
    return d.select("cohort", "mode", "median", "delta", top.alias("most_sensitive"))
