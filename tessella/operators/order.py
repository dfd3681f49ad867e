"""Running sums, neighbours and exact percentiles over a whole table without a single task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 256


def _celled(df: DataFrame, value: str) -> DataFrame:
    """df with _cell: the range of values that the row lies in, by approximate quantiles of all rows."""
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 4096).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("_cell", F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: e < F.col(value)))).drop("_edges")  # one row


def _joined(held: DataFrame, per: DataFrame, by: Sequence[str]) -> DataFrame:
    """held with what `per` says of its groups and cells, whose key columns there begin with _k_."""
    on = F.col("_cell") == F.col("_k__cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return held.join(per, on).drop("_k__cell", *[f"_k_{c}" for c in by])


def running(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """df with, for each name -> column of `sums`, the sum of that column over the group's rows up to this one's value.

    Rows are dealt to ranges of values, summed in each, and the sums of the ranges before are added: windows see one
    range, or one row for each range. Values of a group must not be null, and distinct unless `ties` orders equal ones.
    """
    held = _celled(df, value)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    per = held.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = W.partitionBy(*by).orderBy(order("_cell")).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_cell")], *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = W.partitionBy(*by, "_cell").orderBy(order(value), *ties).rowsBetween(W.unboundedPreceding, 0)
    out = _joined(held, per, by).withColumns({n: F.sum(c).over(w) + F.col(f"_b_{n}") for n, c in sums.items()})
    return out.drop("_cell", *[f"_b_{n}" for n in sums])


def following(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the group's next greater value, null at its greatest. Values of a group must be distinct, and not null."""
    held = _celled(df, value)
    per = held.groupBy(*by, "_cell").agg(F.min(value).alias("_least"))
    per = per.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_cell")], F.lead("_least").over(W.partitionBy(*by).orderBy("_cell")).alias("_after"))
    inner = F.lead(value).over(W.partitionBy(*by, "_cell").orderBy(value))
    return _joined(held, per, by).withColumn(name, F.coalesce(inner, F.col("_after"))).drop("_cell", "_after")


def percentiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): the exact percentiles at `points` (0 to 1), interpolated between neighbours; null where a group has no value.

    Values are counted, and the two neighbours of each point are found by running counts, so no list of values is gathered.
    """
    v = F.col(value).cast("double")
    groups = df.groupBy(*by).agg(F.count(v).alias("_n"))
    counts = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    total = groups.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_n")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    ranked = running(counts, by, "_v", {"_upto": "_c"}).join(F.broadcast(total) if not by else total, on)  # without groups: one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))

    cells = []
    for i, p in enumerate(points):
        place = (F.col("_n") - 1) * F.lit(float(p))
        cells += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *cells)

    def between(i: int, p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        return F.col(f"_lo{i}") + (place - F.floor(place)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))

    found = found.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.array(*[between(i, p) for i, p in enumerate(points)]).alias("q"))
    if not by:
        return groups.crossJoin(F.broadcast(found)).select("q")  # one row each
    return groups.join(found, on, "left").select(*by, F.coalesce("q", F.array(*[F.lit(None).cast("double")] * len(points))).alias("q"))


def with_percentiles(summary: DataFrame, df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """summary, which has a row for each group of df, with a column for each name -> point."""
    q = percentiles(df, value, list(points.values()), by)
    named = q.select(*[F.col(c).alias(f"_p_{c}") for c in by], *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(points)])
    if not by:
        return summary.crossJoin(F.broadcast(named))  # one row
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return summary.join(named, on).drop(*[f"_p_{c}" for c in by])
