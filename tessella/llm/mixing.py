"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is the mean number of times that each of its documents is to occur: total size times target share, over
the source's size. Each document draws a number in (0, 1) from a keyed hash, inverts the Poisson distribution with its
source's rate, occurs that many times, and all copies are dealt out anew in the order of a second keyed hash.

Defined cases: a null source is a source; a null or empty text counts as one character, so that every source has a size;
a null doc_id draws as the empty string; rows with equal doc_id draw the same number; texts are counted and carried whole,
however long; extra columns stay as they are, and where one has the name of a result, the result's gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import _spark as S

#: Tables of distribution functions with more numbers than this (8 MB) are not broadcast but joined by salted keys.
BROADCAST_NUMBERS = 1_000_000
SALTS = 32


def _draw(label: str, seed: int, *parts: Column) -> Column:
    """52 bits of a keyed hash."""
    text = F.concat_ws(":", F.lit(f"{label}{seed}"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): shares go by `weights`, or by size to the power `temperature`; the sizes add up to `epochs` corpora."""
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sizes = S.cut(sizes.withColumn("share", share))
    total = sizes.agg(F.sum("size").alias("sizes"), F.sum("share").alias("shares")).first()  # one row
    every = F.lit(float(epochs)) * F.lit(float(total["sizes"] or 0))
    return sizes.select("source", "size", (every * F.col("share") / F.lit(float(total["shares"] or 1)) / F.col("size")).alias("rate"))


def _with_cdf(rates: DataFrame) -> DataFrame:
    """(source, cdf, steps): the Poisson distribution function at 0, 1, ... until it is 1 in double precision, from sums of
    logarithms, and the powers of two by which it is searched, the greatest first."""
    rate, k = F.col("rate"), F.col("k")
    top = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 30)).otherwise(0).cast("int")
    upto = W.partitionBy("source").orderBy("k")
    points = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    points = points.withColumn("log", F.when(k == 0, -rate).otherwise(F.log(rate) - F.log(k.cast("double")))).withColumn("log", F.sum("log").over(upto))
    points = points.withColumn("c", F.when(rate > 0, F.sum(F.exp("log")).over(upto)).otherwise(F.lit(1.0)))
    table = points.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size("cdf").cast("double"))).cast("int")), lambda j: F.pow(F.lit(2.0), j).cast("int"))
    return table.select("source", "cdf", F.reverse(powers).alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Every column of docs, and copy (from 1), n_copies, mix_key; partitions hold copies at random, in order of mix_key."""
    table = rates(docs, weights, temperature, epochs).transform(_with_cdf)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"))
    if (table.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        joined = row.join(F.broadcast(table), F.col("from").eqNullSafe(F.col("source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = row.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col("from").eqNullSafe(F.col("source")) & (F.col("own") == F.col("salt")))
    u = (_draw("n", seed, F.col("id")) + F.lit(0.5)) / F.lit(float(1 << 52))
    # of the numbers under u there are `at`, found by halves
    times = F.aggregate("steps", F.lit(0), lambda at, step: F.when(F.coalesce(F.get("cdf", at + step - 1) < u, F.lit(False)), at + step).otherwise(at)).cast("long")
    copies = (
        joined.select("row", "id", times.alias("n_copies"))
        .filter("n_copies > 0")
        .select("row", "id", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
        .withColumn("mix_key", _draw("k", seed, F.col("id"), F.col("copy")))
    )
    dealt = copies.repartition(S.partitions(docs), "mix_key").sortWithinPartitions("mix_key", "id")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(S.free(docs.columns, c)) for c in ("copy", "n_copies", "mix_key")])


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "copy", "n_copies", "mix_key", "text")


OP2_SQL = """
WITH sizes AS (
  SELECT source, sum(greatest(length(coalesce(text, '')), 1)) AS size FROM documents GROUP BY source
), shares AS (
  SELECT source, size, pow(size::DOUBLE, 0.5) AS share FROM sizes
), rates AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(size) FROM shares)::DOUBLE * share / (SELECT sum(share) FROM shares) / size AS rate FROM shares
), points AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, generate_series(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 30)::BIGINT FROM rates)) AS g(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM points
), drawn AS (
  SELECT *, (('0x' || substr(md5('n17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / pow(2::DOUBLE, 52) AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c < d.u) AS n_copies FROM drawn d
), copies AS (
  SELECT doc_id, source, text, n_copies, unnest(generate_series(1, n_copies)) AS copy FROM counted WHERE n_copies > 0
)
SELECT doc_id, source, copy, n_copies,
       ('0x' || substr(md5('k17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13))::BIGINT AS mix_key, text
FROM copies
"""
