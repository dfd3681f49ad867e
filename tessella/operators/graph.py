"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder of spark.checkpoint.dir; in local mode, where all share one machine, one under /tmp if it is not set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or "file:///tmp/tessella-shared")
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges(a, b), the root being the least of its component.

    Only minima of neighbourhoods are kept, by aggregates that combine before the shuffle, so a node with very many
    neighbours is never gathered in one place.
    """
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    last, now = None, _state(e)
    while now != last:
        every = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = every.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("m", "hi"))
        e = every.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = e.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpointed(moved.unionByName(least.withColumnRenamed("m", "lo")).distinct())
        last, now = now, _state(e)
    roots = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
