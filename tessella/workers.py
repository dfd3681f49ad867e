"""What Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Where the session has Spark's own value for the bytes of a batch of rows, it is lowered to this, so that long texts come
#: to workers a few at a time and neither side holds much of them.
BYTES, GIVEN, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "67108864b", "67108864"), "8m"


def ready(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver was started from another folder; on a cluster the package is
    installed, or added with --py-files, and this does nothing that matters."""
    if spark.conf.get(BYTES, GIVEN[0]).lower() in GIVEN:
        spark.conf.set(BYTES, BATCH)
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
