"""The Spark session of tools and tests. On a cluster the submitter's settings hold; these are defaults only."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    b = SparkSession.builder.appName("varloom")
    if master or not os.environ.get("SPARK_HOME"):
        b = b.master(master or "local[*]")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.executorEnv.OMP_NUM_THREADS", "1").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
