"""A session for local work; on a cluster the caller brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("lexforge").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
