"""A local session for tests, benchmarks and the command line."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, memory: str = "12g", app: str = "corpuscope") -> SparkSession:
    """Local session.  On a cluster, bring the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", str(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
