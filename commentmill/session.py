"""Session settings for tests and benches; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "commentmill", cpus: int | str = "*",
                  memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.appName(name).master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # of a key that a scorer repeats in one object, the last value counts
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
