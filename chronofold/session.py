"""A session for local use; on a cluster, the cluster's own settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: str = "8", partitions: int = 8, memory: str = "8g", app: str = "chronofold") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.host": "127.0.0.1",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
