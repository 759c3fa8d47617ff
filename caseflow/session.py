"""A Spark session with the settings the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "caseflow", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster bring your own session.

    Skew-join splitting is forced on because one scenario, serial number or key may hold a large
    share of all rows, and the split must also happen when it costs an extra exchange.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Lists here are short (bounded by a domain or a batch), so hash aggregation holds many of them.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "50000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CASEFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
