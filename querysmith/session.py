"""Sessions with the settings that all plans here assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Results compare with other engines in UTC; stored queries run beside each other, so stages share slots.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "querysmith", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword settings (dots as double underscores) come on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession | None = None) -> None:
    """Let Python workers find this package where it lies at the same place as on the driver."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
