"""Session settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC so that epoch arithmetic is the same everywhere; AQE re-plans skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tickforge", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` (dots as double underscores) override them."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
