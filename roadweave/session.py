"""Session builder with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "roadweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE, skew-join handling and Arrow switched on.

    ``master`` is left to spark-submit when None.  Further settings come as keyword
    arguments with dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return builder.config(map=settings).getOrCreate()
