"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics first (time zone, last-wins maps), then plan quality.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply CONF to a running session; cluster sizing is left to the deployment."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, app: str = "quillon", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
