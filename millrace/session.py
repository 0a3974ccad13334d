"""Session defaults for tests, benches and notebooks; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the operators rely on or profit from. None of them depends on the size of the data.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use ``_`` for ``.`` only through ``conf`` given as a mapping."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Timestamps are UTC throughout; months and days must not shift with the submitter's zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
