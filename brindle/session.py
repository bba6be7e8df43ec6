"""Spark session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: What the engine relies on; cluster sizes are the caller's.
CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* below *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
