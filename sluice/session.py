"""A Spark session with the settings that the library's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and a state store that supports timers and several state variables."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
