"""Spark session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture doubles the cost of building wide plans from Python.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    master = master or os.environ.get("TIDEMARK_MASTER")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared checkpoint folder named by the cluster; `fallback` only where unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    chosen = shared or fallback
    if chosen:
        spark.sparkContext.setCheckpointDir(chosen)
    return chosen
