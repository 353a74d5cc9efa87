"""One place for the session settings the engine is written against."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "lexhaul") -> SparkSession:
    """A session with AQE on, UTC time and, only if none is configured, a checkpoint folder left to the caller.

    On a cluster pass nothing: master, memory and shuffle width come from spark-submit.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEXHAUL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Folders of local sessions that name none, by application.
LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL.setdefault(spark.conf.get("spark.app.id"), f"file://{tempfile.mkdtemp(prefix='lexhaul-')}")
