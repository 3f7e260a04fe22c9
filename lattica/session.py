"""The session that tests, the bench and notebooks share. On a cluster, submit with the cluster's own settings instead."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "lattica", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """UTC, AQE and Arrow on; a master or a count of shuffle partitions only where given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", driver_memory)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). A session without one gets a local folder where they are one process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
