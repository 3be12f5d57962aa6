"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the session's own; one of ours only where none is set and the driver runs the tasks itself."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plenaria-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
