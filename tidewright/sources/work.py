"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Local sessions without one use the temp folder, emptied when the process ends; on a cluster,
    whose executors could not see that, it is an error. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidewright-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"
