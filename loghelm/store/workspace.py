"""Folders for stores that queries build, where driver and executors both see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from loghelm.schema import RefusedError


def new_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; on one machine, where it is unset, one that goes with
    the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RefusedError("unsupported_store", "spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loghelm-store-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
    return f"{found.rstrip('/')}/loghelm-store-{uuid.uuid4().hex}"
