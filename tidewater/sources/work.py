"""A folder of one's own that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidewater.sources.remote import scratch


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which a cluster sets; below a temporary folder where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{scratch()}"
    return f"{root.rstrip('/')}/tidewater-{label}-{uuid.uuid4().hex}"
