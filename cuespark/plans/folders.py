"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one that the session names; only in a local session that names none, in a temporary one."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cues-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
