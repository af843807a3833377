"""What queries need of their surroundings: a folder that driver and executors share, and this package in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh name below spark.checkpoint.dir. Only where all runs on one machine may the setting be missing."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, _own.get(app) or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster ships it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (paths, root) if x)
