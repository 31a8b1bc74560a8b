"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name below spark.checkpoint.dir. Where that is unset, a folder of this machine, if all of Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = _OWN.setdefault("dir", "") or _OWN.update(dir="file://" + tempfile.mkdtemp(prefix="lorekeep-")) or _OWN["dir"]
    return f"{found.rstrip('/')}/lorekeep/{what}-{uuid.uuid4().hex[:12]}"
