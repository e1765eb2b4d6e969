"""Where queries that build tables put them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="tidelog-")


def workspace(spark: SparkSession) -> str:
    """A new folder below the cluster's shared `spark.checkpoint.dir`. Where that is unset a temporary one, if the master is local; on a
    cluster that is an error. It goes with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = _own_root()
    path = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
