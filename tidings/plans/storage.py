"""Intermediate tables that outlive the executors that wrote them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a
    laptop) does a temporary folder stand in, and only for a local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="tidings-")
    return _LOCAL_ROOT[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the work root that nobody has written to yet."""
    return f"{work_root(spark)}/tidings/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where two branches must see the very same rows (a sort position, say), and to cut
    long lineage: a lost executor then costs a file read, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
