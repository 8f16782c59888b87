"""Intermediate tables that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a folder of this process, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="pactum-")
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and not recomputed if an executor is lost."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
