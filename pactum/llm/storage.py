"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of this process, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="pactum-")
    return _OWN["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, without lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    if df is None:
        return
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffled join follows).

    ``df`` should be cheap to count: a written table or a small aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in buckets of ``key``, and the table's name: two of them join without a shuffle."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(df: DataFrame, name: str) -> None:
    """Delete a table made by :func:`bucketed` that no later plan reads."""
    drop(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
