"""Training sets: splits, leakage and class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions.quantiles import exact_quantiles
from pactum.functions.ranks import drawn


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` is test for about ``test_share`` of the rows, by a hash of their key."""
    return df.withColumn("split", F.when(drawn(seed, "split", key) < test_share, "test").otherwise("train"))


def temporal_split(df: DataFrame, time_column: str, test_share: float = 0.2) -> DataFrame:
    """The latest ``test_share`` of the rows, by an exact percentile of time, are test; a null time is train."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time_column).cast("timestamp_ntz"))
    cut = exact_quantiles(df, {"t": micros}, [1 - test_share]).get("t", [None])[0]
    late = F.coalesce(micros > F.lit(cut), F.lit(False))
    return df.withColumn("split", F.when(late, "test").otherwise("train"))


def group_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of a group are on one side."""
    return random_split(df, group, test_share, seed)


def without_leakage(df: DataFrame, leaking: list[str], target: str) -> DataFrame:
    """The table without the named columns; the target may not be among them, and all must exist."""
    if target in leaking:
        raise ValueError("the target cannot be excluded")
    missing = [c for c in leaking if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.drop(*leaking)


def class_balance(df: DataFrame, target: str, planned: float, tolerance: float = 0.02) -> DataFrame:
    """(target, planned, measured, passed)."""
    measured = F.avg(F.col(target).cast("double"))
    one = df.agg(measured.alias("measured"))
    ok = F.coalesce(F.abs(F.col("measured") - planned) <= tolerance, F.lit(False))
    return one.select(F.lit(target).alias("target"), F.lit(float(planned)).alias("planned"), "measured", ok.alias("passed"))
