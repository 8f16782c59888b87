"""Previous events across range partitions, and the order of a table's rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pactum.functions import ranks
from pactum.operators import enrich


def _events(spark, n=3000, hot=0.4):
    rng = random.Random(6)
    rows = [(k, "hot" if rng.random() < hot else rng.choice(["a", "b", None, f"u{rng.randrange(300)}"]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(200_000))) for k in range(n)]
    rows[5] = (5, "hot", None)
    return rows, spark.createDataFrame(rows, "id long, who string, at timestamp_ntz").repartition(7)


def _previous(rows):
    out, last = {}, {}
    for k, who, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0])):
        out[k] = last.get(who)
        last[who] = at
    return out


def test_previous_rows_cross_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows, df = _events(spark)
        parts = df.repartitionByRange("who", "at", "id").withColumn("p", F.spark_partition_id()).where("who = 'hot'").select("p").distinct().count()
        assert parts > 4  # one entity, many tasks
        got = {r["id"]: r["before"] for r in ranks.with_previous(df, "who", ["at", "id"], "at", "before").collect()}
        assert got == _previous(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ranks.with_previous(df.limit(0), "who", ["at", "id"], "at", "before").collect() == []


def test_velocity_and_bursts_of_a_hot_entity(spark):
    rows, df = _events(spark, 1200)
    before = _previous(rows)
    gaps = {r["id"]: r["seconds_since_last"] for r in enrich.with_velocity(df, "who", "at", "id").collect()}
    want = {k: 86400.0 if before[k] is None or at is None else max(0.0, (at - before[k]).total_seconds()) for k, _, at in rows}
    assert gaps == want
    moved = enrich.with_bursts(df, "who", "at", "id", share=0.1, label=None).where("is_burst").collect()
    assert len(moved) == 120
    assert all(4 <= (r["at"] - before[r["id"]]).total_seconds() <= 25 for r in moved)


def test_order_is_observed(spark):
    _, df = _events(spark, 500)
    assert enrich.out_of_order(enrich.chronological(df, "at", "id"), "at", "id") == 0
    assert enrich.out_of_order(df, "at", "id") > 100
    swapped = spark.range(0, 100, 1, 4).select((99 - F.col("id")).alias("k"))
    assert enrich.out_of_order(swapped, "k") == 99
    assert enrich.out_of_order(df.limit(0), "at") == 0
