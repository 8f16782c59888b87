"""Numbers above 2^53 and decimals keep their own type."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from pactum.operators import privacy, stats

TOP = 2**53


def _copies(spark, own, ref, kind_own="long", kind_ref="long"):
    a = spark.createDataFrame([(x,) for x in own], f"v {kind_own}")
    b = spark.createDataFrame([(x,) for x in ref], f"v {kind_ref}")
    return privacy.exact_copies(a, b).first()["copies"]


def test_copies_are_equal_numbers(spark):
    assert _copies(spark, [TOP + 1, TOP + 2, 5], [TOP, 5]) == 1
    assert _copies(spark, [TOP + 1], [TOP + 1]) == 1
    # Whole doubles against longs, both ways, and numbers beyond any long.
    assert _copies(spark, [float(TOP), 2.5, 3.0, 1e300], [TOP + 1, 3, 2], "double", "long") == 1
    assert _copies(spark, [TOP + 1, 3], [float(TOP), 3.0, 0.5], "long", "double") == 1
    assert _copies(spark, [0, 7], [0.0, float("nan")], "long", "double") == 1
    big = Decimal("12345678901234567890.12")
    assert _copies(spark, [big, Decimal("3.00")], [big + Decimal("0.01"), Decimal("3.00")], "decimal(30,2)", "decimal(30,2)") == 1
    assert _copies(spark, [3, TOP + 1], [Decimal("3.0"), Decimal(TOP)], "long", "decimal(30,1)") == 1
    assert _copies(spark, [None, 4], [None, 4]) == 1
    assert _copies(spark, [], [1]) == 0


def test_a_false_copy_no_longer_makes_a_table_risky(spark):
    ref = spark.range(400).select((F.col("id") * 2 + TOP).alias("a"), (F.col("id") % 7).alias("b"))
    own = spark.range(400).select((F.col("id") * 2 + 1 + TOP).alias("a"), (F.col("id") % 7).alias("b"))
    assert privacy.exact_copies(own, ref).first()["copies"] == 0


def test_distinct_values_of_longs_and_decimals(spark):
    df = spark.createDataFrame([(TOP + k, Decimal(10**20 + k), float(k // 2)) for k in range(4)], "a long, b decimal(30,0), c double")
    got = {r["column"]: r["distinct"] for r in stats.column_stats(df).collect()}
    assert got == {"a": 4, "b": 4, "c": 2}
