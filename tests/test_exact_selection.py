"""Exact shares, digests that merge, and the gate's exit code."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.contract import Column, Contract, Dataset, Relationship
from pactum.functions import ranks
from pactum.operators import forest
from pactum.plans import gate
from pactum.sources import tables as io


def test_nth_smallest_of_longs(spark):
    values = [-(2**62), -5, -5, 0, 3, 3, 3, 2**40, 2**62]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for n in range(1, 10):
        v = sorted(values)[n - 1]
        assert ranks.nth_smallest(df, "v", n) == (v, sum(x < v for x in values), values.count(v))
    assert ranks.nth_smallest(df, "v", 10) is None


def _plain_depths(trees, row):
    total = 0
    for feature, cut, left, right, depth in trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < cut[at] else right[at]
        total += int(depth[at])
    return total


def test_exactly_the_share_of_most_isolated_rows_goes(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    df = spark.createDataFrame([*rows, (2000, None, 1.0)], "k long, a double, b double")
    sample = np.array(sorted((a, b) for _, a, b in rows))
    trees = forest.fit(sample)
    deep = {k: _plain_depths(trees, (a, b)) for k, a, b in rows}
    want = set(sorted(deep, key=deep.get)[:37])
    kept = {r["k"] for r in forest.without_isolated(df, ["a", "b"], 0.037).collect()}
    assert kept == {2000, *deep} - want
    marked = forest.without_isolated(df, ["a", "b"], 0.037, keep=F.col("k") % 2 == 0)
    assert {r["k"] for r in marked.collect()} == kept | {k for k in want if k % 2 == 0}


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5])
def test_ties_do_not_change_the_share(spark, share):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    assert forest.without_isolated(df, ["a", "b"], share).count() == 1000 - round(1000 * share)
    alike = df.select("a", "b")
    assert 1000 - round(1000 * share) <= forest.without_isolated(alike, ["a", "b"], share).count() <= 1000


def test_digests_of_parts_add_up(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id") % 9)).alias("s"), (F.col("id") / 7).alias("x"))
    one, two = df.where("id < 123"), df.where("id >= 123")
    assert io.merged(io.fingerprint(one), io.fingerprint(two)) == io.fingerprint(df)
    assert io.merged(io.fingerprint(df), io.fingerprint(df.limit(0))) == io.fingerprint(df)
    assert io.fingerprint(df.unionByName(df))["digest"] != io.fingerprint(df)["digest"]
    swapped = spark.createDataFrame([("1:a", "b")], "p string, q string"), spark.createDataFrame([("1:", "ab")], "p string, q string")
    assert io.fingerprint(swapped[0]) != io.fingerprint(swapped[1])
    with pytest.raises(ValueError, match="columns"):
        io.merged(io.fingerprint(df), io.fingerprint(df.drop("x")))


def test_gate_exits_with_three_on_failed_keys(spark, tmp_path, capsys):
    shop = Dataset(
        {"parents": Contract((Column("pk", "int"),), primary_key="pk"), "children": Contract((Column("ck", "int"), Column("pk", "int")), primary_key="ck")},
        "parents",
        (Relationship("parents", "pk", "children", "pk", 1.0),),
    )
    spark.range(5).select(F.col("id").alias("pk")).write.parquet(f"{tmp_path}/parents.parquet")
    for name, ids in (("good", 5), ("bad", 9)):
        (tmp_path / name).mkdir()
        spark.read.parquet(f"{tmp_path}/parents.parquet").write.parquet(f"{tmp_path}/{name}/parents.parquet")
        spark.range(ids).select(F.col("id").alias("ck"), F.col("id").alias("pk")).write.parquet(f"{tmp_path}/{name}/children.parquet")
    assert gate.run(spark, shop, f"{tmp_path}/good") == 0
    assert gate.run(spark, shop, f"{tmp_path}/bad") == 3
    assert "FAIL foreign key" in capsys.readouterr().out
    spec = {"tables": {"parents": {"columns": [{"name": "pk", "type": "int"}], "primary_key": "pk"}}, "root": "parents"}
    assert list(gate.dataset_from_dict(spec).tables) == ["parents"]
    assert gate.main([]) == 2
