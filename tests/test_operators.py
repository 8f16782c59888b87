import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pactum.contract import Column, Contract, Correlation, Dataset, Monotone, Relationship
from pactum.functions import ranks
from pactum.operators import clean, enrich, forest, generate, prepare, privacy, relational, stats
from pactum.sources import tables as io


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_average_ranks_are_those_of_pandas(spark, parts):
    values = [random.Random(1).randrange(20) / 2 for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(parts)
    got = {r["i"]: r["r"] for r in ranks.with_rank(df, "v", "r").collect()}
    want = pd.Series(values).rank()
    assert all(got[i] == want[i] for i in range(len(values)))


def test_exactly_n_rows_are_chosen_for_any_partitioning(spark):
    df = spark.range(5000)
    one = {r["id"] for r in df.where(ranks.exactly(df, 137, 1, "t", "id")).collect()}
    again = df.repartition(7)
    two = {r["id"] for r in again.where(ranks.exactly(again, 137, 1, "t", "id")).collect()}
    assert len(one) == 137
    assert one == two


NOISY = Contract((Column("age", "int", 13, 65, "normal"), Column("seen", "float", 0, 60, "uniform"), Column("length", "int", 5, 60, "uniform")), rules=("seen <= length",))


def test_validation_stages(spark):
    rows = [(30, 10.0, 20)] * 3 + [(30 + i % 20, float(i % 50), 55) for i in range(100)] + [(99, 1.0, 30), (30, 50.0, 6), (None, 1.0, 30)]
    run = clean.validate(spark.createDataFrame(rows, "age int, seen double, length int"), NOISY)
    removed = {r["stage"]: r["removed"] for r in run.stages.collect()}
    assert removed["bounds"] == 2
    assert removed["rules"] == 1
    assert removed["duplicates"] == 2
    assert run.rows.where("seen > length").count() == 0


def test_a_rule_that_all_rows_violate_is_skipped(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    got = {r["rule"]: (r["status"], r["suspicious"]) for r in clean.rules_report(df, ("x > 5", "x > 1")).collect()}
    assert got == {"x > 5": ("skipped", True), "x > 1": ("applied", True)}
    assert [r["x"] for r in clean.obeying_rules(df, ("x > 5", "x > 1")).collect()] == [2]


def test_labelled_extremes_survive(spark):
    rows = [(100.0 + i % 7, 0) for i in range(300)] + [(9000.0, 1), (9000.0, 0)]
    df = spark.createDataFrame(rows, "v double, is_fraud int")
    out = clean.without_zscore_outliers(df, ["v"], 3.0, clean.preserved(df))
    assert [r["is_fraud"] for r in out.where("v > 1000").collect()] == [1]


def test_isolated_rows_go(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, x)) for x in rng.normal(size=(400, 2))] + [(12.0, -12.0)]
    out = forest.without_isolated(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 0.02)
    assert out.where("a > 10").count() == 0
    assert 385 <= out.count() <= 400


def test_kendall_is_tau_b(spark):
    from pactum.functions import inversions

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 700), rng.integers(0, 90, 700)
    x[:250] = 5  # a third of all rows share one value
    y = np.where(rng.random(700) < 0.5, y, 7 * x)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1), (2.0, None)], "x double, y long")
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / math.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))
    assert stats.pair_correlation(df, "x", "y", "kendall") == pytest.approx(want, abs=1e-12)
    whole = df.dropna()
    for block in (1, 7, 100):  # many blocks, and blocks of blocks
        assert inversions.kendall(whole, block) == pytest.approx(want, abs=1e-12)
    assert abs(stats.pair_correlation(df, "x", "y", "kendall", max_rows=400) - want) < 0.1
    assert stats.pair_correlation(df.where("x = 5"), "x", "y", "kendall") is None
    assert stats.pair_correlation(df.limit(0), "x", "y", "kendall") is None
    assert inversions.weighted_inversions(np.array([3, 1, 2]), np.array([2**40, 2**41, 5])) == 2**81 + 5 * 2**40


def test_monotone_relations(spark):
    df = spark.createDataFrame([(float(i), 2.5 * i + 50, float((i * 37) % 101)) for i in range(300)], "x double, up double, noise double")
    got = [r["passed"] for r in stats.monotonicity_check(df, (Monotone("x", "up"), Monotone("x", "noise"), Monotone("x", "up", "decreasing"))).collect()]
    assert got == [True, False, False]


def test_spearman_passes_where_pearson_fails(spark):
    df = spark.createDataFrame([(i / 10, math.exp(i / 10)) for i in range(10, 100)], "x double, y double")
    contract = Contract((Column("x", "float"), Column("y", "float")), correlations=(Correlation("x", "y", "+", 0.98, "spearman"), Correlation("x", "y", "+", 0.98)))
    assert [r["passed"] for r in stats.correlation_check(df, contract).collect()] == [True, False]


SHOP = Dataset(
    {"c": Contract((Column("id", "int"),), primary_key="id"), "o": Contract((Column("id", "int"), Column("c", "int")), primary_key="id"), "i": Contract((Column("id", "int"), Column("o", "int")), primary_key="id")},
    "c",
    (Relationship("c", "id", "o", "c", 2.0), Relationship("o", "id", "i", "o", 2.0)),
)


def test_repair_cascades(spark):
    tables = {
        "c": spark.range(50).withColumnRenamed("id", "id"),
        "o": spark.range(400).select("id", (F.col("id") / 2).cast("long").alias("c")),
        "i": spark.range(800).select("id", (F.col("id") / 2).cast("long").alias("o")),
    }
    done, report = relational.validate_relationships(tables, SHOP)
    assert (done["o"].count(), done["i"].count()) == (100, 200)
    assert all(r["passed"] for r in report.collect())
    with pytest.raises(relational.IntegrityError):
        relational.validate_relationships(tables, SHOP, repair=False, must_pass=True)


def test_copies_are_high_risk_and_independent_data_is_not(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([tuple(map(float, x)) for x in rng.normal(size=(400, 2))], "a double, b double")
    own = spark.createDataFrame([tuple(map(float, x)) for x in rng.normal(size=(400, 2))], "a double, b double")
    level = lambda t: {r["check"]: r["level"] for r in privacy.privacy_risk(t, ref).collect()}["overall"]
    assert level(ref) == "HIGH"
    assert level(own) != "HIGH"


def test_copies_of_rows_beyond_the_bounded_reference_are_seen(spark):
    rng = np.random.default_rng(3)
    ref = spark.createDataFrame([tuple(map(float, x)) for x in rng.normal(size=(4000, 2))], "a double, b double").cache()
    copies = ref.orderBy(F.xxhash64(F.lit(42), "a", "b").desc()).limit(300)
    own = copies.unionByName(spark.createDataFrame([tuple(map(float, x)) for x in rng.normal(size=(300, 2))], "a double, b double"))
    got = {r["check"]: (r["level"], r["value"]) for r in privacy.audit({"t": own}, {"t": ref}, "t").collect()}
    assert got["identical"] == ("HIGH", 0.5)
    assert got["copies"] == ("found", 0.5)
    assert got["overall"][0] == "HIGH"


def test_date_shifts_keep_intervals_and_null_ids(spark):
    df = spark.createDataFrame([("p", "2024-01-05", "2024-01-09"), ("p", "2024-03-01", "2024-03-02"), (None, "2024-01-01", "2024-01-02")], "id string, a string, b string")
    out = privacy.shift_dates(df, ["a", "b"], "id").select("id", F.datediff("b", "a").alias("d"), F.datediff("a", F.lit("2024-01-01")).alias("m")).collect()
    assert [r["d"] for r in out] == [4, 1, 1]
    assert out[2]["m"] == 0
    assert out[1]["m"] - out[0]["m"] == 56
    assert 30 <= abs(out[0]["m"] - 4) <= 365


def test_generation_is_the_same_for_any_partitioning_and_obeys_rules(spark):
    contract = Contract(
        (Column("k", "int"), Column("a", "float", 0, 100), Column("b", "float", 0, 100), Column("n", "int", 0, 30, "poisson", mean=4), Column("f", "bool", target_ratio=0.1)),
        2000,
        rules=("b <= a",),
        correlations=(Correlation("a", "n", "+", 0.5),),
        primary_key="k",
    )
    one = generate.generate(spark, contract)
    two = generate.generate(spark, contract, base=spark.range(0, 2000, 1, 5).withColumnRenamed("id", "row_id"))
    assert io.fingerprint(one) == io.fingerprint(two)
    assert one.where("b > a").count() == 0
    assert stats.pair_correlation(one, "a", "n") > 0.45
    assert io.fingerprint(one) != io.fingerprint(generate.generate(spark, contract, seed=0))


def test_noise_is_exact_and_explained(spark):
    df = spark.range(400).select("id", F.concat(F.lit("town"), "id").alias("city"), (F.col("id") % 60).alias("age"))
    out = enrich.with_noise(df, "id", 0.05)
    assert out.where("is_corrupted").count() == 20
    assert out.where("is_corrupted AND corruption_details = ''").count() == 0
    assert out.select("id").distinct().count() == 400


def test_noise_makes_large_outliers_and_names_each_change_once(spark):
    df = spark.range(2000).select("id", (F.col("id") * 1e8 + 5e7).alias("total"), F.lit("word").alias("w"))
    out = enrich.with_noise(df, "id", 0.8).where("is_corrupted").collect()
    assert sum(r["total"] is not None and r["total"] >= 5e9 and r["total"] == 100 * (r["id"] * 1e8 + 5e7) for r in out) > 50
    for r in out:
        columns = [x.split(":")[1] for x in r["corruption_details"].replace(";", ",").split(",") if ":" in x]
        assert r["total"] is None or "missing:total" not in r["corruption_details"]
        assert not ("outlier:total" in r["corruption_details"] and "missing:total" in r["corruption_details"]), columns


def test_bands_ratios_and_flags(spark):
    df = spark.createDataFrame([(29, 1200.0, 12000.0, 600.0, 579, 3, "2024-06-08 03:00:00"), (None, 10.0, 0.0, 0.0, 800, 0, "bad")], "customer_age int, transaction_amount double, customer_income double, credit_limit double, credit_score int, failed_attempts int, transaction_timestamp string")
    a, b = enrich.with_features(df).collect()
    assert (a["amount_to_income_ratio"], a["amount_to_limit_ratio"], a["age_group"], a["credit_rating"]) == (1.2, 2.0, "YOUNG", "POOR")
    assert (a["hour_of_day"], a["day_name"], a["is_weekend"], a["is_night"]) == (3, "Saturday", True, True)
    assert (b["amount_to_income_ratio"], b["age_group"], b["credit_rating"], b["hour_of_day"], b["day_name"]) == (0.0, "UNKNOWN", "EXCELLENT", -1, "Unknown")


def test_every_format_reads_back_equal(spark, tmp_path):
    contract = Contract((Column("k", "int"), Column("s", "str"), Column("x", "float")))
    odd = ['a "quoted", one', "#no comment", "two\nlines", "", None, " blank ", "cr\r\nlf", '"', '""', ",", "\\", '\\"', "#\n#"]
    df = spark.createDataFrame([(k, s, 1.5 if k % 2 else None) for k, s in enumerate(odd)], "k long, s string, x double")
    for fmt, path in io.write_table(df, str(tmp_path), "t", io.FORMATS).items():
        back = io.read_table(spark, path, fmt, contract).orderBy("k").collect()
        assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("k").collect()], fmt


def test_json_records_and_fingerprints(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    df = io.read_table(spark, str(tmp_path / "r.json"), "json", records=True)
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    said = io.declaration(df)
    assert io.verify(df.repartition(3), said)
    assert not io.verify(df.withColumn("a", F.col("a") + 1), said)


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 50).alias("g"))
    assert prepare.group_split(df, "g").groupBy("g").agg(F.count_distinct("split").alias("c")).where("c > 1").count() == 0
    with pytest.raises(ValueError, match="target"):
        prepare.without_leakage(df, ["g"], "g")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "age int, seen double, length int")
    assert clean.validate(df, NOISY).rows.count() == 0
    assert stats.column_stats(df).count() == 3
    assert stats.histogram(df, "seen").count() == 0
    assert privacy.divergence(df, df).count() == 0
