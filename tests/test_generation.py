"""Counter-based draws, and repair along the graph of rules."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pactum.contract import Column, Contract
from pactum.functions import draws
from pactum.functions import rules as R
from pactum.operators import generate, repair


def test_draws_are_alike_in_numpy_spark_and_sql(spark):
    rows = np.array([0, 1, 2, 63, 2**31 - 1, 2**31, 2**40 + 7, 2**62 + 3], dtype=np.int64)
    labels = {"a": (42, "a"), "b": (0, "x second")}
    want = [[draws.uniforms(*label, rows)[k] for label in labels.values()] for k in range(len(rows))]
    df = spark.createDataFrame([(int(r),) for r in rows], "row long")
    got = {r["row"]: [r["a"], r["b"]] for r in draws.with_draws(df, "row", labels).collect()}
    assert [got[int(r)] for r in rows] == want
    values = ", ".join(f"({r}::BIGINT)" for r in rows)
    sql = duckdb.sql(draws.draws_sql(f"(SELECT * FROM (VALUES {values}) t(row))", "row", labels)).fetchall()
    assert [list(r[1:]) for r in sorted(sql)] == [want[k] for k in np.argsort(rows)]
    assert draws.with_draws(spark.sql("SELECT CAST(NULL AS BIGINT) AS row"), "row", labels).first()["a"] is None


def test_draws_are_uniform_and_independent():
    n = 1 << 18
    rows = np.arange(n, dtype=np.int64)
    for stride in (1, 4096, 2**31):
        a, b = draws.uniforms(7, "a", rows * stride), draws.uniforms(7, "b", rows * stride)
        assert 0 < a.min() and a.max() < 1
        for x, y in ((a[:-1], a[1:]), (a, b)):
            h = np.histogram2d(x, y, 32, ((0, 1), (0, 1)))[0]
            e = h.sum() / h.size
            assert abs((((h - e) ** 2) / e).sum() - 1023) < 5 * (2 * 1023) ** 0.5


def _numbers(*specs):
    return tuple(Column(name, kind, low, high) for name, kind, low, high in specs)


def test_rules_are_ordered_along_the_columns_that_they_link(spark):
    cols = _numbers(("a", "float", 10, 90), ("b", "float", 0, 100), ("c", "float", 0, 100), ("d", "float", None, None), ("n", "int", 0, 9))
    # In this order two passes over the rules would undo each other's work.
    contract = Contract(cols, 3000, rules=("d == c - b", "a < b", "b < c", "n >= 3", "n != 5 or a > 2"))
    plan = repair.plan_repairs(contract)
    assert list(plan.steps).index("d") > max(list(plan.steps).index(x) for x in "bc" if x in plan.steps)
    assert plan.left == [("n != 5 or a > 2", "form")]
    made = generate.generate(spark, contract)
    assert made.where("NOT (a < b AND b < c AND n >= 3 AND abs(d - (c - b)) < 0.011)").count() == 0
    # b leaves room for a, which is at least 10: no row is left without a value.
    assert made.where("a < 10 OR a > 90 OR b <= 10").count() == 0
    report = repair.repair_report(spark, contract).collect()
    assert {r["status"] for r in report} == {"repaired", "implied", "form"} and [r["step"] for r in report if r["step"]] == sorted(r["step"] for r in report if r["step"])


def test_cyclic_and_contradictory_rules_are_reported():
    cols = _numbers(("a", "float", 0, 10), ("b", "float", 0, 10), ("c", "float", 50, 60))
    left = dict(repair.plan_repairs(Contract(cols, rules=("a < b + c", "b < a * c", "c > a + b"))).left)
    assert left == {"b < a * c": "cyclic", "c > a + b": "cyclic"}
    # Turned round where that opens the circle.
    turned = repair.plan_repairs(Contract(cols, rules=("a < b", "b < a")))
    assert turned.left == [] and [b.op for b in turned.steps["a"]] == ["<", ">"] and all(b.implied for b in turned.steps["b"])
    assert repair.plan_repairs(Contract(cols, rules=("a > c",))).left == [("a > c", "contradictory")]
    assert repair.plan_repairs(Contract(cols, rules=("a + b < 3",))).left == [("a + b < 3", "no free column")]
    assert repair.plan_repairs(Contract(cols, rules=("a <= b",)), {"a", "b"}).left == [("a <= b", "no free column")]


def test_intervals_of_expressions():
    ranges = {"x": (-2.0, 3.0), "y": (1.0, 4.0)}
    known = {"x + y": (-1, 7), "x - y": (-6, 2), "x * y": (-8, 12), "y / 2": (0.5, 2), "-x": (-3, 2), "abs(x)": (0, 3), "1 / x": (-np.inf, np.inf), "2 * y - 1": (1, 7)}
    for text, want in known.items():
        assert repair.expression_range(R.parse(f"{text} > 0").a, ranges) == want, text


def test_plans_grow_linearly_with_rules(spark):
    def depth(n):
        cols = tuple(Column(f"c{k}", "float", 0, 100) for k in range(n + 1))
        made = generate.generate(spark, Contract(cols, 10, rules=tuple(f"c{k + 1} <= c{k}" for k in range(n))))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Project"), len(plan)

    (few, short), (many, long_) = depth(4), depth(12)
    assert many <= 3 * few + 3 and long_ < 6 * short


def test_given_rows_are_repaired_and_others_stay(spark):
    df = spark.createDataFrame([("p", 5, 9.0, 1.0), ("q", 5, 2.0, 1.0), ("r", None, 9.0, 1.0), ("s", 2, 500.0, 1.0), ("t", -9, 3.0, 1.0)], "k string, top long, x double, y double")
    contract = Contract(_numbers(("top", "int", 0, 10), ("x", "float", 0, 10), ("y", "float", 0, 10)), rules=("x <= top",))
    got = {r["k"]: r for r in generate.repair_rules(df, contract, "k", fixed={"top"}).collect()}
    assert got["q"]["x"] == 2.0 and got["p"]["x"] == 1.0  # mirrored at 5
    assert 0 <= got["s"]["x"] <= 2 and got["s"]["x"] == round(got["s"]["x"], 2)  # drawn
    assert got["r"]["x"] == 9.0 and got["t"]["x"] == 3.0  # no bound, and no room
    again = {r["k"]: r for r in generate.repair_rules(df.repartition(3), contract, "k", fixed={"top"}).collect()}
    assert again == got
    assert generate.repair_rules(df.limit(0), contract, "k").count() == 0
    assert df.where(F.col("x") == 9.0).count() == 2


def test_the_last_text_key_is_the_last_beyond_six_figures(spark, tmp_path):
    from pactum.plans import registry

    spark.range(1_000_003).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    (row,) = registry.QUERIES["g7_primary_key"](spark, str(tmp_path)).collect()
    assert tuple(row) == (1_000_003, 1_000_003, "SKU_000001", "SKU_1000003")
