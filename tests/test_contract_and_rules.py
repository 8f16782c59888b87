import pytest

from pactum import contract as K
from pactum.functions import rules as R


def frame(spark):
    rows = [(1, 2.0, "a", True), (5, 0.0, "b", False), (None, None, None, None)]
    return spark.createDataFrame(rows, "x int, y double, s string, f boolean")


@pytest.mark.parametrize(
    ("rule", "truth"),
    [
        ("x > 1", [False, True, False]),
        ("x != 1", [False, True, True]),
        ("not (x > 1)", [True, False, True]),
        ("x IS NULL", [False, False, True]),
        ("x IS NOT NULL", [True, True, False]),
        ("0 < x <= 1", [True, False, False]),
        ("s in ['a', 'c']", [True, False, False]),
        ("s NOT IN ('a')", [False, True, True]),
        ("x / y > 100", [False, True, False]),
        ("f", [True, False, False]),
        ("f = 1", [True, False, False]),
        ("abs(-x) + y = 3", [True, False, False]),
    ],
)
def test_rules_treat_missing_values_and_zero_division(spark, rule, truth):
    df = frame(spark)
    got = [r[0] for r in df.select(R.to_column(rule, df.schema)).collect()]
    assert got == truth


@pytest.mark.parametrize("rule", ["__import__('os')", "x.y > 1", "x >", "lambda: 1", "max(x) > 1"])
def test_other_python_is_refused(rule):
    with pytest.raises(R.RuleError):
        R.parse(rule)


def test_numbers_and_text_cannot_be_compared(spark):
    df = frame(spark)
    with pytest.raises(R.RuleError):
        R.to_column("x > 'a'", df.schema)


def test_loading_drops_what_cannot_hold():
    spec = {
        "columns": [{"name": "a", "type": "int", "distribution": "Gaussian"}, {"name": "f", "type": "bool", "target_ratio": 0.02}, {"name": "s", "type": "str", "distribution": "odd"}],
        "rules": ["a >", "b > 1", "a > 'x'", "a > 1 and f == True", "a < 5"],
        "correlations": [{"a": "a", "b": "f", "min_r": 0.95}, {"a": "a", "b": "s"}],
    }
    with pytest.warns(UserWarning):
        c = K.Contract.from_dict(spec)
    assert c.rules == ("(a > 1)", "a < 5")
    assert c["a"].distribution == "normal"
    assert c["s"].distribution is None
    assert len(c.correlations) == 1
    assert c.correlations[0].min_r == pytest.approx(0.8 * K.reachable(c["a"], c["f"]), abs=1e-4)
    assert len(c.dropped) == 5


def test_bad_columns_and_cycles_are_errors():
    with pytest.raises(K.ContractError):
        K.Column("a", "int", 3, 1)
    one = K.Contract((K.Column("k", "int"), K.Column("p", "int")))
    links = (K.Relationship("a", "k", "b", "p"), K.Relationship("b", "k", "a", "p"))
    with pytest.raises(K.ContractError):
        K.Dataset({"a": one, "b": one}, "a", links)


def test_signs_and_directions_are_known_or_errors():
    assert [K.Correlation("a", "b", s).sign for s in ("positive", "Negative", "+", "-")] == ["+", "-", "+", "-"]
    assert [K.Monotone("a", "b", d).direction for d in ("positive", "decreasing", "-")] == ["increasing", "decreasing", "decreasing"]
    with pytest.raises(K.ContractError):
        K.Correlation("a", "b", "upwards")
    with pytest.raises(K.ContractError):
        K.Monotone("a", "b", "sideways")
    spec = {"columns": [{"name": "a", "type": "int"}, {"name": "b", "type": "int"}], "correlations": [{"a": "a", "b": "b", "sign": "odd"}, {"a": "a", "b": "b", "sign": "negative"}]}
    with pytest.warns(UserWarning):
        assert [c.sign for c in K.Contract.from_dict(spec).correlations] == ["-"]


def test_a_positive_sign_passes_with_a_positive_correlation(spark):
    from pactum.operators import stats

    df = spark.createDataFrame([(i, 2 * i, -i) for i in range(30)], "a long, b long, c long")
    rules = (K.Correlation("a", "b", "positive", 0.5), K.Correlation("a", "c", "negative", 0.5), K.Correlation("a", "c", "positive", 0.5))
    contract = K.Contract(tuple(K.Column(x, "int") for x in "abc"), correlations=rules)
    assert [r["passed"] for r in stats.correlation_check(df, contract).collect()] == [True, True, False]


@pytest.mark.parametrize("rule", ["a < 3 and not (b >= 2 or c == 'x\\'y')", "1 < a <= 5", "-a * (b + 2) / 3 != abs(c)", "`odd name` in ['p', \"q\"] && b IS NOT NULL || c <> 1.5e3", "NOT a NOT IN (1, 2)"])
def test_rules_survive_unparsing(rule):
    tree = R.parse(rule)
    assert R.parse(R.unparse(tree)) == tree
    assert R.names(tree) <= {"a", "b", "c", "odd name"}


def test_windows_of_descriptions():
    from pactum.operators.generate import datetime_window as w

    said = {"from 2024-01-01 to 2024-06-30": ("2024-01-01", "2024-06-30"), "since 2023-05-01": ("2023-05-01", "2024-04-30"), "Up to 2024-12-31": ("2024-01-01", "2024-12-31"), "any day": ("2024-01-01", "2024-12-31"), "until 2024-99-99": ("2024-01-01", "2024-12-31")}
    assert {k: tuple(str(x.date()) for x in w(k)) for k in said} == said
