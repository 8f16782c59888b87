"""Clean and validate a table against its contract, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contract import Contract
from pactum.functions import rules as R
from pactum.operators import forest, stats
from pactum.sources.work import materialised

#: Columns that mark anomalies, in order of preference, and the values that do.
ANOMALY_COLUMNS = ("is_fraud", "is_anomaly", "fraud_label", "is_attack", "fraud")
ANOMALY_VALUES = ("1", "true", "fraud", "anomaly")
#: Distributions with tails that a z-score would cut, and those that it suits.
HEAVY_TAILED = ("lognormal", "exponential", "poisson", "gamma", "pareto", "gpd", "zip", "tweedie")
SYMMETRIC = ("normal", "uniform")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df


def in_contract_order(df: DataFrame, contract: Contract) -> DataFrame:
    """the contract's columns first, in its order; others after them."""
    first = [c for c in contract.names if c in df.columns]
    return df.select(*[f"`{c}`" for c in first], *[f"`{c}`" for c in df.columns if c not in first])


def without_duplicates(df: DataFrame) -> DataFrame:
    """one of each group of rows that are equal in all columns."""
    return df.dropDuplicates()


def bound_tests(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """For each contract column of the table a Column that is true where its value is allowed."""
    out = {}
    for c in contract.columns:
        if c.name not in df.columns:
            continue
        col, ok = F.col(f"`{c.name}`"), F.lit(True)
        if c.numeric:
            if c.min is not None:
                ok = ok & (col >= c.min)
            if c.max is not None:
                ok = ok & (col <= c.max)
        elif c.type == "category":
            ok = ok & col.cast("string").isin(list(c.categories))
        out[c.name] = F.when(col.isNull(), F.lit(c.nullable)).otherwise(ok)
    return out


def _counted(df: DataFrame, tests: dict[str, Column]) -> tuple[int, dict[str, int]]:
    """(rows, rows that fail each test), in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(~t).alias(f"t{k}") for k, t in enumerate(tests.values())]).first()
    return row["n"], {name: row[f"t{k}"] for k, name in enumerate(tests)}


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def bounds_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(column, violations): each column counted over the same input."""
    tests = bound_tests(df, contract)
    counts = df.agg(*[F.count_if(~t).alias(c) for c, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("violations")) for c in tests])
    return counts.select(F.inline(pairs))


def within_bounds(df: DataFrame, contract: Contract) -> DataFrame:
    """rows without a null in a column that allows none, a number out of bounds or an unknown category."""
    return df.where(_all(list(bound_tests(df, contract).values())))


@dataclass
class RuleOutcome:
    """What became of one business rule."""

    rule: str
    status: str
    violations: int | None
    suspicious: bool
    reason: str


def rule_outcomes(df: DataFrame, rules: tuple[str, ...]) -> tuple[list[RuleOutcome], list[Column], int]:
    """every rule counted over the same input; the Columns of those that apply; the rows.

    A rule that does not parse or is not true or false is skipped; one that every row violates is skipped
    and suspicious; one that half the rows violate applies and is suspicious.
    """
    parsed, failed = _parsed(df, rules)
    n, counts = _counted(df, parsed)
    out, tests = _outcomes(rules, parsed, failed, n, counts)
    return out, tests, n


def _parsed(df: DataFrame, rules: tuple[str, ...]) -> tuple[dict[str, Column], dict[str, str]]:
    """(the Columns of rules that parse, why others do not)."""
    parsed: dict[str, Column] = {}
    failed: dict[str, str] = {}
    for rule in rules:
        try:
            parsed[rule] = R.to_column(rule, df.schema)
        except R.RuleError as e:
            failed[rule] = str(e)
    return parsed, failed


def _outcomes(rules: tuple[str, ...], parsed: dict[str, Column], failed: dict[str, str], n: int, counts: dict[str, int]) -> tuple[list[RuleOutcome], list[Column]]:
    """What becomes of each rule that ``counts`` of ``n`` rows violate, and the Columns that apply."""
    out, tests = [], []
    for rule in rules:
        if rule in failed:
            out.append(RuleOutcome(rule, "skipped", None, False, failed[rule]))
        elif n and counts[rule] == n:
            out.append(RuleOutcome(rule, "skipped", n, True, "every row violates it"))
        else:
            out.append(RuleOutcome(rule, "applied", counts[rule], bool(n) and counts[rule] >= n / 2, ""))
            tests.append(parsed[rule])
    return out, tests


def rules_report(df: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(rule, status, violations, suspicious, reason)."""
    rows = [(o.rule, o.status, o.violations, o.suspicious, o.reason) for o in rule_outcomes(df, rules)[0]]
    return df.sparkSession.createDataFrame(rows, "rule string, status string, violations long, suspicious boolean, reason string")


def obeying_rules(df: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """rows for which every applied rule is true."""
    return df.where(_all(rule_outcomes(df, rules)[1]))


def zscore_eligibility(df: DataFrame, contract: Contract, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, eligible, reason) for the numeric columns of the contract.

    A declared heavy-tailed distribution is not eligible and a declared normal or uniform one is; else more
    than 30 % zeros, an interquartile range of 0 or a Bowley skew above 0.30 rule a column out.
    """
    columns = columns or [c.name for c in contract.columns if c.numeric and c.name in df.columns]
    rows, unknown = [], []
    for name in columns:
        d = contract[name].distribution
        if d in HEAVY_TAILED:
            rows.append((name, False, f"declared {d}"))
        elif d in SYMMETRIC:
            rows.append((name, True, f"declared {d}"))
        else:
            unknown.append(name)
    if unknown:
        values = {name: F.col(f"`{name}`").cast("double") for name in unknown}
        got = df.agg(*[x for k, v in enumerate(values.values()) for x in (F.count(v).alias(f"n{k}"), F.count_if(v == 0).alias(f"z{k}"))]).first()
        quarts = stats.quantile_cuts(df, values, [0.25, 0.5, 0.75], exact)
        for k, name in enumerate(unknown):
            n, zeros, q = got[f"n{k}"], got[f"z{k}"], quarts.get(name)
            if not n:
                rows.append((name, False, "no values"))
            elif zeros > 0.3 * n:
                rows.append((name, False, "zero inflated"))
            elif q[2] - q[0] <= 0:
                rows.append((name, False, "no spread"))
            elif abs((q[2] + q[0] - 2 * q[1]) / (q[2] - q[0])) > 0.30:
                rows.append((name, False, "skewed"))
            else:
                rows.append((name, True, "symmetric"))
    order = {c: k for k, c in enumerate(columns)}
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: order[r[0]]), "column string, eligible boolean, reason string")


def preserved(df: DataFrame, contract: Contract | None = None) -> Column:
    """rows that outlier stages must keep: those that the anomaly column marks, by contract or by name."""
    name = contract.preserve_column if contract else None
    value = contract.preserve_value if contract else None
    if name is None:
        name = next((c for c in ANOMALY_COLUMNS if c in df.columns), None)
    if name is None or name not in df.columns:
        return F.lit(False)
    text = F.lower(F.col(f"`{name}`").cast("string"))
    if value is not None:
        return F.coalesce(text == str(value).lower(), F.lit(False))
    return F.coalesce(text.isin(*ANOMALY_VALUES, "1.0"), F.lit(False))


def _moments(columns: list[str]) -> list[Column]:
    return [f(F.col(f"`{c}`").cast("double")).alias(f"{w}{k}") for k, c in enumerate(columns) for f, w in ((F.avg, "m"), (F.stddev_pop, "s"))]


def _zscore_tests(df: DataFrame, columns: list[str], threshold: float) -> dict[str, Column]:
    return _far_tests(df.agg(*_moments(columns)).first(), columns, threshold) if columns else {}


def _far_tests(got: Row, columns: list[str], threshold: float) -> dict[str, Column]:
    """For each column a test that is false for values far from the mean, given :func:`_moments`."""
    out = {}
    for k, c in enumerate(columns):
        mean, std = got[f"m{k}"], got[f"s{k}"]
        if std:
            far = F.abs(F.col(f"`{c}`") - F.lit(mean)) / F.lit(std) > threshold
            out[c] = ~F.coalesce(far, F.lit(False))
    return out


def without_zscore_outliers(df: DataFrame, columns: list[str], threshold: float = 3.0, keep: Column | None = None) -> DataFrame:
    """rows whose values all lie within ``threshold`` population standard deviations of their mean.

    Null passes, constant columns are skipped, and rows that ``keep`` marks stay.
    """
    tests = _zscore_tests(df, columns, threshold)
    ok = _all(list(tests.values()))
    return df.where(ok if keep is None else ok | keep)


def zscore_report(df: DataFrame, columns: list[str], threshold: float = 3.0, keep: Column | None = None) -> DataFrame:
    """(column, outliers, preserved): outliers that go and those that ``keep`` saves."""
    keep = F.lit(False) if keep is None else keep
    tests = _zscore_tests(df, columns, threshold)
    kinds = {c: (F.count_if(~t & ~keep), F.count_if(~t & keep)) for c, t in tests.items()}
    if not kinds:
        return df.sparkSession.createDataFrame([], "column string, outliers long, preserved long")
    got = df.agg(*[x.alias(f"{w}{k}") for k, pair in enumerate(kinds.values()) for x, w in zip(pair, "op", strict=True)]).first()
    rows = [(c, got[f"o{k}"], got[f"p{k}"]) for k, c in enumerate(kinds)]
    return df.sparkSession.createDataFrame(rows, "column string, outliers long, preserved long")


@dataclass
class Validation:
    """The result of a full run: the rows that are left and queryable reports."""

    rows: DataFrame
    stages: DataFrame
    rules: DataFrame
    correlations: DataFrame
    guard_reverted: bool


def validate(df: DataFrame, contract: Contract, z_threshold: float = 3.0, contamination: float = 0.0) -> Validation:
    """order, duplicates, bounds, rules, z-scores, isolation forest and the correlation guard.

    Declared correlations are measured before and after the outlier stages; if one that held no longer
    does, both outlier stages are undone.
    """
    spark = df.sparkSession
    start = in_contract_order(without_nan(df), contract)
    # The one full-width shuffle: distinct rows with how often each was there.  Written, as all later steps are
    # filters and aggregates over it: one for bounds and rules, one for moments and correlations, one for the end.
    unique = materialised(start.groupBy(*[f"`{c}`" for c in start.columns]).agg(F.count("*").alias(_COPIES)), "unique")
    bounds = _all(list(bound_tests(unique, contract).values()))
    parsed, failed = _parsed(start, contract.rules)
    got = unique.agg(F.sum(_COPIES).alias("in"), F.count("*").alias("unique"), F.count_if(bounds).alias("bounded"), *[F.count_if(bounds & ~t).alias(f"t{k}") for k, t in enumerate(parsed.values())]).first()
    n_in, n_unique, n_bounded = got["in"] or 0, got["unique"], got["bounded"]
    outcomes, tests = _outcomes(contract.rules, parsed, failed, n_bounded, {rule: got[f"t{k}"] for k, rule in enumerate(parsed)})
    ruled = unique.where(bounds & _all(tests)).drop(_COPIES)
    keep = preserved(ruled, contract)
    eligible = [r["column"] for r in zscore_eligibility(ruled, contract).collect() if r["eligible"]]
    n_ruled, before, moments = _measured(ruled, contract, _moments(eligible))
    z_tests = _far_tests(moments, eligible, z_threshold)
    z_rows = ruled.where(_all(list(z_tests.values())) | keep) if z_tests else ruled
    numeric = [c.name for c in contract.columns if c.numeric and c.name in df.columns]
    forested = contamination > 0
    final = forest.without_isolated(z_rows, numeric, contamination, keep=preserved(z_rows, contract)) if forested else z_rows
    n_z = z_rows.count() if forested else None
    n_final, after, _ = _measured(final, contract, []) if z_tests or forested else (n_ruled, before, None)
    n_z = n_final if n_z is None else n_z
    held = {(r["a"], r["b"], r["method"]) for r in before if r["passed"]}
    broken = {(r["a"], r["b"], r["method"]) for r in after if not r["passed"]}
    reverted = bool(held & broken)
    counts = [("duplicates", n_in, n_unique), ("bounds", n_unique, n_bounded), ("rules", n_bounded, n_ruled)]
    counts += [("zscore", n_ruled, n_ruled if reverted else n_z), ("isolation_forest", n_ruled if reverted else n_z, n_ruled if reverted else n_final)]
    rows = [(k + 1, name, a, b, a - b, round(100.0 * (a - b) / a, 4) if a else 0.0) for k, (name, a, b) in enumerate(counts)]
    stage_frame = spark.createDataFrame(rows, "step int, stage string, rows_before long, rows_after long, removed long, removed_pct double")
    rule_frame = spark.createDataFrame([(o.rule, o.status, o.violations, o.suspicious, o.reason) for o in outcomes], "rule string, status string, violations long, suspicious boolean, reason string")
    correlations = spark.createDataFrame([tuple(r[c] for c in stats.CORRELATION_COLUMNS) for r in (before if reverted else after)], stats.CORRELATION_SCHEMA)
    return Validation(ruled if reverted else final, stage_frame, rule_frame, correlations, reverted)


#: How often a distinct row was there, while a table is validated.
_COPIES = "__pactum_copies"


def _measured(df: DataFrame, contract: Contract, more: list[Column]) -> tuple[int, list[dict], Row]:
    """(rows, declared correlations, ``more`` aggregates) in one pass, but for rank correlations."""
    straight, columns = stats.straight_correlations(df, contract)
    got = df.agg(F.count("*").alias("rows"), *columns, *more).first()
    return got["rows"], stats.correlation_rows(df, contract, stats.straight_values(got, straight)), got


def conformance_issues(df: DataFrame, contract: Contract, min_ratio: float = 0.5) -> DataFrame:
    """(column, issue, measured): how the table departs from the contract; nothing is changed."""
    present = [c for c in contract.columns if c.name in df.columns]
    aggs = [F.count("*").alias("n")]
    for k, c in enumerate(present):
        col = F.col(f"`{c.name}`")
        aggs.append(F.count_if(col.isNull()).alias(f"null{k}"))
        if c.numeric:
            aggs.append(F.count_if(col < F.lit(c.min)).alias(f"low{k}"))
            aggs.append(F.count_if(col > F.lit(c.max)).alias(f"high{k}"))
            aggs.append(F.count_if(col != F.floor(col)).alias(f"part{k}"))
        elif c.type == "bool":
            aggs.append(F.avg(col.cast("int")).alias(f"share{k}"))
        elif c.type == "category":
            aggs.append(F.count_if(~col.cast("string").isin(list(c.categories))).alias(f"other{k}"))
    got = df.agg(*aggs).first()
    n = got["n"]
    rows: list[tuple] = [(c.name, "missing", None) for c in contract.columns if c.name not in df.columns]
    rows += [(c, "extra", None) for c in df.columns if c not in contract.names]
    if n < min_ratio * contract.row_count:
        rows.append((None, "too few rows", float(n)))
    for k, c in enumerate(present):
        def share(what: str, k: int = k) -> float:
            return got[f"{what}{k}"] / n if n else 0.0

        if share("null") > 0.15:
            rows.append((c.name, "nulls", round(share("null"), 6)))
        if c.numeric:
            if c.min is not None and share("low") > 0.25:
                rows.append((c.name, "below min", round(share("low"), 6)))
            if c.max is not None and share("high") > 0.25:
                rows.append((c.name, "above max", round(share("high"), 6)))
            if c.type == "int" and got[f"part{k}"]:
                rows.append((c.name, "fractions in an int column", round(share("part"), 6)))
        elif c.type == "bool" and c.target_ratio is not None and got[f"share{k}"] is not None:
            if abs(got[f"share{k}"] - c.target_ratio) > max(0.05, c.target_ratio / 2):
                rows.append((c.name, "positive share", round(got[f"share{k}"], 6)))
        elif c.type == "category" and share("other") > 0.10:
            rows.append((c.name, "unknown categories", round(share("other"), 6)))
    return df.sparkSession.createDataFrame(rows, "column string, issue string, measured double")


def aligned_integers(df: DataFrame, contract: Contract) -> DataFrame:
    """floating-point values of int columns rounded half-even; nothing is clipped."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [c.name for c in contract.columns if c.type == "int" and isinstance(kinds.get(c.name), (T.DoubleType, T.FloatType, T.DecimalType))]
    return df.withColumns({c: F.bround(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).cast("long") for c in cols}) if cols else df
