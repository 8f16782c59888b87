"""Profiles and statistical checks of a table."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contract import Contract, Correlation, Monotone
from pactum.functions.inversions import kendall
from pactum.functions.quantiles import exact_quantiles
from pactum.functions.ranks import drawn, prefix_sums, proportional, with_rank

LEAST_KS_VALUES = 20


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _value(name: str) -> Column:
    """A numeric or bool column as double, NaN as null."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None))


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, kind, rows, nulls, distinct, min, max, mean, std, median, true_share) of every column.

    One pass for moments, one that counts each (column, value) once for the distinct values, and the passes
    of :func:`exact_quantiles` for medians; ``exact=False`` takes approximate distinct values and medians in one pass.
    """
    fields = df.schema.fields
    kind = ["numeric" if isinstance(f.dataType, T.NumericType) else "bool" if isinstance(f.dataType, T.BooleanType) else "other" for f in fields]
    aggs = [F.count("*").alias("n")]
    for k, f in enumerate(fields):
        v = _value(f.name) if kind[k] == "numeric" else F.col(f"`{f.name}`")
        aggs.append(F.count_if(v.isNull()).alias(f"nulls{k}"))
        if kind[k] == "numeric":
            aggs += [x.alias(f"{w}{k}") for x, w in ((F.min(v), "min"), (F.max(v), "max"), (F.avg(v), "mean"), (F.stddev_samp(v), "std"))]
        elif kind[k] == "bool":
            aggs.append(F.avg(v.cast("int")).alias(f"true{k}"))
        if not exact:
            aggs.append(F.approx_count_distinct(v if kind[k] == "numeric" else v.cast("string")).alias(f"distinct{k}"))
            if kind[k] == "numeric":
                aggs.append(F.percentile_approx(v, 0.5, 10000).cast("double").alias(f"median{k}"))
    got = df.agg(*aggs).first().asDict()
    if exact:
        numbers = {f.name: _value(f.name) for k, f in enumerate(fields) if kind[k] == "numeric"}
        medians = exact_quantiles(df, numbers, [0.5]) if numbers else {}
        got |= {f"median{k}": medians[f.name][0] for k, f in enumerate(fields) if f.name in medians}
        none = F.lit(None)
        # Whole numbers and decimals are told apart in their own type, as text.
        loose = [isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in fields]
        values = [F.struct(F.lit(k).alias("c"), (_value(f.name) if loose[k] else none).cast("double").alias("d"), (none if loose[k] else F.col(f"`{f.name}`")).cast("string").alias("s")) for k, f in enumerate(fields)]
        seen = df.select(F.inline(F.array(*values))).where("d IS NOT NULL OR s IS NOT NULL").groupBy("c", "d", "s").agg(F.lit(1))
        got |= {f"distinct{r['c']}": r["n"] for r in seen.groupBy("c").agg(F.count("*").alias("n")).collect()}
    rows = []
    for k, f in enumerate(fields):
        numbers = [got.get(f"{w}{k}") for w in ("min", "max", "mean", "std", "median", "true")]
        rows.append((f.name, kind[k], got["n"], got[f"nulls{k}"], got.get(f"distinct{k}", 0), *[None if x is None else float(x) for x in numbers]))
    return df.sparkSession.createDataFrame(rows, "column string, kind string, rows long, nulls long, distinct long, min double, max double, mean double, std double, median double, true_share double")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, value, count, rank): the ``k`` most frequent non-null values of each column, ties to the smaller value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("count"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def schema_conformance(df: DataFrame, contract: Contract) -> DataFrame:
    """(missing, extra, order_matches); no job over the table."""
    missing = [c for c in contract.names if c not in df.columns]
    extra = [c for c in df.columns if c not in contract.names]
    same = [c for c in df.columns if c in contract.names] == [c for c in contract.names if c in df.columns]
    return df.sparkSession.createDataFrame([(missing, extra, same)], "missing array<string>, extra array<string>, order_matches boolean")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(a, b, r) for all pairs of numeric columns, Pearson or Spearman, null pairs left out."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if method == "spearman":
        whole = df.select(*[_value(c).alias(c) for c in columns])
        gaps = whole.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in columns]).first()
        if any(gaps):
            # Ranks are among the rows that have both columns, so each pair has its own.
            rows = [(a, b, pair_correlation(df, a, b, "spearman")) for a, b in pairs]
            return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
        for c in columns:
            whole = with_rank(whole, c, f"{c} rank").drop(c).withColumnRenamed(f"{c} rank", c)
        df = whole
    one = df.agg(*[F.corr(_value(a), _value(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def pair_correlation(df: DataFrame, a: str, b: str, method: str = "pearson", max_rows: int | None = None, seed: int = 42) -> float | None:
    """The correlation of two columns over rows that have both; None for fewer than three or a constant.

    Kendall's tau-b counts all discordant pairs of the table or, with ``max_rows``, those of a proportional sample of about as many rows.
    """
    pairs = df.select(_value(a).alias("x"), _value(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if method == "kendall":
        return kendall(pairs if max_rows is None else proportional(pairs, ["x", "y"], max_rows, seed, "kendall"))
    if method == "spearman":
        pairs = with_rank(with_rank(pairs, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    row = pairs.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
    return row["r"] if row["n"] >= 3 and row["r"] is not None and not math.isnan(row["r"]) else None


CORRELATION_COLUMNS = ("a", "b", "method", "sign", "min_r", "r", "passed", "reason")
CORRELATION_SCHEMA = "a string, b string, method string, sign string, min_r double, r double, passed boolean, reason string"


def _measurable(df: DataFrame, contract: Contract) -> list[Correlation]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in contract.correlations if all(isinstance(kinds.get(x), (T.NumericType, T.BooleanType)) for x in (c.a, c.b))]


def straight_correlations(df: DataFrame, contract: Contract) -> tuple[list[tuple[str, str]], list[Column]]:
    """(the declared Pearson pairs, the aggregates that measure them all in one pass)."""
    pairs = list(dict.fromkeys((c.a, c.b) for c in _measurable(df, contract) if c.method == "pearson"))
    both = [_value(a).isNotNull() & _value(b).isNotNull() for a, b in pairs]
    return pairs, [x for k, (a, b) in enumerate(pairs) for x in (F.corr(_value(a), _value(b)).alias(f"r{k}"), F.count_if(both[k]).alias(f"n{k}"))]


def straight_values(got: Row, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """The correlations in a row of the aggregates; None for fewer than three rows or a constant."""
    known = {pair: (got[f"r{k}"], got[f"n{k}"]) for k, pair in enumerate(pairs)}
    return {pair: r if n >= 3 and r is not None and not math.isnan(r) else None for pair, (r, n) in known.items()}


def correlation_rows(df: DataFrame, contract: Contract, straight: dict[tuple[str, str], float | None]) -> list[dict]:
    """The verdict on every declared correlation, given the Pearson ones."""
    known = _measurable(df, contract)
    rows = []
    for c in contract.correlations:
        reason, r = "", None
        if c not in known:
            reason = "a column is missing or not numeric"
        else:
            r = straight[(c.a, c.b)] if c.method == "pearson" else pair_correlation(df, c.a, c.b, c.method)
            if r is None:
                reason = "a column is constant or there are too few rows"
        signed = None if r is None else (r if c.sign == "+" else -r)
        row = (c.a, c.b, c.method, c.sign, float(c.min_r), r, signed is not None and signed >= c.min_r, reason)
        rows.append(dict(zip(CORRELATION_COLUMNS, row, strict=True)))
    return rows


def correlation_check(df: DataFrame, contract: Contract) -> DataFrame:
    """(a, b, method, sign, min_r, r, passed, reason) of every declared correlation."""
    pairs, columns = straight_correlations(df, contract)
    measured = straight_values(df.agg(*columns).first(), pairs) if pairs else {}
    rows = [tuple(r.values()) for r in correlation_rows(df, contract, measured)]
    return df.sparkSession.createDataFrame(rows, CORRELATION_SCHEMA)


def ks_test(df: DataFrame, other: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n1, n2, statistic, p_value, passed): the two-sample Kolmogorov-Smirnov test.

    Columns with fewer than 20 values on a side are left out; the p-value is the asymptotic series.
    """
    columns = columns or [c for c in numeric_columns(df) if c in numeric_columns(other)]
    rows = []
    for c in columns:
        sides = [x.select(_value(c).alias("v"), F.lit(k).alias("side")).where("v IS NOT NULL") for k, x in enumerate((df, other))]
        counts = sides[0].unionByName(sides[1]).groupBy("v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
        total = counts.agg(F.sum("a"), F.sum("b")).first()
        if min(total[0] or 0, total[1] or 0) < LEAST_KS_VALUES:
            continue
        run = prefix_sums(counts, "v", ["a", "b"])
        gap = F.abs((F.col("before_a") + F.col("a")) / F.lit(total[0]) - (F.col("before_b") + F.col("b")) / F.lit(total[1]))
        d = run.agg(F.max(gap)).first()[0]
        p = kolmogorov_p(d * math.sqrt(total[0] * total[1] / (total[0] + total[1])))
        rows.append((c, total[0], total[1], d, p, p > 0.05))
    return df.sparkSession.createDataFrame(rows, "column string, n1 long, n2 long, statistic double, p_value double, passed boolean")


def kolmogorov_p(x: float) -> float:
    """The tail of the Kolmogorov distribution."""
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def describe(df: DataFrame) -> DataFrame:
    """(column, type) and count, mean, std, min and max of every column, as text where they are not numbers."""
    aggs = []
    for k, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        aggs += [F.count(col).alias(f"count{k}"), F.min(col).cast("string").alias(f"min{k}"), F.max(col).cast("string").alias(f"max{k}")]
        aggs += [(F.avg(col) if number else F.lit(None).cast("double")).alias(f"mean{k}"), (F.stddev_samp(col) if number else F.lit(None).cast("double")).alias(f"std{k}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), *[F.col(f"{w}{k}").alias(w) for w in ("count", "mean", "std", "min", "max")]) for k, f in enumerate(df.schema.fields)]
    return one.select(F.inline(F.array(*rows)))


def first_rows(df: DataFrame, n: int = 8, order: list[str] | None = None) -> DataFrame:
    """Some rows to look at, the first by ``order`` if given."""
    return (df.orderBy(*order) if order else df).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, low, high, count): equal-width bins from min to max, the last one closed; empty bins have 0."""
    v = df.select(_value(column).alias("v")).where("v IS NOT NULL")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = v.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def quantile_cuts(df: DataFrame, columns: dict[str, Column], probabilities: list[float], exact: bool = True) -> dict[str, list[float]]:
    """The quantiles of each Column by name, exact or approximate; none for a column of nulls."""
    if exact:
        return exact_quantiles(df, columns, probabilities)
    got = df.agg(*[F.percentile_approx(v, probabilities, 10000).alias(f"q{k}") for k, v in enumerate(columns.values())]).first()
    return {c: [float(x) for x in got[f"q{k}"]] for k, c in enumerate(columns) if got[f"q{k}"]}


def _bin_edges(df: DataFrame, column: str, n: int, fewest: int, exact: bool = True) -> list[float]:
    """The distinct quantiles that cut a column into ``n`` bins; ``fewest`` equal widths where there are under three."""
    cuts = quantile_cuts(df, {column: _value(column)}, [k / n for k in range(n + 1)], exact).get(column, [])
    edges = sorted(set(cuts))
    if len(edges) == 2:
        low, high = edges
        edges = [low + (high - low) * k / fewest for k in range(fewest + 1)]
    return edges


def binned_means(df: DataFrame, x: str, y: str, n_bins: int = 10, exact: bool = True) -> DataFrame:
    """(bin, n, mean_y): y by quantile bins of x; a bin's number is how many inner edges are at most x."""
    pairs = df.select(_value(x).alias("x"), _value(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    edges = _bin_edges(pairs, "x", n_bins, n_bins, exact)
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(F.col("x") >= F.lit(e), 1).otherwise(0)
    return pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"))


def binned_monotonicity(df: DataFrame, x: str, y: str, direction: str = "increasing", n_bins: int = 10, exact: bool = True) -> DataFrame:
    """(steps, steps_ok, ratio): steps between neighbouring bins that go in the direction, within 1e-6."""
    means = binned_means(df, x, y, n_bins, exact)
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean_y"))), lambda s: s["mean_y"]).alias("m"))
    sign = 1 if direction == "increasing" else -1
    steps = F.transform(F.sequence(F.lit(2), F.size("m")), lambda k: sign * (F.element_at("m", k.cast("int")) - F.element_at("m", (k - 1).cast("int"))))
    steps = F.when(F.size("m") >= 2, steps).otherwise(F.array().cast("array<double>"))
    ok = F.size(F.filter(steps, lambda d: d >= -1e-6))
    return one.select(F.size(steps).alias("steps"), ok.alias("steps_ok"), F.try_divide(ok, F.size(steps)).alias("ratio"))


def pairwise_concordance(df: DataFrame, x: str, y: str, direction: str = "increasing", max_pairs: int = 2000, seed: int = 42) -> DataFrame:
    """(pairs, concordant, ratio) over up to ``max_pairs`` random pairs of rows; ties in x are left out."""
    pairs = df.select(_value(x).alias("x"), _value(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sample = proportional(pairs, ["x", "y"], 2 * max_pairs, seed, "concordance")
    place = F.struct(drawn(seed, "pairing", "x", "y", "copy").alias("u"), "x", "y", "copy")
    rows = sample.agg(F.array_sort(F.collect_list(place)).alias("r"))
    half = F.floor(F.size("r") / 2).cast("int")
    gaps = F.transform(F.sequence(F.lit(1), half), lambda i: (F.element_at("r", i.cast("int"))["x"] - F.element_at("r", (i + half).cast("int"))["x"]) * F.lit(1.0))
    rises = F.transform(F.sequence(F.lit(1), half), lambda i: F.element_at("r", i.cast("int"))["y"] - F.element_at("r", (i + half).cast("int"))["y"])
    sign = 1 if direction == "increasing" else -1
    both = F.arrays_zip(gaps.alias("dx"), rises.alias("dy"))
    kept = F.when(half >= 1, F.filter(both, lambda s: s["dx"] != 0))
    n = F.coalesce(F.size(kept), F.lit(0))
    good = F.coalesce(F.size(F.filter(kept, lambda s: sign * s["dx"] * s["dy"] > 0)), F.lit(0))
    return rows.select(n.alias("pairs"), good.alias("concordant"), F.try_divide(good, n).alias("ratio"))


def monotonicity_check(df: DataFrame, rules: tuple[Monotone, ...], exact: bool = True) -> DataFrame:
    """X11: (x, y, direction, binned, pairwise, spearman, passed, reason) of every declared relation."""
    rows = []
    for r in rules:
        if r.x not in df.columns or r.y not in df.columns:
            rows.append((r.x, r.y, r.direction, None, None, None, False, "missing column"))
            continue
        n = df.where(_value(r.x).isNotNull() & _value(r.y).isNotNull()).count()
        if n < 10:
            rows.append((r.x, r.y, r.direction, None, None, None, False, "fewer than 10 rows"))
            continue
        binned = binned_monotonicity(df, r.x, r.y, r.direction, exact=exact).first()["ratio"]
        pairwise = pairwise_concordance(df, r.x, r.y, r.direction).first()["ratio"]
        rho = pair_correlation(df, r.x, r.y, "spearman")
        signed = None if rho is None else rho * (1 if r.direction == "increasing" else -1)
        ok = binned is not None and binned >= r.min_ratio and pairwise is not None and pairwise >= 0.85 * r.min_ratio and signed is not None and signed >= -0.05
        rows.append((r.x, r.y, r.direction, binned, pairwise, rho, ok, ""))
    return df.sparkSession.createDataFrame(rows, "x string, y string, direction string, binned double, pairwise double, spearman double, passed boolean, reason string")


def weight_of_evidence(df: DataFrame, feature: str, target: str, n_bins: int = 10, exact: bool = True) -> DataFrame:
    """(bin, low, high, n, good, bad, bad_rate, woe, iv) for a 0/1 target (1 is bad), bins closed on the right."""
    pairs = df.select(_value(feature).alias("x"), _value(target).alias("y")).where("x IS NOT NULL AND y IN (0, 1)")
    got = pairs.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    spark = df.sparkSession
    schema = "bin int, low double, high double, n long, good long, bad long, bad_rate double, woe double, iv double"
    if not got["n"]:
        return spark.createDataFrame([], schema)
    edges = _bin_edges(pairs, "x", n_bins, min(5, n_bins), exact)
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(F.col("x") > F.lit(e), 1).otherwise(0)
    bad_all, good_all = float(got["bad"]), float(got["n"] - got["bad"])
    bins = pairs.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("bad"))
    good = F.col("n") - F.col("bad")
    share_good = F.greatest(good.cast("double"), F.lit(0.5)) / F.lit(max(good_all, 0.5))
    share_bad = F.greatest(F.col("bad").cast("double"), F.lit(0.5)) / F.lit(max(bad_all, 0.5))
    woe = F.log(share_good / share_bad)
    low = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    high = F.element_at(F.array(*[F.lit(float(e)) for e in edges] * (2 if len(edges) == 1 else 1)), F.col("bin") + 2)
    return bins.select("bin", low.alias("low"), high.alias("high"), "n", good.alias("good"), "bad", (F.col("bad") / F.col("n")).alias("bad_rate"), woe.alias("woe"), ((share_good - share_bad) * woe).alias("iv"))


def information_value(df: DataFrame, feature: str, target: str, n_bins: int = 10, exact: bool = True) -> DataFrame:
    """(iv, power, trend): total information value, its label, and whether WoE goes one way within 0.05."""
    bins = weight_of_evidence(df, feature, target, n_bins, exact)
    one = bins.agg(F.sum("iv").alias("iv"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "woe"))), lambda s: s["woe"]).alias("w"))
    steps = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.element_at("w", k.cast("int")) - F.element_at("w", (k - 1).cast("int"))))
    power = F.when(F.col("iv") < 0.02, "unpredictive").when(F.col("iv") < 0.10, "weak").when(F.col("iv") < 0.30, "medium").otherwise("strong")
    up, down = F.forall(steps, lambda d: d >= -0.05), F.forall(steps, lambda d: d <= 0.05)
    trend = F.when(up, "increasing").when(down, "decreasing").otherwise("none")
    return one.select("iv", power.alias("power"), trend.alias("trend"))
