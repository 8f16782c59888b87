"""Exact quantiles by counting: no sort of the table, and no task that holds a column's distinct values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048
#: Values that may come to the driver, for all columns together.
MAX_VALUES = 100_000
#: A pass that leaves more than this share of an interval's rows is followed by one over logarithms.
STUCK = 1 / 16
#: Above minus the logarithm of the least positive double.
_LIFT = 745.0


@dataclass
class _Interval:
    """Rows of a column from ``low`` to ``high``, with ``before`` rows below, in which ``ranks`` (from 0) are looked for."""

    column: int
    low: float
    high: float
    before: int
    rows: int
    ranks: set[int]
    logarithms: bool = False

    def holds(self, v: str = "v") -> Column:
        return (F.col("c") == self.column) & F.col(v).between(F.lit(self.low), F.lit(self.high))

    def share(self) -> Column:
        """How far v lies from low (0) to high (1), by value or by its signed logarithm; never falls as v rises."""
        if self.logarithms:
            low, high = _signed_log(self.low), _signed_log(self.high)
            return (F.signum("v") * (F.coalesce(F.log(F.abs("v")), F.lit(0.0)) + _LIFT) - F.lit(low)) / F.lit(high - low)
        # Halves, so that the width of the widest interval is a number too.
        return (F.col("v") / 2 - F.lit(self.low / 2)) / F.lit(self.high / 2 - self.low / 2)

    def wide(self) -> bool:
        """Whether logarithms would still tell values apart that lie close together here."""
        return self.low <= 0 <= self.high or max(abs(self.low), abs(self.high)) > 4 * min(abs(self.low), abs(self.high))


def _signed_log(v: float) -> float:
    return math.copysign(math.log(abs(v)) + _LIFT, v) if v else 0.0


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float], weight: Column | None = None) -> dict[str, list[float]]:
    """The quantiles of each numeric Column, by name, between neighbouring values in proportion; none for a column of nulls.

    ``weight``: how many rows a row stands for (1 or more), by default one.

    Each round counts rows by BINS bins of the intervals that hold the wanted ranks, and narrows these to
    one bin each, until few distinct values can be left.  Bins are of equal width; where that left more than a
    sixteenth of the rows, as with values over many decades, the next ones are of equal ratio, two rounds of
    which suffice for all doubles.  So it takes at most about log(n) / log(16) + 9 rounds, and for most columns log(n) / log(BINS) + 2,
    each of which shuffles at most BINS counts for an interval and task.
    """
    names = list(columns)
    w = (F.lit(1) if weight is None else weight).cast("long").alias("w")
    flat = df.select(w, F.inline(F.array(*[F.struct(F.lit(k).alias("c"), columns[c].cast("double").alias("v")) for k, c in enumerate(names)]))).where("v IS NOT NULL AND NOT isnan(v)")
    finite = F.abs("v") < float("inf")
    inside = F.when(finite, F.col("v"))
    got = flat.groupBy("c").agg(
        F.sum("w").alias("n"),
        F.sum(F.when(F.col("v") == float("-inf"), F.col("w")).otherwise(0)).alias("below"),
        F.sum(F.when(finite, F.col("w")).otherwise(0)).alias("inside"),
        F.min(inside).alias("low"),
        F.max(inside).alias("high"),
    ).collect()
    sizes = {r["c"]: r["n"] for r in got}
    found: dict[tuple[int, int], float] = {}
    left: list[_Interval] = []
    for r in got:
        ranks = {x for p in probabilities for x in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))}
        found |= {(r["c"], x): math.copysign(math.inf, x - r["below"] + 0.5) for x in ranks if not r["below"] <= x < r["below"] + r["inside"]}
        if inner := {x for x in ranks if (r["c"], x) not in found}:
            left.append(_Interval(r["c"], r["low"], r["high"], r["below"], r["inside"], inner))
    few: list[_Interval] = []
    while left:
        found |= {(i.column, x): i.low for i in left if i.low == i.high for x in i.ranks}
        left = [i for i in left if i.low < i.high]
        small = MAX_VALUES // max(len(left) + len(few), 1)
        few += [i for i in left if i.rows <= small]
        left = _narrowed(flat, [i for i in left if i.rows > small])
    if few:
        which = F.coalesce(*[F.when(i.holds(), F.lit(k)) for k, i in enumerate(few)])
        counts = flat.select(which.alias("k"), "v", "w").where("k IS NOT NULL").groupBy("k", "v").agg(F.sum("w").alias("n")).collect()
        for k, i in enumerate(few):
            run = i.before
            for v, n in sorted((r["v"], r["n"]) for r in counts if r["k"] == k):
                found |= {(i.column, x): v for x in i.ranks if run <= x < run + n}
                run += n
    out = {}
    for k, name in enumerate(names):
        if k in sizes:
            at = [p * (sizes[k] - 1) for p in probabilities]
            ends = [(found[k, math.floor(x)], found[k, math.ceil(x)], x - math.floor(x)) for x in at]
            out[name] = [a if a == b else a + (b - a) * share for a, b, share in ends]
    return out


def _narrowed(flat: DataFrame, intervals: list[_Interval]) -> list[_Interval]:
    """The bins of the intervals that hold their ranks."""
    if not intervals:
        return []

    def spot(k: int, i: _Interval) -> Column:
        at = F.floor(i.share() * BINS)
        return F.when(i.holds(), F.struct(F.lit(k).alias("k"), F.greatest(F.least(at, F.lit(BINS - 1)), F.lit(0)).alias("bin")))

    parts = F.array_compact(F.array(*[spot(k, i) for k, i in enumerate(intervals)]))
    counts = flat.select("v", "w", F.explode(parts).alias("s")).groupBy("s.k", "s.bin").agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    out = []
    for k, i in enumerate(intervals):
        run = i.before
        for r in sorted((r for r in counts if r["k"] == k), key=lambda r: r["bin"]):
            ranks = {x for x in i.ranks if run <= x < run + r["n"]}
            if ranks:
                part = _Interval(i.column, r["low"], r["high"], run, r["n"], ranks)
                part.logarithms = not i.logarithms and r["n"] > STUCK * i.rows and part.wide()
                out.append(part)
            run += r["n"]
    return out
