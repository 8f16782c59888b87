"""Rows changed so that they obey their rules, along the graph of the columns that rules link.

Each repairable part of a rule bounds one column, its target, by an expression of others.  Targets are
repaired in topological order, each once, within all its bounds at the same time, so that no repair undoes
another.  Intervals that columns can lie in are carried along the graph, forwards to find parts that no value
can meet, and backwards so that a column leaves room for those that it bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.contract import Column, Contract
from pactum.functions import rules as R

EPOCH = datetime(1970, 1, 1)
_INF = math.inf


@dataclass(frozen=True)
class Bound:
    """``target op expression``: a part of the rule ``rule``, or what one implies for a column that bounds another."""

    target: str
    op: str
    expression: R.Node
    rule: str
    implied: bool = False


@dataclass
class RepairPlan:
    """Bounds by target, in the order of repair, and (rule, reason) of parts that are left alone."""

    steps: dict[str, list[Bound]] = field(default_factory=dict)
    left: list[tuple[str, str]] = field(default_factory=list)


def _micros(day: datetime) -> float:
    return (day - EPOCH).total_seconds() * 1e6


def column_range(c: Column) -> tuple[float, float]:
    """The values that a column may take: its bounds, or its window in microseconds since 1970."""
    from pactum.operators.generate import datetime_window

    if c.type == "datetime":
        low, high = datetime_window(c.description)
        return _micros(low), _micros(high)
    if c.type == "bool":
        return 0.0, 1.0
    return (-_INF if c.min is None else float(c.min)), (_INF if c.max is None else float(c.max))


def expression_range(node: R.Node, ranges: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """The interval that an expression's values lie in, by interval arithmetic; unbounded where nothing is known."""
    unknown = (-_INF, _INF)
    match node:
        case R.Name(name):
            return ranges.get(name, unknown)
        case R.Literal(bool() | int() | float() as value):
            return float(value), float(value)
        case R.Literal(str() as text):
            try:
                return (_micros(datetime.fromisoformat(text)),) * 2
            except ValueError:
                return unknown
        case R.Sign(x):
            low, high = expression_range(x, ranges)
            return -high, -low
        case R.Absolute(x):
            low, high = expression_range(x, ranges)
            return (0.0 if low <= 0 <= high else min(abs(low), abs(high))), max(abs(low), abs(high))
        case R.Sum(op, left, right):
            a, b = expression_range(left, ranges), expression_range(right, ranges)
            if op == "+":
                return a[0] + b[0], a[1] + b[1]
            if op == "-":
                return a[0] - b[1], a[1] - b[0]
            if op == "/" and b[0] <= 0 <= b[1]:
                return unknown
            ends = [(x * y if op == "*" else x / y) for x in a for y in b]
            return unknown if any(map(math.isnan, ends)) else (min(ends), max(ends))
    return unknown


def plan_repairs(contract: Contract, fixed: set[str] | None = None) -> RepairPlan:
    """Which columns are repaired, in which order, and what is left alone and why.

    A part ``a op b`` changes the column that stands alone on one side, the left one if both do, unless it is
    in ``fixed``, no number or date, or used by its own bound.  Where that would close a circle of columns the other side is
    tried.  Reasons: "form" (or, not, !=, in, ... ), "no free column", "cyclic", and "contradictory" for parts that no
    values within the columns' ranges can meet.
    """
    fixed = fixed or set()
    plan = RepairPlan()
    uses: dict[str, set[str]] = {}
    bounds: list[Bound] = []

    def reaches(start: str, goal: str) -> bool:
        open_, seen = [start], set()
        while open_:
            name = open_.pop()
            if name == goal:
                return True
            if name not in seen:
                seen.add(name)
                open_ += uses.get(name, ())
        return False

    for text in contract.rules:
        for part in R.conjuncts(R.parse(text)):
            if not isinstance(part, R.Compare) or part.op == "!=":
                plan.left.append((text, "form"))
                continue
            sides = [(part.a, part.op, part.b), (part.b, R.TURNED[part.op], part.a)]
            free = [s for s in sides if isinstance(s[0], R.Name) and s[0].name in contract.names and s[0].name not in fixed | R.names(s[2]) and contract[s[0].name].type in ("int", "float", "datetime")]
            straight = [s for s in free if not any(reaches(n, s[0].name) for n in R.names(s[2]))]
            if not straight:
                plan.left.append((text, "cyclic" if free else "no free column"))
                continue
            target, op, other = straight[0]
            bounds.append(Bound(target.name, op, other, text))
            uses.setdefault(target.name, set()).update(R.names(other))

    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in sorted(uses.get(name, ())):
                visit(n)
            order.append(name)

    for b in bounds:
        visit(b.target)
    ranges = {c.name: column_range(c) for c in contract.columns if c.type in ("int", "float", "datetime", "bool")}
    kept: dict[str, list[Bound]] = {name: [] for name in order}
    for name in order:
        for b in (b for b in bounds if b.target == name):
            (low, high), (least, most) = ranges.get(name, (-_INF, _INF)), expression_range(b.expression, ranges)
            if b.op in ("<", "<="):
                high = min(high, most)
            elif b.op in (">", ">="):
                low = max(low, least)
            else:
                low, high = max(low, least), min(high, most)
            if low > high or (b.op in ("<", ">") and low == high and least == most):
                plan.left.append((b.rule, "contradictory"))
                continue
            ranges[name] = (low, high)
            kept[name].append(b)
    # Backwards: a column that alone bounds another stays where the other has room.
    for name in reversed(order):
        for b in list(kept[name]):
            source = b.expression
            if b.implied or not isinstance(source, R.Name) or source.name in fixed or b.op == "==" or source.name not in ranges:
                continue
            if contract[source.name].type != contract[name].type or contract[name].type == "datetime":
                continue
            # The target's own end, and what it must leave room for itself.
            c, below = contract[name], b.op in ("<", "<=")
            step = 1 if c.type == "int" else 0.01
            ends = [c.min if below else c.max]
            ends += [o.expression.value + (0 if "=" in o.op else step if below else -step) for o in kept[name] if o.implied and (">" in o.op) == below]
            ends = [e for e in ends if e is not None]
            end = (max(ends) if below else min(ends)) if ends else None
            low, high = ranges[source.name]
            if end is None or (end < low if below else end > high) or ("=" in b.op and end == (low if below else high)):
                continue
            kept.setdefault(source.name, []).append(Bound(source.name, R.TURNED[b.op], R.Literal(end), b.rule, True))
    full = [*[n for n in kept if n not in order], *order]
    placed: list[str] = []
    for name in full:  # sources that only implied bounds reach come first, as nothing bounds them
        if kept[name] and name not in placed:
            placed.append(name)
    plan.steps = {name: kept[name] for name in placed}
    return plan


def repair_report(spark: SparkSession, contract: Contract, fixed: set[str] | None = None) -> DataFrame:
    """(step, column, bound, rule, status): the order of repair and, without a step, the parts that are left alone."""
    plan = plan_repairs(contract, fixed)
    rows = [(k, name, f"{name} {b.op} {R.unparse(b.expression)}", b.rule, "implied" if b.implied else "repaired") for k, (name, bounds) in enumerate(plan.steps.items(), 1) for b in bounds]
    rows += [(None, None, None, rule, reason) for rule, reason in plan.left]
    return spark.createDataFrame(rows, "step int, column string, bound string, rule string, status string")


def draw_name(target: str) -> str:
    """The column that holds the uniform number of a target's repair."""
    return f"__fix_{target}"


def _in_micros(x: SparkColumn) -> SparkColumn:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x.cast("timestamp_ntz"))


def apply_plan(df: DataFrame, contract: Contract, plan: RepairPlan) -> DataFrame:
    """``df``, which has the uniform numbers of all targets, with one projection for a target's interval and one for its value.

    A row that violates one of a target's bounds gets a value within all of them and the column's range: the old
    one mirrored at the end that it lies beyond or, where that leaves the interval, one drawn uniformly from
    it; ``==`` takes the expression's value.  Whole numbers and hundredths stay such.  Where a row's interval is
    empty, or a bound or value is missing, the value stays.
    """
    for name, bounds in plan.steps.items():
        df = _repaired(df, contract[name], bounds)
    return df


def _repaired(df: DataFrame, c: Column, bounds: list[Bound]) -> DataFrame:
    old = F.col(f"`{c.name}`")
    kind = df.schema[c.name].dataType
    ok = F.lit(True)
    for b in bounds:
        ok = ok & R.to_column(R.Compare(b.op, R.Name(c.name), b.expression), df.schema)
    low, high = column_range(c)
    if c.type == "datetime":
        number, step = _in_micros, 1_000_000.0
        back = lambda x: F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(x / 1_000_000).cast("decimal(18,6)"))
    else:
        number, step = (lambda x: x.cast("double")), (1.0 if c.type == "int" else 0.01)
        back = lambda x: x

    def on_grid(x: SparkColumn, up: bool) -> SparkColumn:
        if c.type == "float":
            whole = F.round(x * 100, 6)
            return (F.ceil(whole) if up else F.floor(whole)).cast("double") / 100
        return (F.ceil(x) if up else F.floor(x)).cast("double")

    edges: dict[str, list[SparkColumn]] = {"low": [], "high": [], "equal": []}
    for b in bounds:
        edge = number(R.value_column(b.expression, df.schema)).cast("double")
        if b.op in ("<", "<="):
            edges["high"].append(edge - step if b.op == "<" else edge)
        elif b.op in (">", ">="):
            edges["low"].append(edge + step if b.op == ">" else edge)
        else:
            edges["equal"].append(edge)
    if edges["equal"]:
        value = edges["equal"][0]
        value = on_grid(value + (step / 2 if c.type != "datetime" else 0.0), False) if c.type != "datetime" else value
        return df.withColumn(c.name, F.when(ok | value.isNull(), old).otherwise(back(value).cast(kind)))

    def outermost(own: list[SparkColumn], end: float, pick: object) -> SparkColumn:
        every = own + ([F.lit(end)] if math.isfinite(end) else [])
        return F.lit(None).cast("double") if not every else every[0] if len(every) == 1 else pick(*every)

    top = on_grid(outermost(edges["high"], high, F.least), False)
    bottom = on_grid(outermost(edges["low"], low, F.greatest), True)
    df = df.withColumns({"__low": bottom, "__high": top})
    # An open end is as far from the other one as that is from zero, and one more.
    top = F.coalesce("__high", F.col("__low") + F.abs("__low") + 1)
    bottom = F.coalesce("__low", F.col("__high") - F.abs("__high") - 1)
    df = df.withColumns({"__low": bottom, "__high": top})
    value = number(old).cast("double")
    mirrored = F.when(value > F.col("__high"), 2 * F.col("__high") - value).otherwise(2 * F.col("__low") - value)
    drawn = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col(f"`{draw_name(c.name)}`")
    new = on_grid(F.when(mirrored.between(F.col("__low"), F.col("__high")), mirrored).otherwise(drawn), False)
    keep = ok | (F.col("__low") > F.col("__high")) | new.isNull()
    for edge in edges["low"] + edges["high"]:
        keep = keep | edge.isNull()
    return df.withColumn(c.name, F.when(keep, old).otherwise(back(new).cast(kind))).drop("__low", "__high")
