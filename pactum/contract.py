"""Contracts: what a table, and a set of linked tables, should look like."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace
from statistics import NormalDist

from pyspark.sql import types as T

from pactum.functions import rules as R

TYPES = ("int", "float", "bool", "str", "category", "datetime")
#: The distributions that a contract may name.
DISTRIBUTIONS = ("normal", "uniform", "lognormal", "exponential", "poisson", "gamma", "pareto", "gpd", "zip", "tweedie", "custom")
#: Other spellings of them.
DISTRIBUTION_ALIASES = {
    "gaussian": "normal", "norm": "normal",
    "log-normal": "lognormal", "log_normal": "lognormal", "lognorm": "lognormal",
    "exp": "exponential", "expon": "exponential",
    "zero_inflated_poisson": "zip", "zeroinflated_poisson": "zip", "zip_poisson": "zip",
    "generalized_pareto": "gpd", "generalised_pareto": "gpd", "genpareto": "gpd",
    "compound_poisson_gamma": "tweedie",
    "discrete_uniform": "uniform", "uniform_int": "uniform", "randint": "uniform", "integer_uniform": "uniform",
}
#: Other spellings of signs and directions.
SIGNS = {"+": "+", "positive": "+", "pos": "+", "-": "-", "negative": "-", "neg": "-"}
DIRECTIONS = {"increasing": "increasing", "positive": "increasing", "up": "increasing", "+": "increasing", "decreasing": "decreasing", "negative": "decreasing", "down": "decreasing", "-": "decreasing"}
_SPARK_TYPES = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "str": T.StringType(),
    "category": T.StringType(),
    "datetime": T.TimestampNTZType(),
}


class ContractError(ValueError):
    """A contract that cannot be worked with."""


@dataclass(frozen=True)
class Column:
    """One column: its type, bounds and distribution."""

    name: str
    type: str
    min: float | None = None
    max: float | None = None
    distribution: str | None = None
    mean: float | None = None
    std: float | None = None
    target_ratio: float | None = None
    categories: tuple[str, ...] = ()
    nullable: bool = False
    shape: float | None = None
    scale: float | None = None
    zero_prob: float | None = None
    p_index: float | None = None
    description: str = ""

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ContractError(f"{self.name}: unknown type {self.type!r}")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ContractError(f"{self.name}: min is above max")
        if self.std is not None and self.std < 0:
            raise ContractError(f"{self.name}: std is negative")
        for what in ("target_ratio", "zero_prob"):
            value = getattr(self, what)
            if value is not None and not 0 <= value <= 1:
                raise ContractError(f"{self.name}: {what} is not between 0 and 1")
        if self.type == "category" and not self.categories:
            raise ContractError(f"{self.name}: a category column needs categories")

    @property
    def numeric(self) -> bool:
        return self.type in ("int", "float")

    @property
    def countable(self) -> bool:
        """Numbers and booleans can be correlated."""
        return self.type in ("int", "float", "bool")


def _spelled(value: str, known: dict[str, str], what: str) -> str:
    """The plain spelling of a value; anything unknown is an error rather than a guess."""
    try:
        return known[str(value).strip().lower()]
    except KeyError:
        raise ContractError(f"unknown {what}: {value!r}") from None


@dataclass(frozen=True)
class Correlation:
    """Two columns should correlate with a sign and at least ``min_r``."""

    a: str
    b: str
    sign: str = "+"
    min_r: float = 0.3
    method: str = "pearson"

    def __post_init__(self) -> None:
        if self.method not in ("pearson", "spearman", "kendall"):
            object.__setattr__(self, "method", "pearson")
        object.__setattr__(self, "sign", _spelled(self.sign, SIGNS, f"sign of {self.a}, {self.b}"))


@dataclass(frozen=True)
class Monotone:
    """y should rise or fall with x in at least ``min_ratio`` of the steps."""

    x: str
    y: str
    direction: str = "increasing"
    min_ratio: float = 0.90

    def __post_init__(self) -> None:
        object.__setattr__(self, "direction", _spelled(self.direction, DIRECTIONS, f"direction of {self.x}, {self.y}"))


@dataclass(frozen=True)
class Contract:
    """One table."""

    columns: tuple[Column, ...]
    row_count: int = 100_000
    seed: int = 42
    rules: tuple[str, ...] = ()
    correlations: tuple[Correlation, ...] = ()
    monotone: tuple[Monotone, ...] = ()
    primary_key: str | None = None
    preserve_column: str | None = None
    preserve_value: object = None
    dropped: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ContractError("column names repeat")
        if self.primary_key is not None and self.primary_key not in names:
            raise ContractError(f"primary key {self.primary_key!r} is not a column")

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _SPARK_TYPES[c.type]) for c in self.columns])

    @classmethod
    def from_dict(cls, spec: dict) -> Contract:
        """A contract from its JSON form.

        Rules, correlations and monotone relations that cannot hold are left out with a warning, and
        listed in ``dropped``; broken columns raise :class:`ContractError`.
        """
        columns = []
        for c in spec.get("columns", []):
            own = {k: v for k, v in c.items() if k in Column.__dataclass_fields__}
            name = own.get("distribution")
            if name is not None:
                name = DISTRIBUTION_ALIASES.get(str(name).lower(), str(name).lower())
                own["distribution"] = name if name in DISTRIBUTIONS else None
            own["categories"] = tuple(own.get("categories") or ())
            columns.append(Column(**own))
        if not columns:
            raise ContractError("a contract needs columns")
        by = {c.name: c for c in columns}
        dropped: list[str] = []
        rules = []
        for text in spec.get("rules", spec.get("business_rules", [])):
            kept, why = _usable_rule(text, by)
            if why:
                dropped.append(f"rule {text!r}: {why}")
            if kept:
                rules.append(kept)
        correlations = []
        for r in spec.get("correlations", []):
            try:
                rule = r if isinstance(r, Correlation) else Correlation(**r)
            except ContractError as e:
                dropped.append(str(e))
                continue
            if rule.a not in by or rule.b not in by or not (by[rule.a].countable and by[rule.b].countable):
                dropped.append(f"correlation {rule.a}, {rule.b}: a column is unknown or not numeric")
                continue
            top = reachable(by[rule.a], by[rule.b])
            correlations.append(replace(rule, min_r=round(0.8 * top, 4)) if rule.min_r > top else rule)
        monotone = []
        for r in spec.get("monotone", spec.get("monotonicity_rules", [])):
            try:
                rule = r if isinstance(r, Monotone) else Monotone(**r)
            except ContractError as e:
                dropped.append(str(e))
                continue
            if rule.x not in by or rule.y not in by or not (by[rule.x].countable and by[rule.y].countable):
                dropped.append(f"monotone {rule.x}, {rule.y}: a column is unknown or not numeric")
                continue
            monotone.append(rule)
        for what in dropped:
            warnings.warn(what, stacklevel=2)
        return cls(
            tuple(columns),
            spec.get("row_count", spec.get("row_count_target", 100_000)),
            spec.get("seed", spec.get("random_seed", 42)),
            tuple(rules),
            tuple(correlations),
            tuple(monotone),
            spec.get("primary_key"),
            spec.get("preserve_column", spec.get("preserve_anomaly_column")),
            spec.get("preserve_value", spec.get("preserve_anomaly_value")),
            tuple(dropped),
        )


def _usable_rule(text: str, by: dict[str, Column]) -> tuple[str | None, str | None]:
    """(what is left of a rule, why something was left out)."""
    try:
        tree = R.parse(text)
    except R.RuleError as e:
        return None, str(e)
    names = R.names(tree)
    if not names:
        return None, "it names no column"
    if names - by.keys():
        return None, f"unknown column {sorted(names - by.keys())[0]}"
    if R.compares_number_with_text(tree, {n: c.type for n, c in by.items()}):
        return None, "it compares a number with text"
    parts = R.conjuncts(tree)
    # A part that pins a two-class column to one value would leave one class.
    kept = [p for p in parts if not R.pins_bool(p, {n for n, c in by.items() if c.type == "bool"})]
    if len(kept) == len(parts):
        return text, None
    if not kept:
        return None, "it pins a bool column to one value"
    return " and ".join(f"({R.unparse(p)})" for p in kept), "a part pins a bool column to one value"


def reachable(a: Column, b: Column) -> float:
    """The highest correlation that a pair can have, given the positive shares of bool columns."""
    normal = NormalDist()

    def share(c: Column) -> float:
        p = 0.5 if c.target_ratio is None else c.target_ratio
        return min(max(p, 1e-6), 1 - 1e-6)

    if a.type == b.type == "bool":
        low, high = sorted((share(a), share(b)))
        return math.sqrt(low * (1 - high) / (high * (1 - low)))
    if "bool" in (a.type, b.type):
        p = share(a if a.type == "bool" else b)
        return normal.pdf(normal.inv_cdf(p)) / math.sqrt(p * (1 - p))
    return 1.0


@dataclass(frozen=True)
class Relationship:
    """A child table whose key column refers to a parent's."""

    parent: str
    parent_key: str
    child: str
    child_key: str
    mean: float = 3.0
    min_per_parent: int = 0
    max_per_parent: int | None = None
    nullable: bool = False

    @property
    def name(self) -> str:
        return f"{self.child}.{self.child_key}->{self.parent}.{self.parent_key}"


@dataclass(frozen=True)
class Dataset:
    """Linked tables."""

    tables: dict[str, Contract]
    root: str
    relationships: tuple[Relationship, ...] = ()
    seed: int = 42

    def __post_init__(self) -> None:
        if self.root not in self.tables:
            raise ContractError(f"root {self.root!r} is not a table")
        for r in self.relationships:
            if r.parent == r.child:
                raise ContractError(f"{r.child} is its own parent")
            for table, key in ((r.parent, r.parent_key), (r.child, r.child_key)):
                if table not in self.tables or key not in self.tables[table].names:
                    raise ContractError(f"{table}.{key} is unknown")
        self.order()

    def order(self) -> list[str]:
        """The tables, parents first; a cycle raises :class:`ContractError`."""
        left = {t: {r.parent for r in self.relationships if r.child == t} for t in self.tables}
        out: list[str] = []
        while left:
            free = [t for t, parents in left.items() if not parents - set(out)]
            if not free:
                raise ContractError(f"relationships form a cycle: {sorted(left)}")
            out += free
            for t in free:
                del left[t]
        return out
