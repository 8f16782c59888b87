"""Row rules: a small expression language turned into Columns.

    rule   := and-terms joined by OR        term   := sum, an optional test
    and    := not-terms joined by AND       test   := comparison sum (chained), [NOT] IN list, IS [NOT] NULL
    not    := NOT not | term                sum    := products joined by + -
    list   := [a, b] or (a, b)              product := factors joined by * /
    factor := - factor | + factor | abs(rule) | (rule) | number | text | TRUE | FALSE | NULL | column

Comparisons are ``< <= > >= = == != <>``; ``&&`` and ``||`` are AND and OR; words may be in either case; a column
whose name is no plain word stands in backquotes.

A comparison with a missing value is false (``!=``: true), as is membership; arithmetic with one gives a
missing value.  x / 0 is an infinity with the sign of x, and 0 / 0 is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RuleError(ValueError):
    """A rule that is not in the language, or not true or false."""


@dataclass(frozen=True)
class Name:
    """A column."""

    name: str


@dataclass(frozen=True)
class Literal:
    """A number, text, True, False or None."""

    value: object


@dataclass(frozen=True)
class Sign:
    """A number with its sign turned."""

    of: Node


@dataclass(frozen=True)
class Absolute:
    """abs(x)."""

    of: Node


@dataclass(frozen=True)
class Sum:
    """Two numbers joined by + - * or /."""

    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class Compare:
    """Two values joined by < <= > >= == or !=."""

    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class In:
    """Membership in a list of values."""

    a: Node
    values: tuple[Node, ...]


@dataclass(frozen=True)
class Missing:
    """IS NULL."""

    of: Node


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    """AND."""

    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Either:
    """OR."""

    parts: tuple[Node, ...]


Node = Name | Literal | Sign | Absolute | Sum | Compare | In | Missing | Not | Both | Either

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |`(?P<quoted>[^`]+)`
    |(?P<word>[^\W\d]\w*)
    |(?P<sign><=|>=|==|!=|<>|&&|\|\||[-+*/<>=()\[\],]))""",
    re.X,
)
_SIGNS = {"=": "==", "<>": "!=", "&&": "and", "||": "or"}
_WORDS = {"and", "or", "not", "in", "is", "null", "none", "true", "false", "abs"}
_COMPARISONS = {"<", "<=", ">", ">=", "==", "!="}
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


class _Parser:
    """Reads one rule from left to right; ``kind`` and ``value`` are the token at hand."""

    def __init__(self, text: str) -> None:
        self.tokens = self._split(text)
        self.step()

    @staticmethod
    def _split(text: str) -> Iterator[tuple[str, str]]:
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if m is None:
                raise RuleError(f"it does not parse at {text[at : at + 12]!r}")
            at, kind, value = m.end(), m.lastgroup, m[m.lastgroup]
            if kind == "word" and value.lower() in _WORDS:
                yield "sign", value.lower()
            elif kind == "sign":
                yield "sign", _SIGNS.get(value, value)
            elif kind == "text":
                yield "text", re.sub(r"\\(.)", r"\1", value[1:-1])
            else:
                yield ("number", value) if kind == "number" else ("name", value)
        yield "end", ""

    def step(self) -> None:
        self.kind, self.value = next(self.tokens)

    def take(self, *signs: str) -> str | None:
        """The sign at hand if it is one of ``signs``, after stepping over it."""
        if self.kind == "sign" and self.value in signs:
            found = self.value
            self.step()
            return found
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise RuleError(f"it does not parse: {sign!r} expected, not {self.value!r}")

    def rule(self) -> Node:
        parts = [self.conjunction()]
        while self.take("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def conjunction(self) -> Node:
        parts = [self.negation()]
        while self.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def negation(self) -> Node:
        return Not(self.negation()) if self.take("not") else self.test()

    def test(self) -> Node:
        found, left = [], self.sum()
        while True:
            if op := self.take(*_COMPARISONS):
                right = self.sum()
                found.append(Compare(op, left, right))
                left = right
            elif self.take("is"):
                turned = self.take("not")
                self.need("null" if self.value != "none" else "none")
                found.append(Not(Missing(left)) if turned else Missing(left))
            elif op := self.take("in", "not"):
                if op == "not":
                    self.need("in")
                member = In(left, self.listed())
                found.append(Not(member) if op == "not" else member)
            else:
                break
        return left if not found else found[0] if len(found) == 1 else Both(tuple(found))

    def listed(self) -> tuple[Node, ...]:
        close = {"(": ")", "[": "]"}.get(self.take("(", "[") or "")
        if close is None:
            raise RuleError("in needs a list")
        out = []
        while not self.take(close):
            out.append(self.sum())
            if not self.take(","):
                self.need(close)
                break
        return tuple(out)

    def sum(self) -> Node:
        out = self.product()
        while op := self.take("+", "-"):
            out = Sum(op, out, self.product())
        return out

    def product(self) -> Node:
        out = self.factor()
        while op := self.take("*", "/"):
            out = Sum(op, out, self.factor())
        return out

    def factor(self) -> Node:
        if self.take("-"):
            return Sign(self.factor())
        if self.take("+"):
            return self.factor()
        if self.take("abs"):
            self.need("(")
            inner = Absolute(self.rule())
            self.need(")")
            return inner
        if self.take("("):
            inner = self.rule()
            self.need(")")
            return inner
        if word := self.take("true", "false", "null", "none"):
            return Literal({"true": True, "false": False}.get(word))
        kind, value = self.kind, self.value
        if kind in ("sign", "end"):
            raise RuleError(f"it does not parse: a value expected, not {value or 'its end'!r}")
        self.step()
        if kind == "name":
            return Name(value)
        return Literal(value if kind == "text" else float(value) if re.search(r"[.eE]", value) else int(value))


def parse(text: str) -> Node:
    parser = _Parser(text)
    out = parser.rule()
    if parser.kind != "end":
        raise RuleError(f"it does not parse: nothing expected after it, not {parser.value!r}")
    return out


def parts_of(node: Node) -> tuple[Node, ...]:
    """The nodes right below one."""
    match node:
        case Sign(x) | Absolute(x) | Missing(x) | Not(x):
            return (x,)
        case Sum(_, a, b) | Compare(_, a, b):
            return (a, b)
        case In(a, values):
            return (a, *values)
        case Both(parts) | Either(parts):
            return parts
    return ()


def nodes(node: Node) -> Iterator[Node]:
    """A node and all below it."""
    yield node
    for part in parts_of(node):
        yield from nodes(part)


def names(node: Node) -> set[str]:
    """The columns that a rule reads."""
    return {n.name for n in nodes(node) if isinstance(n, Name)}


def conjuncts(node: Node) -> list[Node]:
    """The parts that must all be true."""
    out, left = [], [node]
    while left:
        first = left.pop(0)
        if isinstance(first, Both):
            left = [*first.parts, *left]
        else:
            out.append(first)
    return out


def unparse(node: Node) -> str:
    """A text that parses to the node."""
    match node:
        case Name(name):
            return name if re.fullmatch(r"[^\W\d]\w*", name) and name.lower() not in _WORDS else f"`{name}`"
        case Literal(str() as text):
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        case Literal(value):
            return "null" if value is None else str(value).lower() if isinstance(value, bool) else repr(value)
        case Sign(x):
            return f"-{_inner(x)}"
        case Absolute(x):
            return f"abs({unparse(x)})"
        case Sum(op, a, b) | Compare(op, a, b):
            return f"{_inner(a)} {op} {_inner(b)}"
        case In(a, values):
            return f"{_inner(a)} in [{', '.join(map(unparse, values))}]"
        case Missing(x):
            return f"{_inner(x)} is null"
        case Not(x):
            return f"not {_inner(x)}"
        case Both(parts) | Either(parts):
            return (" and " if isinstance(node, Both) else " or ").join(map(_inner, parts))
    raise RuleError(f"{node!r} is not part of the rule language")


def _inner(node: Node) -> str:
    return unparse(node) if isinstance(node, (Name, Literal, Absolute)) else f"({unparse(node)})"


def compares_number_with_text(node: Node, types: dict[str, str]) -> bool:
    """Whether a number or bool column stands against text, which it never equals."""
    for n in nodes(node):
        sides = (n.a, n.b) if isinstance(n, Compare) else (n.a, *n.values) if isinstance(n, In) else ()
        number = any(isinstance(x, Name) and types.get(x.name) in ("int", "float", "bool") for x in sides)
        if number and any(isinstance(x, Literal) and isinstance(x.value, str) for x in sides):
            return True
    return False


def pins_bool(part: Node, bools: set[str]) -> bool:
    """Whether a part fixes a bool column to one value."""
    while isinstance(part, Not):
        part = part.of
    if isinstance(part, Compare) and part.op in ("==", "!="):
        kinds = {type(part.a), type(part.b)}
        return kinds == {Name, Literal} and bool(names(part) & bools)
    return isinstance(part, Name) and part.name in bools


class _Translator:
    """Nodes to Columns over one schema."""

    def __init__(self, schema: T.StructType) -> None:
        self.types = {f.name: f.dataType for f in schema.fields}

    def kind(self, node: Node) -> str:
        if isinstance(node, Name):
            if node.name not in self.types:
                raise RuleError(f"unknown column {node.name}")
            t = self.types[node.name]
            if isinstance(t, T.BooleanType):
                return "bool"
            if isinstance(t, T.NumericType):
                return "number"
            return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "text"
        if isinstance(node, Literal):
            return {bool: "bool", int: "number", float: "number", str: "text"}.get(type(node.value), "null")
        return "number" if isinstance(node, (Sign, Absolute, Sum)) else "bool"

    def number(self, node: Node) -> Column:
        kind = self.kind(node)
        if kind in ("text", "time"):
            raise RuleError("arithmetic needs numbers")
        value = self.value(node)
        return value.cast("int") if kind == "bool" else value

    def value(self, node: Node) -> Column:
        match node:
            case Name(name):
                self.kind(node)
                col = F.col(f"`{name}`")
                return F.nanvl(col, F.lit(None)) if isinstance(self.types[name], (T.DoubleType, T.FloatType)) else col
            case Literal(value):
                return F.lit(value)
            case Sign(x):
                return -self.number(x)
            case Absolute(x):
                return F.abs(self.number(x))
            case Sum(op, left, right):
                a, b = self.number(left), self.number(right)
                if op == "/":
                    a, b = a.cast("double"), b.cast("double")
                    signed = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
                    return F.when(b == 0, signed).otherwise(F.try_divide(a, b))
                return a * b if op == "*" else a + b if op == "+" else a - b
        return self.truth(node)

    def compare(self, op: str, a: Node, b: Node) -> Column:
        x, y, kx, ky = self.value(a), self.value(b), self.kind(a), self.kind(b)
        if {kx, ky} == {"bool", "number"}:
            x, y = (v.cast("int") if k == "bool" else v for v, k in ((x, kx), (y, ky)))
        elif {kx, ky} == {"time", "text"}:
            x, y = (v.cast("timestamp_ntz") for v in (x, y))
        elif "null" not in (kx, ky) and kx != ky:
            raise RuleError(f"{kx} and {ky} cannot be compared")
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
        return F.coalesce(test, F.lit(op == "!="))

    def truth(self, node: Node) -> Column:
        match node:
            case Both(parts) | Either(parts):
                out = self.truth(parts[0])
                for p in parts[1:]:
                    out = out & self.truth(p) if isinstance(node, Both) else out | self.truth(p)
                return out
            case Not(x):
                return ~self.truth(x)
            case Missing(x):
                return self.value(x).isNull()
            case Compare(op, a, b):
                return self.compare(op, a, b)
            case In(a, values):
                found = F.lit(False)
                for v in values:
                    found = found | self.compare("==", a, v)
                return found
            case Name() | Literal() if self.kind(node) == "bool":
                return F.coalesce(self.value(node), F.lit(False))
        raise RuleError("the rule is not true or false")


def to_column(rule: str | Node, schema: T.StructType) -> Column:
    """The rule as a Column that is true or false, never null."""
    return _Translator(schema).truth(parse(rule) if isinstance(rule, str) else rule)


def value_column(node: Node, schema: T.StructType) -> Column:
    """The value of an expression of the language."""
    return _Translator(schema).value(node)
