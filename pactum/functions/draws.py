"""Counter-based draws: uniform numbers from a seed, a label and a row number, by whole-number arithmetic alone.

A row number's two halves of 31 bits go through rounds of a Feistel network whose round function is the upper half of a
product, with round keys made of the seed and the label.  No product reaches 2^62, so nothing overflows, there
is no branch, and any engine with 64-bit integers and doubles repeats the draws: :func:`draws_sql` has them as SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, MULTIPLIER = 8, 1_540_483_477
_LOW = (1 << 31) - 1
#: Bits of the second half that a draw takes, after the 31 of the first.
_BITS = 21
_SCALE = float(1 << (31 + _BITS))


def round_keys(seed: int, label: str) -> list[int]:
    """ROUNDS + 1 keys of 31 bits; the last is added to the second half at the start."""
    digest = hashlib.sha512(f"{int(seed)}:{label}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") & _LOW for k in range(ROUNDS + 1)]


def uniforms(seed: int, label: str, rows: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each row number: a function of the seed, the label and the row number alone."""
    keys = round_keys(seed, label)
    a, b = rows & _LOW, ((rows >> 31) & _LOW) ^ keys[ROUNDS]
    for key in keys[:ROUNDS]:
        product = a * MULTIPLIER
        a, b = (product >> 31) ^ b ^ key, product & _LOW
    return ((a << _BITS) + (b >> (31 - _BITS)) + 0.5) / _SCALE


def with_draws(df: DataFrame, row: str, draws: Mapping[str, tuple[int, str]]) -> DataFrame:
    """``df`` with the number of :func:`uniforms` for each name in ``draws``, by its (seed, label) and the row number ``row``.

    ``row`` is a long; a null one gives nulls.  All draws go round together, two rounds to a projection, so that no
    expression grows: the plan has ROUNDS / 2 + 2 projections however many draws there are.
    """
    if not draws:
        return df
    keys = {name: round_keys(*draw) for name, draw in draws.items()}
    low, high = F.col(row).bitwiseAND(F.lit(_LOW)), F.shiftright(F.col(row), 31).bitwiseAND(F.lit(_LOW))
    names = [(name, f"__a_{name}", f"__b_{name}") for name in draws]
    out = df.withColumns({a: low for _, a, _ in names} | {b: high.bitwiseXOR(F.lit(keys[name][ROUNDS])) for name, _, b in names})
    for r in range(0, ROUNDS, 2):
        step = {}
        for name, a, b in names:
            x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
            for k in keys[name][r : r + 2]:
                product = x * F.lit(MULTIPLIER)
                x, y = F.shiftright(product, 31).bitwiseXOR(y).bitwiseXOR(F.lit(k)), product.bitwiseAND(F.lit(_LOW))
            step |= {a: x, b: y}
        out = out.withColumns(step)
    done = {name: ((F.col(f"`{a}`") * F.lit(1 << _BITS) + F.shiftright(F.col(f"`{b}`"), 31 - _BITS)).cast("double") + F.lit(0.5)) / F.lit(_SCALE) for name, a, b in names}
    return out.withColumns(done).drop(*(c for _, a, b in names for c in (a, b)))


def draws_sql(source: str, row: str, draws: Mapping[str, tuple[int, str]]) -> str:
    """A SELECT of everything in ``source`` and the draws of :func:`with_draws`, for row numbers of at least 0."""
    keys = {name: round_keys(*draw) for name, draw in draws.items()}
    halves = ", ".join(f"({row})::BIGINT & {_LOW} AS a_{k}, xor((({row})::BIGINT >> 31) & {_LOW}, {keys[name][ROUNDS]}) AS b_{k}" for k, name in enumerate(draws))
    out = f"SELECT s.*, {halves} FROM {source} s"
    for r in range(ROUNDS):
        step = ", ".join(f"xor(xor((a_{k} * {MULTIPLIER}) >> 31, b_{k}), {keys[name][r]}) AS a_{k}, (a_{k} * {MULTIPLIER}) & {_LOW} AS b_{k}" for k, name in enumerate(draws))
        out = f"SELECT * REPLACE ({step}) FROM ({out})"
    done = ", ".join(f'((a_{k} * {1 << _BITS} + (b_{k} >> {31 - _BITS}))::DOUBLE + 0.5::DOUBLE) / {_SCALE!r}::DOUBLE AS "{name}"' for k, name in enumerate(draws))
    return f"SELECT * EXCLUDE ({', '.join(f'a_{k}, b_{k}' for k in range(len(draws)))}), {done} FROM ({out})"
