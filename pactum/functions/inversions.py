"""Discordant pairs of a whole table, counted exactly without meeting each pair.

Points are numbered by (x, y) and by (y, x); a pair is discordant if its two orders disagree.  Both orders are
cut into blocks of equal size.  Pairs within one block of the first order are counted there, pairs within one
block of the second that lie in different blocks of the first are counted there, and all others are pairs of blocks:
points again, with weights, and by far fewer, for which the same is done until they fit one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions.ranks import prefix_sums
from pactum.sources.work import materialised

#: Points of a block, and blocks of an order at most.
BLOCK, MAX_BLOCKS = 100_000, 2000


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The sum of weight products over pairs that stand in falling order, by merging sorted runs of doubling length."""
    n, total = len(values), 0
    now = np.unique(values, return_inverse=True)[1].astype(np.int64)
    weights = weights.astype(np.int64)
    wide = int(weights.sum(dtype=object)) ** 2 >= 2**63 if n else False
    width = 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        key = block * (n + 1) + now
        order = np.argsort(key[left], kind="stable")
        left_keys = key[left][order]
        run = np.concatenate([[0], np.cumsum(weights[left][order])])
        ends = np.searchsorted(left_keys, (block[~left] + 1) * (n + 1))
        above = run[ends] - run[np.searchsorted(left_keys, key[~left], side="right")]
        total += int(np.dot(above.astype(object), weights[~left].astype(object))) if wide else int(np.dot(above, weights[~left]))
        merged = np.lexsort((now, block))
        now, weights = now[merged], weights[merged]
        width *= 2
    return total


def discordant(points: DataFrame, block: int | None = None) -> int:
    """The number of pairs (weights multiplied) with x1 < x2 and y1 > y2 among distinct ``points`` (x, y, c)."""
    block = block or BLOCK
    points = materialised(points, "points")
    n = points.count()
    if n <= block:
        got = points.orderBy("x", "y").toPandas() if n else pd.DataFrame({"y": [], "c": []})
        return weighted_inversions(got["y"].to_numpy(), got["c"].to_numpy())
    size = max(block, math.ceil(n / MAX_BLOCKS))
    one = F.lit(1).cast("long").alias("one")
    across = prefix_sums(points.select("x", "y", "c", one, F.struct("x", "y").alias("o")), "o", ["one"]).select("x", "y", "c", F.col("before_one").alias("p"))
    down = prefix_sums(points.select("x", "y", one, F.struct("y", "x").alias("o")), "o", ["one"]).select("x", "y", F.col("before_one").alias("q"))
    numbered = across.join(down, ["x", "y"]).select("p", "q", "c", F.floor(F.col("p") / size).alias("bx"), F.floor(F.col("q") / size).alias("by"))
    numbered = materialised(numbered, "numbered")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        return pd.DataFrame({"d": [str(weighted_inversions(rows["b"].to_numpy(), rows["c"].to_numpy()))]})

    total = 0
    for group, first in (("bx", "p"), ("by", "bx")):
        counts = numbered.select(group, F.col(first).alias("a"), F.col("q").alias("b"), "c").groupBy(group).applyInPandas(within, "d string")
        total += sum(int(r["d"]) for r in counts.collect())
    blocks = numbered.groupBy(F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("c").alias("c"))
    # Blocks that agree in one order have been counted; equal x or y are no discordant pair here.
    return total + discordant(blocks, max(block, MAX_BLOCKS * MAX_BLOCKS // 4))


def kendall(pairs: DataFrame, block: int | None = None) -> float | None:
    """Tau-b of the columns x and y over all rows; None for fewer than three or a constant.  Nulls must be out."""
    points = materialised(pairs.groupBy("x", "y").agg(F.count("*").alias("c")), "pairs")

    def tied(*by: str) -> int:
        n = F.col("n").cast("decimal(38,0)")
        return int(points.groupBy(*by).agg(F.sum("c").alias("n")).agg(F.coalesce(F.sum((n * (n - 1)).cast("decimal(38,0)")), F.lit(0))).first()[0]) // 2

    n = points.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if n < 3:
        return None
    every, tied_x, tied_y, tied_both = n * (n - 1) // 2, tied("x"), tied("y"), tied("x", "y")
    below = math.sqrt(every - tied_x) * math.sqrt(every - tied_y)
    return (every - tied_x - tied_y + tied_both - 2 * discordant(points, block)) / below if below else None
