"""An isolation forest: fitted on a bounded sample, scored over the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.ranks import nth_smallest, proportional
from pactum.sources.work import materialised

TREES, NODE_ROWS, MAX_FIT_ROWS, LEAST_ROWS = 100, 256, 50_000, 50
#: Depths are whole numbers of this part, so that sums over trees do not depend on their order.
UNIT = 1 << 20


def _average_path(n: int) -> float:
    """The mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def fit(sample: np.ndarray, seed: int = 42) -> list[tuple[np.ndarray, ...]]:
    """Trees as flat arrays: feature (-1 in a leaf), cut, left child, right child, depth of a leaf in parts of 1 / UNIT."""
    rng = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(2, min(NODE_ROWS, len(sample))))))
    trees = []
    for _ in range(TREES):
        rows = sample[rng.choice(len(sample), min(NODE_ROWS, len(sample)), replace=False)]
        nodes: list[list] = []

        def grow(part: np.ndarray, depth: int, nodes: list[list] = nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, round((depth + _average_path(len(part))) * UNIT)])
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth < deepest and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                cut = rng.uniform(low[f], high[f])
                below = part[:, f] < cut
                nodes[at][:2] = [f, cut]
                nodes[at][2] = grow(part[below], depth + 1)
                nodes[at][3] = grow(part[~below], depth + 1)
            return at

        grow(rows, 0)
        trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return trees


def depths(trees: list[tuple[np.ndarray, ...]], rows: np.ndarray) -> np.ndarray:
    """The depth of every row's leaf, added up over the trees, as whole numbers: a small sum is an isolated row."""
    total = np.zeros(len(rows), dtype=np.int64)
    every = np.arange(len(rows))
    for feature, cut, left, right, depth in trees:
        at = np.zeros(len(rows), dtype=np.int64)
        while True:
            live = feature[at] >= 0
            if not live.any():
                break
            f = np.maximum(feature[at], 0)
            down = np.where(rows[every, f] < cut[at], left[at], right[at])
            at = np.where(live, down, at)
        total += depth[at]
    return total


def without_isolated(df: DataFrame, columns: list[str], contamination: float, seed: int = 42, keep: Column | None = None) -> DataFrame:
    """F8: the table without the ``contamination`` share of most isolated rows.

    Needs two columns and 50 complete rows, else nothing is removed.  Rows with a null or an infinity are
    kept unscored; of the n others exactly round(n * contamination) are marked, those of the smallest depths, ties by a hash of all
    columns (rows alike in all of them go together, as far as that does not pass the share).  Marked rows go, but for
    those that ``keep`` holds.
    """
    if contamination <= 0 or len(columns) < 2:
        return df
    whole = F.lit(True)
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        whole = whole & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    values = [F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(columns)]
    names = [f"v{k}" for k in range(len(columns))]
    picked = proportional(df.where(whole).select(*values), names, MAX_FIT_ROWS, seed, "forest").orderBy(*names, "copy")
    picked = picked.select(*names).toPandas().to_numpy(dtype=float)
    if len(picked) < LEAST_ROWS:
        return df
    shared = df.sparkSession.sparkContext.broadcast(fit(picked, seed))

    @F.pandas_udf("long")
    def scored(*cols):  # noqa: ANN002, ANN202
        import pandas as pd

        return pd.Series(depths(shared.value, np.stack([c.to_numpy(dtype=float) for c in cols], axis=1)))

    deep = F.when(whole, scored(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]))
    marked = materialised(df.withColumns({"__depth": deep, "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])}), "depths")
    n = round(marked.where("__depth IS NOT NULL").count() * contamination)
    found = nth_smallest(marked, "__depth", n) if n else None
    if found is None:
        return df
    cut, below, equal = found
    goes = F.col("__depth") <= cut
    if below + equal > n:
        tied = nth_smallest(marked.where(F.col("__depth") == cut), "__tie", n - below)
        last, fewer, alike = tied
        among = (F.col("__tie") <= last) if fewer + alike <= n - below else (F.col("__tie") < last)
        goes = (F.col("__depth") < cut) | (F.col("__depth") == cut) & among
    stays = ~F.coalesce(goes, F.lit(False))
    return marked.where(stays if keep is None else stays | keep).drop("__depth", "__tie")
