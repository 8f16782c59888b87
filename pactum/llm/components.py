"""Connected components of an edge table, by contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.storage import drop, written

#: Rows of a narrow table that are worth a partition of their own.
ROWS_A_PART = 100_000


def narrow(df: DataFrame, rows: int, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``df`` in at most as many partitions as ``rows`` rows are worth; large tables keep theirs."""
    parts = rows // rows_a_part + 1
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(parts) if parts < default else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(u, v)``: comp is the smallest node that it reaches.

    In each round every node moves to its smallest neighbour, or stays if it is smaller, and the edges are
    drawn between the places moved to; all edges of a component are gone when all of it has met.  Nodes
    should be in random order, as digests are: then each round leaves a fraction of the nodes, so that
    rounds grow with the logarithm of a component's size.

    Hub nodes are never gathered: neighbours are only aggregated to a minimum and joined back.  Self-loops
    and repeated edges are harmless; nodes without edges are not returned.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    moves: list[DataFrame] = []
    while rows := now.count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        move = written(narrow(least, 2 * rows), "moves")
        one = now.join(move.select("u", F.col("m").alias("a")), "u")
        two = one.join(move.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
        drawn = two.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        after = written(narrow(drawn, rows), "edges")
        drop(now)
        now = after
        moves.append(move)
    if not moves:
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = moves[0].select(F.col("u").alias("node"), F.col("m").alias("comp"))
    for move in moves[1:]:
        out = out.join(move, F.col("comp") == F.col("u"), "left").select("node", F.coalesce("m", "comp").alias("comp"))
    return out
