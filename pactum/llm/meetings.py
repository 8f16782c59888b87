"""Documents of one cluster that meet in blocks of bounded size, and the components that their links make."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.components import components, narrow
from pactum.llm.storage import broadcast_if_small, written

#: Narrow rows that may be broadcast, so that texts stay where they are.
MAX_BROADCAST = 200_000
#: Members that meet their pivot in one group.
STAR = 512


def block_links(placed: DataFrame, texts: DataFrame, links: Callable[[pa.Table], pa.Table], body: str, block: int, block_units: int, met_up_to: int = 2) -> DataFrame:
    """Links (u, v) between different components of one cluster: ``placed(set_id, n, comp, cluster)``.

    ``links`` finds them among the rows (set_id, comp, ``body``) of two blocks.  A component of a whole block or
    more has blocks of its own, smaller ones share blocks; blocks have about ``block`` documents and
    ``block_units`` units (n) at most, or one document, so that long texts do not meet by the hundred.  Pairs
    of blocks meet unless both are of one component, so a text is copied once for each block of its
    cluster.  The documents of a cluster of ``met_up_to`` or fewer have met.
    """
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("c"), F.greatest(F.count("*") / block, F.sum("n") / block_units).alias("fill"))
    sizes = sizes.withColumn("own", F.col("fill") >= 1)
    rest = sizes.groupBy("cluster").agg(F.sum(F.when(~F.col("own"), F.col("fill"))).alias("small"), F.count("*").alias("comps"), F.sum("c").alias("all"))
    # A cluster of one component, or of documents that have met, is settled.
    shape = sizes.join(rest.where(f"comps > 1 AND all > {met_up_to}").select("cluster", "small"), "cluster")
    spot = F.when(
        F.col("own"), F.concat(F.lit("c"), F.hex("comp"), F.lit(":"), F.pmod(F.xxhash64("set_id"), F.ceil("fill")).cast("string"))
    ).otherwise(F.concat(F.lit("s:"), F.pmod(F.xxhash64("comp"), F.ceil("small")).cast("string")))
    dealt = placed.join(shape, ["cluster", "comp"]).select("cluster", "comp", "set_id", spot.alias("block"), F.when(F.col("own"), F.col("comp")).alias("whole"))
    n = placed.count()
    dealt = written(narrow(dealt, n), "dealt")
    blocks = written(narrow(dealt.select("cluster", "block", "whole").distinct(), n), "blocks")
    one = blocks.select("cluster", F.col("block").alias("i"), F.col("whole").alias("whole_i"))
    two = blocks.select("cluster", F.col("block").alias("j"), F.col("whole").alias("whole_j"))
    met = one.join(two, "cluster").where("i <= j AND NOT coalesce(whole_i = whole_j, false)")
    meetings = written(narrow(met.select("cluster", "i", "j"), n, 20_000), "meetings")
    sides = meetings.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = broadcast_if_small(dealt.join(sides, ["cluster", "block"]).drop("block", "whole"), MAX_BROADCAST)
    rows = rows.join(texts, "set_id").select("cluster", "i", "j", "set_id", "comp", body)
    kind = placed.schema["set_id"].dataType.simpleString()
    # As many tasks as meetings are worth: they take time, not bytes, which is what Spark would go by.
    parts = max(1, min(meetings.count(), 4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(parts, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(links, f"u {kind}, v {kind}")


def stars(pairs: DataFrame, texts: DataFrame, body: str) -> DataFrame:
    """(a, set_id, ``body``) of all ``pairs(a, b)``, dealt and sorted so that a's own row stands before those of its b's.

    A text is moved once for each pair that it is b of, a's text once for up to STAR or so of its pairs; a pivot
    of any number of pairs is dealt to many tasks.  Where a new group begins, set_id is a.
    """
    sized = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups")), "pivots")
    members = pairs.join(broadcast_if_small(sized, MAX_BROADCAST), "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.col("b").alias("set_id"))
    own = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("a").alias("set_id"))
    rows = broadcast_if_small(written(members.unionByName(own), "stars"), MAX_BROADCAST)
    full = rows.join(texts.select("set_id", body), "set_id")
    return full.repartition("a", "part").sortWithinPartitions("a", "part", F.col("set_id") != F.col("a")).select("a", "set_id", body)


def with_component(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` with the component ``comp`` of its set_id, itself where it has no link yet."""
    own = labels.select(F.col("node").alias("set_id"), F.col("comp").alias("c"))
    return df.join(own, "set_id", "left").withColumn("comp", F.coalesce("c", "set_id")).drop("c")


def relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining the components that ``edges`` link."""
    top = labels.select(F.col("node"), F.col("comp"))

    def lifted(df: DataFrame, c: str) -> DataFrame:
        own = top.select(F.col("node").alias(c), F.col("comp").alias("t"))
        return df.join(own, c, "left").withColumn(c, F.coalesce("t", c)).drop("t")

    joined = written(components(lifted(lifted(edges, "u"), "v")), "joined")
    over = joined.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = labels.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = joined.join(labels, "node", "left_anti").select("node", "comp")
    return written(narrow(old.unionByName(new), labels.count()), "labels")
