"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.storage import broadcast_if_small, drop, written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which one row for each of them is broadcast.
MAX_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``, the words to take from each source.

    Sources in code point order, null last, weigh ``weights`` in turn.  They share ``share`` of all words by
    weight, each at most ``max_repeat`` times its size; what is above a source's limit goes to the others
    by weight, until none is above.  The windows go over one row for each source.
    """
    by_name, everyone = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    out = out.withColumn("limit", F.lit(float(max_repeat)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.lit(float(share)) * F.sum("source_size").over(everyone) - spent
    level = left / F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("k", F.row_number().over(by_limit)).withColumn("level", level)
    # The first source that stays within its limit, and all after it, get their weight's part.
    fits = F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.struct("k", "level"))
    out = out.withColumn("first", F.min(fits).over(everyone))
    target = F.when(F.col("k") >= F.col("first.k"), F.col("weight") * F.col("first.level")).otherwise(F.col("limit"))
    return out.select("source", "source_size", target.alias("target"))


def _rates(hist: DataFrame, stats: DataFrame) -> DataFrame:
    """(rate_source, rate, certain): the chance of an extra copy for each word of a document, and the words of certain ones.

    ``hist(source, size, c)``: how many documents have a size.  From the largest size down, documents whose
    chance would be above 1 are certain and their words leave the rest; the others share what is left in
    proportion to size, so that the expected words are the rest.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = F.col("size") * F.col("c"), F.col("size").cast("double") * F.col("size") * F.col("c")
    certain = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(squares).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = _with_source(hist.where("size > 0"), stats.select(F.col("source").alias("own"), "rest"), "own")
    both = both.withColumn("certain", certain.cast("double")).withColumn("rate", (F.col("rest") - F.col("certain")) / below)
    found = both.where(F.col("rate") * F.col("size") <= 1).groupBy(F.col("source").alias("rate_source"))
    return found.agg(F.max_by("rate", "size").alias("rate"), F.max_by("certain", "size").alias("certain"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: str = "mix",
    bins: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of every document: doc_id, source, size, source_size, target, copies, taken.

    Sources in code point order, null last, weigh ``weights`` in turn.  With r = target / source_size,
    every document gets floor(r) certain copies.  The rest of the target is a Pareto order sample: a
    document's chance of one more copy is proportional to its size (at most 1, and such that the
    expected words are the rest), documents are ranked by random odds over inclusion odds, and the
    first in that order are taken up to the rest, to the nearest document.

    The random number of a document is a hash of ``seed`` and its id, so reruns agree.  A text that is
    null or has no words has size 0 and gets the certain copies only; a null id is ranked like any id; rows that
    repeat an id are separate documents with one random number.  Ties go to the smaller id, then the
    smaller size.  An empty table gives an empty result; other columns play no part.

    The cut is found by two rounds of binned sums (``bins`` bins for each source), so that only the
    rows of one bin in ``bins`` squared are ever sorted.  Nothing but counts comes to the driver.
    """
    size = word_count(F.col(text_col))
    base = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    hist = written(base.groupBy("source", "size").agg(F.count("*").alias("c")), "histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    stats = targets(sizes, weights, share, max_repeat).withColumn("whole", whole)
    stats = written(stats.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    stats = _with_source(stats, _rates(hist, stats), "rate_source", "left")
    known = _with_source(base, stats.withColumnRenamed("source", "stats_source"), "stats_source")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    chance = F.coalesce("rate", F.lit(float("inf"))) * F.col("size")
    ranked = known.withColumn("drawn", F.when((F.col("size") > 0) & (F.col("rest") > 0), chance < 1))
    ranked = ranked.withColumn("key", F.when(F.col("drawn"), (u / (1 - u)) / (chance / (1 - chance))))
    ranked = ranked.withColumn("p", F.col("key") / (1 + F.col("key")) * bins)
    ranked = ranked.withColumn("b1", F.floor("p")).withColumn("b2", F.floor((F.col("p") - F.col("b1")) * bins))
    ranked = written(ranked, "ranked")
    for t in (base, hist):
        drop(t)
    one = _cut(ranked, ["b1"], F.coalesce("certain", F.lit(0.0)))
    first = _joined(ranked, one, ["c1", "before1"])
    two = _cut(first.where("b1 = c1"), ["b2"], F.col("before1"))
    both = _joined(first, two, ["c2", "before2"])
    at_cut = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    both = both.withColumn("at_cut", F.coalesce(at_cut, F.lit(False)))
    # Documents that are not drawn are certain, or get nothing; no cut in a source or bin means that all of it fits.
    inside = F.when(F.col("key").isNull(), F.coalesce(~F.col("drawn"), F.lit(False))).when(F.col("c1").isNull(), True).when(F.col("b1") != F.col("c1"), F.col("b1") < F.col("c1")).when(F.col("c2").isNull(), True).otherwise(F.col("b2") < F.col("c2"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mid = F.coalesce("before2", F.lit(0.0)) + F.sum("size").over(order) - F.col("size") / 2
    edge = both.where("at_cut").withColumn("more", mid <= F.col("rest"))
    chosen = both.where("NOT at_cut").withColumn("more", inside).unionByName(edge)
    copies = F.col("whole") + F.col("more").cast("long")
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _cut(rows: DataFrame, bin_cols: list[str], start: Column) -> DataFrame:
    """For each source the bin in which the running words pass the rest, and the words before it."""
    sums = rows.where("key IS NOT NULL").groupBy("source", "rest", start.alias("start"), *bin_cols).agg(F.sum("size").alias("w"))
    upto = Window.partitionBy("source").orderBy(*bin_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("end", F.col("start") + F.sum("w").over(upto)).withColumn("before", F.col("end") - F.col("w"))
    return run.where("before <= rest AND end > rest").select("source", F.col(bin_cols[0]).alias("bin"), "before")


def _joined(rows: DataFrame, cut: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the cut of their source (one row for each source at most)."""
    small = cut.select(F.col("source").alias("cut_source"), F.col("bin").alias(names[0]), F.col("before").alias(names[1]))
    return _with_source(rows, small, "cut_source", "left")


def _with_source(rows: DataFrame, per: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the row of their source, null being a source; broadcast if the sources are few."""
    return rows.join(broadcast_if_small(per, MAX_BROADCAST), rows["source"].eqNullSafe(per[key]), how).drop(key)
