"""Ranks, prefix sums, exact selections and reproducible draws, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.sources.work import materialised


def prefix_sums(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """``df`` with ``before_<s>``: the sum of ``s`` over rows of smaller ``order``, which must be distinct.

    Rows are range-partitioned by ``order`` and written; sums run within each partition, and the totals of
    the partitions before it (one row each) are added.
    """
    parted = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    fixed = materialised(parted, "ranges")
    totals = fixed.groupBy("__part").agg(*[F.sum(s).alias(s) for s in sums]).collect()
    run, offsets = [0] * len(sums), []
    for row in sorted(totals, key=lambda r: r["__part"]):
        offsets.append((row["__part"], *run))
        run = [a + (row[s] or 0) for a, s in zip(run, sums, strict=True)]
    kinds = dict(df.dtypes)
    schema = "__part int, " + ", ".join(f"__off_{s} {'double' if kinds[s] in ('double', 'float') else 'long'}" for s in sums)
    start = df.sparkSession.createDataFrame(offsets, schema)
    upto = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = fixed.select("*", *[F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"__run_{s}") for s in sums])
    out = out.join(F.broadcast(start), "__part")
    return out.select(*[F.col(c) for c in df.columns], *[(F.col(f"__run_{s}") + F.col(f"__off_{s}")).alias(f"before_{s}") for s in sums])


def with_previous(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before, in ``order``, among those of the same ``group``; null for its first.

    Rows are range-partitioned by group and order, so a group of any size lies in as many partitions as it fills, side by
    side.  Within a partition the previous row is found by a window; the first row of a group there takes its
    from the last row of the nearest partition before, if that is of the group too: one row for a partition is
    all that is carried over.  Nulls are a group, and come first in the order, of which ``order`` must leave no ties.
    """
    parted = df.repartitionByRange(*[F.col(f"`{c}`") for c in (group, *order)]).withColumn("__part", F.spark_partition_id())
    fixed = materialised(parted, "ranges")
    last = F.max_by(F.struct(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").alias("v")), F.struct(*[F.col(f"`{c}`") for c in (group, *order)])).alias("last")
    ends = sorted(fixed.groupBy("__part").agg(last).collect(), key=lambda r: r["__part"])
    carried = [(b["__part"], a["last"]["g"], a["last"]["v"]) for a, b in zip(ends, ends[1:], strict=False)]
    kinds = df.schema
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__carry_group", kinds[group].dataType), T.StructField("__carry", kinds[value].dataType)])
    carry = df.sparkSession.createDataFrame(carried, schema)
    there = Window.partitionBy("__part", group).orderBy(*[F.col(f"`{c}`") for c in order])
    out = fixed.withColumns({"__nth": F.row_number().over(there), name: F.lag(f"`{value}`").over(there)}).join(F.broadcast(carry), "__part", "left")
    goes_on = (F.col("__nth") == 1) & F.col(f"`{group}`").eqNullSafe(F.col("__carry_group")) & (F.col("__part") > F.lit(ends[0]["__part"] if ends else 0))
    return out.withColumn(name, F.when(goes_on, F.col("__carry")).otherwise(F.col(name))).select(*[F.col(f"`{c}`") for c in df.columns], name)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(``value``, rank): the average rank, from 1, of every distinct non-null value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    summed = prefix_sums(counts, value, ["__n"])
    return summed.select(value, (F.col("before___n") + (F.col("__n") + 1) / 2).alias("rank"))


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` as ``name``; null for null."""
    ranks = average_ranks(df, value).withColumnsRenamed({value: "__value", "rank": name})
    return df.join(ranks, df[value] == ranks["__value"], "left").drop("__value")


def uniform(seed: int, label: str, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed, the label and the keys alone."""
    bits = F.xxhash64(F.lit(int(seed)), F.lit(label), *keys).bitwiseAND(F.lit((1 << 53) - 1))
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _bits(seed: int, label: str, *keys: Column | str) -> Column:
    """52 bits of the MD5 of "seed:label:key": any engine gives the same ones.  A null key counts as empty text."""
    text = F.concat_ws(":", F.lit(str(int(seed))), F.lit(label), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def drawn(seed: int, label: str, *keys: Column | str) -> Column:
    """A number in (0, 1) like :func:`uniform`, from MD5: slower, but one that SQL elsewhere can repeat."""
    return (_bits(seed, label, *keys).cast("double") + 0.5) / F.lit(float(1 << 52))


def proportional(df: DataFrame, columns: list[str], max_rows: int, seed: int, label: str) -> DataFrame:
    """(``columns``, copy): at most about ``max_rows`` rows, in which every row of the table has the same chance.

    Equal rows are counted first and get their share of the places, rounded up or down by an MD5 draw of
    their values, so that the sample is the same for any partitioning and a common row is as common in it.
    A table of up to ``max_rows`` rows is taken whole.
    """
    counts = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    places = F.col("__n") if total <= max_rows else F.floor(F.col("__n") * F.lit(max_rows / total) + drawn(seed, label, *columns))
    return counts.withColumn("__places", places.cast("int")).where("__places > 0").select(*columns, F.explode(F.sequence(F.lit(1), "__places")).alias("copy"))


def exactly(df: DataFrame, n: int, seed: int, label: str, key: str, among: Column | None = None) -> Column:
    """A Column that is true for exactly ``n`` of the rows that ``among`` allows (all of them, if fewer).

    The rows of the ``n`` smallest MD5 draws of (seed, label, key) are chosen, ties by key; ``key`` must be
    distinct.  The cut is found by sums over 4096 bins and, within the bin that it falls in, over a second
    4096, so that only a few rows are ever sorted.
    """
    allowed = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    draw = _bits(seed, label, key)
    if n <= 0:
        return F.lit(False)
    rows = df.where(allowed).select(draw.alias("h"), F.col(key).alias("k"))
    low, left = None, n
    for shift in (40, 28):
        part = rows if low is None else rows.where((F.col("h") >= low[0]) & (F.col("h") <= low[1]))
        bins = sorted((r[0], r[1]) for r in part.groupBy(F.shiftright("h", shift).alias("b")).count().collect())
        for b, c in bins:
            if c >= left:
                low = (b << shift, (b << shift) + (1 << shift) - 1)
                break
            left -= c
        else:
            return allowed
    last = rows.where((F.col("h") >= low[0]) & (F.col("h") <= low[1])).orderBy("h", "k").limit(left).collect()
    h, k = last[-1]
    return allowed & ((draw < h) | ((draw == h) & (F.col(key) <= F.lit(k))))


def nth_smallest(df: DataFrame, column: str, n: int) -> tuple[int, int, int] | None:
    """(value, rows below it, rows that have it): the ``n``-th smallest, from 1, of a column of longs; None if there are fewer.

    Four passes count rows by 16 more bits of the value each, so at most 65 536 counts come to the driver, and nothing is sorted.
    """
    rows, below = df.where(F.col(column).isNotNull()), 0
    count = 0
    for shift in (48, 32, 16, 0):
        bins = sorted((r["b"], r["count"]) for r in rows.groupBy(F.shiftright(column, shift).alias("b")).count().collect())
        for b, count in bins:
            if below + count >= n:
                break
            below += count
        else:
            return None
        rows = rows.where(F.shiftright(column, shift) == b)
    return b, below, count


#: The published coefficients of Acklam's approximation of the normal quantile.
ACKLAM = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0],
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, by Acklam's rational approximation (relative error below 1.2e-9)."""
    a, b, c, d = ACKLAM

    def poly(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    middle = p - 0.5
    square = middle * middle
    central = middle * poly(a, square) / poly(b, square)

    def tail(x: Column) -> Column:
        q = F.sqrt(-2 * F.log(x))
        return poly(c, q) / poly(d, q)

    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(central)
