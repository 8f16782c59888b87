"""Exact top-k inner products on a bit-sliced index.

A block of rows is held as bit slices: for every attribute and bit, a bitmap over the rows.  For a query
the slices are added with bitmap arithmetic (carry-save adders), weighted by the signed digits of the
query's components; the result is a bit-sliced sum.  The top rows are then found from its most
significant slice downward, and rows that tie at the boundary are resolved by their id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of a block of rows or queries, about.
BLOCK_BYTES = 4_000_000


def quantised(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long")))


def build_slices(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps [attribute, bit, word], offset): the slices of rows - offset, which are not negative."""
    offset = int(min(rows.min(initial=0), 0))
    shifted = (rows - offset).astype(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = max(1, -(-len(rows) // 64))
    out = np.zeros((rows.shape[1], bits, words), dtype=np.uint64)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b].view(np.uint8)[:, : packed.shape[1]] = packed
    return out, offset


def _signed_digits(value: int) -> list[tuple[int, int]]:
    """(position, +1 or -1) of the non-adjacent form: the fewest signed powers of two that give ``value``."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


def add_slices(slices: np.ndarray, negated: np.ndarray, query: list[int]) -> tuple[list[np.ndarray], int]:
    """(result slices from the least significant, constant): their sum is the inner product of every row and the query.

    A negative digit adds the negated bitmap: -p = (1 - p) - 1.
    """
    levels: list[list[np.ndarray]] = [[]]
    constant = 0
    for d, q in enumerate(query):
        for at, sign in _signed_digits(q):
            for b in range(slices.shape[1]):
                while len(levels) <= at + b:
                    levels.append([])
                levels[at + b].append(slices[d, b] if sign > 0 else negated[d, b])
            if sign < 0:
                constant -= ((1 << slices.shape[1]) - 1) << at
    out, k = [], 0
    while k < len(levels):
        level = levels[k]
        if len(level) > 1 and k + 1 == len(levels):
            levels.append([])
        while len(level) > 2:
            a, b, c = level.pop(), level.pop(), level.pop()
            odd = a ^ b
            carry = a & b
            carry |= odd & c
            odd ^= c
            level.insert(0, odd)
            levels[k + 1].append(carry)
        if len(level) == 2:
            a, b = level
            levels[k + 1].append(a & b)
            level[:] = [a ^ b]
        out.append(level[0] if level else np.zeros(slices.shape[2], np.uint64))
        k += 1
    return out, constant


def top_rows(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest rows among ``allowed``, ties to the smaller position."""
    sure, open_ = np.zeros_like(allowed), allowed
    for plane in reversed(sums):
        trial = sure | (open_ & plane)
        n = int(np.bitwise_count(trial).sum())
        if n > k:
            open_ = open_ & plane
        else:
            sure = trial
            open_ = open_ & ~plane
            if n == k:
                return _positions(sure)
    found = _positions(sure)
    return np.concatenate([found, _positions(open_)[: k - len(found)]])


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A matrix of the lists, the shorter ones padded with zeros."""
    chunk = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(chunk.offsets.to_numpy())
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), dtype=np.int64)
    out[np.arange(wide)[None, :] < lengths[:, None]] = flat
    return out


def _index_block(key: tuple, table: pa.Table) -> pa.Table:
    order = table.sort_by("id")
    rows = _matrix(order["vec"])
    slices, offset = build_slices(rows)
    cols = {
        "r": pa.array([key[0].as_py()], pa.int32()),
        "dims": pa.array([rows.shape[1]], pa.int32()),
        "bits": pa.array([slices.shape[1]], pa.int32()),
        "low": pa.array([offset], pa.int64()),
        "ids": pa.array([order["id"].combine_chunks().to_numpy().tobytes()], pa.binary()),
        "slices": pa.array([slices.tobytes()], pa.binary()),
    }
    return pa.table(cols)


def _query_block(key: tuple, table: pa.Table) -> pa.Table:
    rows = _matrix(table["vec"])
    cols = {
        "c": pa.array([key[0].as_py()], pa.int32()),
        "query_ids": pa.array([table["id"].combine_chunks().to_numpy().tobytes()], pa.binary()),
        "query_dims": pa.array([rows.shape[1]], pa.int32()),
        "queries": pa.array([rows.tobytes()], pa.binary()),
    }
    return pa.table(cols)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The ``k`` highest integer inner products of every query: query_id, rank, vec_id, score.

    Both tables have ``id`` (long) and ``vec`` (array of long).  A query meets every row but those with
    its own id; it gets all of them if they are fewer than ``k``.  Ties go to the smaller id.  Rows with
    a null id or vector take no part; shorter vectors count as padded with zeros; a query id that is
    repeated is asked once, with its least vector.  Inner products must fit 63 bits.  Empty tables give
    an empty result.

    Rows are dealt into blocks of about ``row_block``, each indexed once; every block of queries meets
    every block of rows in a task of its own, which returns ``k`` rows for a query.  By default a block
    of either kind has up to BLOCK_BYTES bytes at 8 bits a component, so that an index block is copied for
    tens of thousands of queries at a time; queries are dealt finer only where there would be fewer tasks
    than shuffle partitions.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    vectors = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    queries = queries.where("id IS NOT NULL AND vec IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec"))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    fit = max(64, BLOCK_BYTES // max(dims or 1, 1))
    row_blocks = max(1, math.ceil(n / (row_block or fit)))
    asked_n = queries.count()
    wanted = math.ceil(2 * int(spark.conf.get("spark.sql.shuffle.partitions")) / row_blocks)
    query_blocks = max(1, math.ceil(asked_n / (query_block or max(64, min(fit, math.ceil(asked_n / wanted))))))
    index = (
        vectors.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int"))
        .groupBy("r")
        .applyInArrow(_index_block, "r int, dims int, bits int, low long, ids binary, slices binary")
    )
    asked = (
        queries.withColumn("c", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(query_blocks)).cast("int"))
        .groupBy("c")
        .applyInArrow(_query_block, "c int, query_ids binary, query_dims int, queries binary")
    )
    left = index.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    met = left.join(right.hint("shuffle_merge"), ["r", "c"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                ids = np.frombuffer(at["ids"].as_buffer(), dtype=np.int64)
                slices = np.frombuffer(at["slices"].as_buffer(), dtype=np.uint64).reshape(at["dims"].as_py(), at["bits"].as_py(), -1)
                negated = ~slices
                low = at["low"].as_py()
                asked_ids = np.frombuffer(at["query_ids"].as_buffer(), dtype=np.int64)
                asked_rows = np.frombuffer(at["queries"].as_buffer(), dtype=np.int64).reshape(len(asked_ids), -1)
                everyone = np.zeros(slices.shape[2] if slices.size else max(1, -(-len(ids) // 64)), dtype=np.uint64)
                full = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
                everyone.view(np.uint8)[: len(full)] = full
                out_q, out_v, out_s = [], [], []
                for qid, vec in zip(asked_ids, asked_rows, strict=True):
                    query = vec[: len(slices)].tolist()
                    sums, constant = add_slices(slices, negated, query)
                    allowed = everyone
                    first, last = np.searchsorted(ids, [qid, qid + 1])
                    if last > first:
                        allowed = everyone.copy()
                        for own in range(first, last):
                            allowed[own >> 6] &= _ONES ^ np.uint64(1 << (own & 63))
                    best = top_rows(sums, allowed, k)
                    score = np.full(len(best), constant + low * sum(query), dtype=np.int64)
                    for b, plane in enumerate(sums):
                        score += ((plane[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
                    out_q.append(np.full(len(best), qid))
                    out_v.append(ids[best])
                    out_s.append(score)
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    found = met.select("ids", "dims", "bits", "low", "slices", "query_ids", "queries").mapInArrow(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
