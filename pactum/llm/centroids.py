"""Exact Lloyd clustering of integer vectors, with bounds tightened by geometry.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of that to any other.
When centroids move, the usual loosening of the lower bound is the whole drift of the farthest mover.  Here
each cluster's sphere (its centroid, and the radius that holds its vectors) is set against each moved
centroid: how much nearer a point of the sphere can come to it is a question in the plane of three points,
and mostly answered by far less than the drift.  Vectors whose bounds then leave no doubt keep their cluster
without a look at their components; the ambiguous ones are scanned exactly, in integers.

Vectors lie in blocks, bucketed by block like the bounds, so that a round joins both without a shuffle,
writes new bounds only, and adds up only what vectors that changed their cluster bring and take.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm import bitslice, storage

#: Vectors of a block, and bytes of blocks in a bucket, about.
BLOCK_ROWS, BUCKET_BYTES = 1024, 16_000_000
#: Components must be smaller, so that squared distances fit 63 bits.
MAX_COMPONENT = 2**27
#: Relative slack of bounds, far above the rounding of what they are made of, and that of the planar geometry.
SLACK, PLANE_SLACK = 1e-12, 1e-6


def approach(own: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """The most by which a point within ``radius`` of ``own`` can get nearer to a centroid that moves from ``before`` to ``after``.

    Negative if all such points get farther from it.  Turning a point about the line of the move into the
    half-plane of ``own`` keeps both its distances and brings it no farther from ``own``, so the plane decides.  There, with
    the line's middle as origin and half the move as unit, a point at (x, y), rho from the origin, gets nearer by
    4x / (d1 + d2), with 2 max(1, rho) <= d1 + d2 <= 2 sqrt(1 + rho^2) for its distances to both ends: thus by at most 2x and at most
    twice the cosine of its angle, both largest where the sphere's edge is.
    """
    move = after - before
    drift = math.sqrt(float((move.astype(object) ** 2).sum()))
    if drift == 0:
        return 0.0
    away = 2.0 * own.astype(np.float64) - before - after  # twice the way from the middle
    x = float(away @ move) / (drift * drift)
    rho = math.sqrt(float(away @ away)) / drift
    y = math.sqrt(max(0.0, rho * rho - x * x))
    r = 2.0 * radius / drift
    if x + r < 0:
        share = (x + r) / math.hypot(1.0, rho + r)
    elif rho > r and not (x > 0 and y <= r):
        share = max(0.0, min((x * math.sqrt(rho * rho - r * r) + y * r) / (rho * rho), x + r, 1.0))
    else:
        share = min(x + r, 1.0)
    return drift * min(1.0, share + PLANE_SLACK) * (1 + SLACK) if share > -PLANE_SLACK else drift * (share + PLANE_SLACK)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster: what its vectors' upper bounds gain, what their lower bounds lose, and half the way to the nearest other centroid."""
    k = len(before)
    drift = np.array([math.sqrt(float(((a - b).astype(object) ** 2).sum())) for a, b in zip(after, before, strict=True)]) * (1 + SLACK)
    loss, half = np.full(k, -np.inf), np.full(k, np.inf)
    for i in range(k):
        for j in range(k):
            if i != j:
                loss[i] = max(loss[i], approach(before[i], float(radius[i]), before[j], after[j]))
                half[i] = min(half[i], math.sqrt(float(((after[i] - after[j]).astype(object) ** 2).sum())) / 2 * (1 - SLACK))
    return drift, np.where(np.isfinite(loss), loss, 0.0), half


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of 64-bit integer rows and one centre, or one for each row."""
    gap = rows - centre
    return np.einsum("ij,ij->i", gap, gap)


def scan(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, ties to the smaller number; upper bound of its distance; lower bound of the second's)."""
    best, first = np.zeros(len(rows), np.int32), np.full(len(rows), np.iinfo(np.int64).max)
    second = first.copy()
    for j, c in enumerate(centroids):
        d = squared(rows, c)
        nearer = d < first
        second = np.where(nearer, first, np.minimum(second, d))
        best[nearer] = j
        first = np.where(nearer, d, first)
    return best, np.sqrt(first.astype(np.float64)) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK)


def _blocks(kept: DataFrame, dims: int, buckets: int) -> tuple[DataFrame, str]:
    """Vectors in blocks (block, ids, vecs), bucketed by block: (table, name)."""
    kind = kept.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = bitslice._matrix(part.column(1)).reshape(part.num_rows, dims).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([rows.tobytes()], pa.binary())], names=["block", "ids", "vecs"])
                block += 1

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("vecs", T.BinaryType())])
    return storage.bucketed(kept.mapInArrow(work, schema).repartition(buckets, "block"), "vectors", "block", buckets)


def cluster(
    rows: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    factor: float = 1024.0,
    seed: int | str = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    stats: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """The cluster of every vector: ``id_col``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``dims`` components, none null or non-finite, take part, as integers floor(factor * c);
    a component of 2^27 or more raises an error, as squared distances would not fit 63 bits.  Centroids start as the
    ``k`` rows of smallest sha256 of "seed:id" (null ids last, ties by vector), so repeated rows may be
    equal centroids, of which the smaller number takes all; with fewer than ``k`` rows there are as many clusters.
    A round assigns every vector to its nearest centroid (ties: smaller number) and replaces those of
    non-empty clusters by floor(sum / count); the last assignment follows ``rounds`` rounds.  Null and
    repeated ids and repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.

    ``stats``, if given, gets (vectors, those scanned exactly) of every assignment.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    x = bitslice.quantised(F.col(vec_col), factor)
    kept = rows.where(F.size(vec_col) == dims).select(F.col(id_col).alias("id"), x.alias("x")).where("x IS NOT NULL")
    most, n = kept.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))), F.count("*")).first()
    out_fields = [T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    if n == 0:
        more = [T.StructField(c, t) for c, t in (("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))]
        return spark.createDataFrame([], T.StructType(out_fields + more))
    if most >= MAX_COMPONENT:
        raise ValueError(f"component {most}: must be below {MAX_COMPONENT}")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    k = len(centroids)

    buckets = max(1, math.ceil(n * dims * 4 / BUCKET_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / BLOCK_ROWS)))
    vectors, vectors_name = _blocks(kept, dims, buckets)
    state: tuple[DataFrame, str] | None = None
    sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    moved = (np.zeros(k), np.zeros(k), np.zeros(k))

    def assigned(at: dict, centroids: np.ndarray, moved: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(vectors, old clusters or None, new ones, upper and lower bounds, number of those scanned) of one block."""
        x = np.frombuffer(at["vecs"].as_buffer(), dtype=np.int32).reshape(-1, dims)
        if "cluster" not in at:
            new, upper, lower = scan(x.astype(np.int64), centroids)
            return x, None, new, upper, lower, len(x)
        old = np.frombuffer(at["cluster"].as_buffer(), dtype=np.int32)
        drift, loss, half = moved
        upper = np.frombuffer(at["upper"].as_buffer(), dtype=np.float64) + drift[old]
        lower = np.frombuffer(at["lower"].as_buffer(), dtype=np.float64) - loss[old]
        # Bounds have slack beyond their rounding, which the sums of drifts over the rounds stay far within.
        open_ = np.flatnonzero(~(upper * (1 + SLACK) < np.maximum(lower, half[old])))
        new = old.copy()
        if len(open_):
            new[open_], upper[open_], lower[open_] = scan(x[open_].astype(np.int64), centroids)
        return x, old, new, upper, lower, len(open_)

    def met() -> DataFrame:
        return vectors if state is None else vectors.join(state[0].select("block", "cluster", "upper", "lower"), "block")

    for _ in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids, moved: tuple[np.ndarray, ...] = moved) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    at = {name: batch.column(c)[row] for c, name in enumerate(batch.schema.names)}
                    x, old, new, upper, lower, scanned = assigned(at, centroids, moved)
                    gain = np.zeros((k, dims + 1), dtype=np.int64)
                    changed = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
                    wide = np.concatenate([x[changed].astype(np.int64), np.ones((len(changed), 1), np.int64)], axis=1)
                    np.add.at(gain, new[changed], wide)
                    if old is not None:
                        np.subtract.at(gain, old[changed], wide)
                    radius = np.zeros(k)
                    np.maximum.at(radius, new, upper)
                    # The last ones are radii, rounded up, and of which the largest counts; and numbers of vectors.
                    tell = np.concatenate([gain.ravel(), np.ceil(radius).astype(np.int64), [len(x), scanned]])
                    made = [pa.array([v.tobytes()], pa.binary()) for v in (new, upper, lower)]
                    yield pa.RecordBatch.from_arrays([pa.array([at["block"].as_py()], pa.int64()), *made, pa.array([tell], pa.list_(pa.int64()))], names=["block", "cluster", "upper", "lower", "tell"])

        cols = ["block", "vecs"] + ([] if state is None else ["cluster", "upper", "lower"])
        made = met().select(cols).mapInArrow(work, "block long, cluster binary, upper binary, lower binary, tell array<long>")
        nextly = storage.bucketed(made, "bounds", "block", buckets)
        if state is not None:
            storage.drop_bucketed(*state)
        state = nextly
        told = state[0].select(F.posexplode("tell")).groupBy("pos").agg(F.sum("col"), F.max("col")).collect()
        total = np.zeros(k * (dims + 1) + k + 2, dtype=np.int64)
        for pos, s, largest in told:
            total[pos] = largest if k * (dims + 1) <= pos < k * (dims + 2) else s
        gain = total[: k * (dims + 1)].reshape(k, dims + 1)
        sums, counts = sums + gain[:, :dims], counts + gain[:, dims]
        if stats is not None:
            stats.append((int(total[-2]), int(total[-1])))
        after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved = loosening(centroids, after, total[k * (dims + 1) : -2])
        centroids = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(c)[row] for c, name in enumerate(batch.schema.names)}
                x, _, new, _, _, _ = assigned(at, centroids, moved)
                ids = batch.column(batch.schema.get_field_index("ids")).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.int32()), pa.array(squared(x.astype(np.int64), centroids[new]))], names=[id_col, "cluster", "distance"])

    found = storage.written(met().mapInArrow(last, T.StructType(out_fields)), "clusters")
    storage.drop_bucketed(vectors, vectors_name)
    if state is not None:
        storage.drop_bucketed(*state)
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, inertia[j], sum(inertia.values()), digest[j]) for j in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
