"""Near-duplicate documents by MinHash with tensored banding and exact verification.

Each distinct shingle set gets two small collections of ``tables`` sub-keys, each sub-key being
``rows`` minhashes.  Table keys are all pairs (sub-key of collection 1, sub-key of collection 2), so
``tables ** 2`` keys of ``2 * rows`` minhashes cost ``2 * tables * rows`` minhashes instead of
``2 * tables ** 2 * rows``.  A pair of similarity s is a candidate with probability
``(1 - (1 - s ** rows) ** tables) ** 2``: above 0.999 at s = 0.8 for the defaults.

Every link is confirmed on the full shingle sets, in two steps without a cap.  First each bucket's members
meet its least member, the pivot.  This settles all buckets whose members thereby come into one
component.  The others are joined to clusters, by the pivots that their members have a quarter of their
shingles in common with; the documents of a cluster that are not in one component yet meet in blocks of
bounded size, so that a cluster of any size is worked on in many tasks and no pair becomes a row.

Last, each bucket's members that its pivot does not settle meet among themselves.  Jaccard distance is a
metric: what is linked with a document that has KIN + 100 - ``percent`` percent in common with the pivot
has KIN percent in common with it too, so the two have met in the pivot's cluster.  All other members stay
in the bucket's rest, and all pairs of a rest in different components are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.components import components, narrow
from pactum.llm.meetings import block_links, relabel, stars, with_component
from pactum.llm.storage import broadcast_if_small, drop, written
from pactum.llm.words import Powers, mix, returning_memory, shingle_sets, slices, utf8

_U = np.uint64
#: Percent of shingles in common from which on a document belongs to its pivot's cluster.
KIN = 25
#: Documents and shingles in a block of a cluster, about.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Members of a bucket's rest up to which its pairs become rows (at most 3.5 a member).
FEW = 8
#: Rows of 8 to 40 bytes each that may be broadcast.
MAX_BROADCAST = 200_000


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int, tables: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, set_id (128-bit digest of the shingle set) and its sub-keys."""
    n = 2 * tables * rows
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    place = rng.integers(1, 2**63, (rows, 1), dtype=np.uint64) * _U(2) + _U(1)
    salt = rng.integers(1, 2**63, 2 * tables, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for start, stop in slices(offsets):
                own = offsets[start : stop + 1] - offsets[start]
                sets = shingle_sets(data[offsets[start] : offsets[stop]], own, width, powers)
                low = np.zeros((len(sets), n), dtype=np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        least = None
                        for at in range(0, len(s), 4096):
                            part = (a[:, None] * s[at : at + 4096][None, :] + b[:, None]).min(axis=1)
                            least = part if least is None else np.minimum(least, part)
                        low[i] = least
                keys = mix((mix(low).reshape(len(sets), 2 * tables, rows) @ place)[:, :, 0] + salt).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, 2 * tables * len(sets) + 1, 2 * tables, dtype=np.int32), keys.ravel()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "sub_keys"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        returning_memory(sketch), f"doc_id {kind}, n_shingles long, set_id binary, sub_keys array<long>"
    )


def _buckets(nodes: DataFrame, tables: int) -> DataFrame:
    """(key, set_id, n): the members of every table bucket with at least two distinct sets."""
    subs = nodes.select("set_id", F.posexplode("sub_keys").alias("slot", "val"))
    shared = written(subs.groupBy("val").agg(F.count("*").alias("c")).where("c > 1").select("val"), "shared")
    # Only sub-keys that another set has too can be part of a shared table key.
    alive = (
        subs.join(broadcast_if_small(shared, MAX_BROADCAST), "val", "left_semi")
        .groupBy("set_id")
        .agg(F.collect_list(F.when(F.col("slot") < tables, F.col("val"))).alias("one"), F.collect_list(F.when(F.col("slot") >= tables, F.col("val"))).alias("two"))
    )
    pair = F.flatten(F.transform("one", lambda x: F.transform(F.col("two"), lambda y: F.xxhash64(x, y))))
    keys = written(alive.select("set_id", F.explode(pair).alias("key")), "keys")
    full = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "full")
    sized = keys.join(full, "key", "left_semi")
    out = written(sized, "buckets")
    for t in (shared, keys, full):
        drop(t)
    return out


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` as (u, v) with 100 * intersection >= KIN * union, whether they reach ``percent`` and whether v is near u.

    What is linked with a near v has KIN percent in common with u.
    """
    kin = min(KIN, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, pivot = Powers(), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            data, at = utf8(batch.column(2))
            first = pc.equal(batch.column(0), batch.column(1)).to_numpy(zero_copy_only=False)
            share = np.zeros(batch.num_rows)
            linked, near = (np.zeros(batch.num_rows, dtype=bool) for _ in range(2))
            for start, stop in slices(at):
                for i, x in enumerate(shingle_sets(data[at[start] : at[stop]], at[start : stop + 1] - at[start], width, powers), start):
                    if first[i]:
                        pivot = x
                        continue
                    common = np.intersect1d(pivot, x, assume_unique=True).size
                    union = len(pivot) + len(x) - common
                    share[i] = 100 * common / max(union, 1)
                    linked[i] = 100 * common >= percent * union > 0
                    near[i] = 100 * common >= (kin + 100 - percent) * union > 0
            keep = pa.array(((share >= kin) | linked) & ~first)
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:2]), pa.array(linked).filter(keep), pa.array(near).filter(keep)], names=["u", "v", "linked", "near"])

    return stars(pairs, texts, "text").mapInArrow(returning_memory(compare), "u binary, v binary, linked boolean, near boolean")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all pairs of some sets, by products of their membership matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[which] > 1
    column, owner = number[which[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    step = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        member = np.zeros((len(sets), step), dtype=np.float32)
        member[owner[lo:hi], column[lo:hi] - first] = 1
        out += (member @ member.T).astype(np.int64)
    return out


def _links(width: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """The links between some texts of different components."""

    def links(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0))
        powers = Powers()
        sets = [x for a, b in slices(offsets) for x in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, powers)]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        common = _overlaps(sets)
        union = size[:, None] + size[None, :] - common
        comp = np.unique(np.array(table["comp"].to_pylist(), dtype=object), return_inverse=True)[1]
        u, v = np.nonzero(np.triu(100 * common >= percent * union, 1) & (comp[:, None] != comp[None, :]))
        ids = table["set_id"].combine_chunks()
        return pa.table({"u": ids.take(pa.array(u)), "v": ids.take(pa.array(v))}, schema=pa.schema([("u", pa.binary()), ("v", pa.binary())]))

    return links


def _rest_links(bucket: DataFrame, least: DataFrame, pairs: DataFrame, near: DataFrame, labels: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """Links (u, v) between members of one bucket, in different components, that are not near its pivot.

    Rests with the same members are compared once.  The pairs of small rests become rows, so that a pair of
    many rests is compared once; the documents of larger ones meet in blocks.
    """
    away = bucket.join(least, "key").where("set_id <> pivot").select("key", F.col("pivot").alias("u"), F.col("set_id").alias("v"))
    away = away.join(near, ["u", "v"], "left_anti").select("key", F.col("v").alias("set_id"))
    rest = written(narrow(with_component(away, labels), n), "rest")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "set_id")).alias(f"h{k}") for k in (1, 2)]
    sizes = rest.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("one"), F.max("comp").alias("two"), *marks).where("c > 1 AND one <> two")
    apart = written(narrow(sizes.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")), n), "apart")
    few = rest.join(apart.where(F.col("c") <= FEW), "key")
    one, two = (few.select("key", F.col("set_id").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    rows = one.join(two, "key").where("a < b AND comp_a <> comp_b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    meet = written(narrow(rows, n), "rest_pairs")
    out = written(_compared(meet, texts, width, percent).where("linked").select("u", "v"), "rest_links")
    many = apart.where(F.col("c") > FEW).select("key")
    if not many.isEmpty():
        placed = written(narrow(rest.join(many, "key").join(members.select("set_id", "n"), "set_id").select("set_id", "n", "comp", F.col("key").alias("cluster")), n), "rest_placed")
        more = written(block_links(placed, texts, _links(width, percent), "text", BLOCK, BLOCK_SHINGLES, 1), "rest_blocks")
        out = written(out.unionByName(more).distinct(), "rest_links")
        for t in (placed, more):
            drop(t)
    for t in (rest, apart, meet):
        drop(t)
    return out


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    tables: int = 12,
    rows: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns a row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach,
    itself included) and kept (doc_id = component_id).

    Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z as a-z; a text of fewer words
    than ``width`` is one shingle.  A text that is null or has no word has no shingles and is linked
    with nothing.  Equal sets are one node, so copies are never expanded into pairs; a document of any
    length is read whole.  A row with a null id is linked with nothing: its component_id is null and it
    is kept.  Rows that repeat an id each get their own row.  An empty table gives an empty result;
    columns other than the two named play no part.
    """
    base = written(sketches(docs, width, tables, rows, id_col, text_col), "sketches")
    nodes = written(
        base.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sub_keys").alias("sub_keys")),
        "nodes",
    )
    bucket = _buckets(nodes, tables)
    n = bucket.count()
    sizes = nodes.select("set_id", "n", "doc_id")
    members = written(narrow(bucket.select("set_id").distinct().join(sizes, "set_id"), n), "members")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = _representatives(source, members, width)
    least = written(narrow(bucket.groupBy("key").agg(F.min("set_id").alias("pivot")), n), "pivots")
    met = bucket.join(least, "key").where("set_id <> pivot").select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct()
    pairs = written(narrow(met, n), "pairs")
    kin = written(narrow(_compared(pairs, texts, width, percent), n, 20_000), "kin")
    labels = written(narrow(components(kin.where("linked")), n), "labels")
    clusters = components(kin).select(F.col("node").alias("set_id"), F.col("comp").alias("cluster"))
    placed = written(narrow(with_component(clusters.join(members.select("set_id", "n"), "set_id"), labels), n), "placed")
    more = written(block_links(placed, texts, _links(width, percent), "text", BLOCK, BLOCK_SHINGLES), "links")
    if not more.isEmpty():
        labels = relabel(labels, more)
    last = _rest_links(bucket, least, pairs, kin.where("near"), labels, members, texts, width, percent, n)
    if not last.isEmpty():
        labels = relabel(labels, last)
    for t in (bucket, least, pairs, kin, placed, more, last, texts):
        drop(t)
    nodes_comp = with_component(sizes, labels)
    least = nodes_comp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = nodes_comp.join(least, "comp").select("set_id", "component_id")
    moved = written(found.join(sizes, "set_id").where("component_id <> doc_id OR component_id IS NULL").select("set_id", "component_id"), "moved")
    # Only sets that are not their own component's least need a join; copies of one set are resolved with it.
    copied = nodes.select("set_id", F.col("doc_id").alias("least"))
    known = base.select("doc_id", "n_shingles", "set_id")
    out = known.join(copied, "set_id", "left").join(moved, "set_id", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    comp = F.when(linked, F.coalesce("component_id", "least")).otherwise(F.col("doc_id"))
    found = out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
    found = written(found, "found")
    for t in (base, nodes, members, moved):
        drop(t)
    return found


def _representatives(source: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(set_id, text): one text for each member set, found by the least doc_id that has it."""

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keep = np.zeros(batch.num_rows, dtype=bool)
            wanted = batch.column(0).to_pylist()
            for start, stop in slices(offsets):
                sets = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], width, powers)
                for i, s in enumerate(sets):
                    keep[start + i] = _digest(s) == wanted[start + i]
            yield batch.filter(pa.array(keep))

    # Texts are not shuffled for the few that are members, unless the members are many.
    wanted = broadcast_if_small(members.select("set_id", "doc_id"), MAX_BROADCAST)
    joined = source.join(wanted, "doc_id").select("set_id", "text")
    # Ids may repeat with other texts: only the text that has the set stands for it.
    found = written(joined.mapInArrow(tagged, "set_id binary, text string"), "texts")
    return found if found.count() == members.count() else written(found.dropDuplicates(["set_id"]), "texts")
