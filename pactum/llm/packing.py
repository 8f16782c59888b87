"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces of at most ``capacity`` tokens.  Lengths are bounded by the capacity, so the packing
is planned on the number of pieces of each length, however many pieces there are: lengths above a third of
the capacity go at most twice into a sequence and are matched greedily (the longest with the longest that
still fits); the shorter ones, from the longest down, each go where the smallest gap is left that holds them.
Whole runs of equal sequences are planned at once, and every piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm import storage, words

#: Fixed value: the published pattern by which byte-level BPE files of this kind cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a long text that are encoded at once, where it has a word's end to be cut at.
SLICE = 100_000
#: White space beyond one character a word from which a slice is left to the slower library, which needs no stack for it.
SPARE_SPACE = 2_000
#: Rows of (partition, length) that may be broadcast.
MAX_BROADCAST = 200_000

_WORD_END = re.compile(r"[^\W\d_](?=[\s.,;:!?。、，！？；：])")


def _byte_of_char() -> dict[str, int]:
    """The byte that every character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def text_slices(text: str, limit: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, each but the last ending with a word of letters.

    A run of letters always ends a word of the pattern, and what follows is cut without looking back, so the
    parts have the ids of the whole.  Text without such an end stays whole.
    """
    start = 0
    while len(text) - start > limit:
        cut = next((m.end() for m in _WORD_END.finditer(text, start + limit - 1) if m.group().isalpha()), len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


class ByteTokenizer:
    """Ids of the ``tokenizers`` library's byte-level BPE file at ``path``, without special tokens added.

    Where the file's ids are the ranks of its merges and its words are cut by PATTERN, the faster ``tiktoken``
    merges with the same vocabulary; texts with special tokens' strings or long runs of white space, and all other
    files, are encoded by ``tokenizers`` itself.  Only the path is sent to workers.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self._ready = False

    def __getstate__(self) -> dict:
        return {"path": self.path, "_ready": False}

    def _load(self) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._fast = None
        vocab, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        cutter = spec.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and spec.get("normalizer") is None
        odd = any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ranks = [vocab.get("".join(p)) for p in pairs]
        if plain and not odd and ranks == list(range(256, 256 + len(pairs))) and spec["model"].get("type") == "BPE":
            byte = _byte_of_char()
            known = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in self._special}
            self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self._ready = True

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit numbers."""
        if not self._ready:
            self._load()
        if self._fast is None or any(s in text for s in self._special):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts = []
        for part in text_slices(text):
            found = part.split()
            if len(part) - sum(map(len, found)) - len(found) > SPARE_SPACE:
                parts.append(np.array(self._slow.encode(part, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                parts.append(np.array(self._fast.encode_ordinary(part), dtype=np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the first of which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, tokenizer: ByteTokenizer, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents: ``id_col``, piece, start, length, ids_crc32 and, with ``keep_ids``, ids.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone.  Only
    documents of more than ``capacity`` tokens are cut.  Rows with a null or repeated id are documents of
    their own.  An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType

    @words.returning_memory
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, offsets = words.utf8(texts)
            for first, last in words.slices(offsets, 1_000_000):
                rows, piece, start, length, crc, held = [], [], [], [], [], []
                for row in range(first, last):
                    got = np.append(tokenizer.encode(texts[row].as_py() or ""), np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(piece_bounds(len(got), capacity)):
                        part = got[s : s + n]
                        rows.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            held.append(part.astype(np.int32))
                out = [ids.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, T.StructType(fields))
    return made.withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, sequences): where the pieces of every length go, from their numbers alone.

    A run (length, rank, n, sequence, each, offset) says: the ``n`` pieces of this length from ``rank`` on go
    ``each`` to a sequence, from ``sequence`` on, the first of a sequence at ``offset``.  The number of runs
    depends on the capacity, not on the number of pieces.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    made = 0

    def place(size: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((size, rank[size], n, sequence, each, offset))
        rank[size] += n
        left[size] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if n > 0 and gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((sequence, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect.bisect_right(large, min(size, capacity - size)) - 1
            while at >= 0 and (left[large[at]] == 0 or (large[at] == size and left[size] < 2)):
                at -= 1
            if at < 0:
                n = left[size]
                place(size, n, made, 1, 0)
                leave(capacity - size, made, n)
            elif large[at] == size:
                n = left[size] // 2
                place(size, 2 * n, made, 2, 0)
                leave(capacity - 2 * size, made, n)
            else:
                mate = large[at]
                n = min(left[size], left[mate])
                place(size, n, made, 1, 0)
                place(mate, n, made, 1, size)
                leave(capacity - size - mate, made, n)
            made += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                sequence, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, sequence, n = capacity, made, max(1, left[size] // (capacity // size))
                made += n
            each = min(gap // size, left[size])
            used = min(n, left[size] // each)
            place(size, used * each, sequence, each, capacity - gap)
            leave(gap - each * size, sequence, used)
            leave(gap, sequence + used, n - used)
    return runs, made


def _numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with __part, the task that read a row, and __nth, its rank among those of its length there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("__size")).to_numpy(zero_copy_only=False)
            by = np.argsort(size, kind="stable")
            ordered = size[by]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(size), dtype=np.int64)
            nth[by] = np.arange(len(size)) - first + seen[ordered]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(nth)], names=[*batch.schema.names, "__part", "__nth"])

    fit = F.col("length").between(1, capacity)
    sized = pieces.withColumn("__size", F.when(fit, F.col("length").cast("int")).otherwise(F.lit(0)))
    schema = T.StructType([*sized.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__nth", T.LongType())])
    return sized.mapInArrow(work, schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: ``length`` tokens each, gapless, in few sequences of ``capacity``.

    A row whose length is null or not from 1 to ``capacity`` gets null for both.  An empty table gives an empty
    result.  Columns named sequence_id or offset are replaced; names that begin with ``__`` are kept for this
    function.  The rows are written once, so that their ranks stay, and never sorted: a task counts the lengths that
    it meets, and only these counts are added up over tasks.
    """
    rows = storage.written(_numbered(pieces.drop("sequence_id", "offset"), capacity), "pieces")
    counts = storage.written(rows.where("__size > 0").groupBy("__part", "__size").agg(F.count("*").alias("__n")), "lengths")
    total = {r[0]: int(r[1]) for r in counts.groupBy("__size").agg(F.sum("__n")).collect()}
    runs, _ = plan(total, capacity)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    # Rows of a length follow each other in the table, so one search finds the run of a (length, rank).
    reach = max([1, *(c + 1 for c in total.values())])
    keys = table[:, 0] * reach + table[:, 1]
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", "__size", before.alias("__before"))
    starts = storage.broadcast_if_small(storage.written(starts, "starts"), MAX_BROADCAST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("__size")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False)
            held = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if not n.startswith("__")]
            known = size > 0
            if len(table):
                run = table[np.maximum(np.searchsorted(keys, size * reach + rank, side="right") - 1, 0)]
                k = rank - run[:, 1]
                each = np.maximum(run[:, 4], 1)
                sequence, offset = run[:, 3] + k // each, run[:, 5] + k % each * size
            else:
                sequence = offset = np.zeros(len(size), dtype=np.int64)
            names = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(sequence, mask=~known), pa.array(offset, mask=~known)], names=[*names, "sequence_id", "offset"])

    ranked = rows.join(starts, ["__part", "__size"], "left").withColumn("__rank", F.col("__nth") + F.coalesce("__before", F.lit(0))).drop("__part", "__nth", "__before")
    plain = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([*plain, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(work, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the tokens of every sequence, in order.  ``packed`` has the ids of its pieces."""
    parts = packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
