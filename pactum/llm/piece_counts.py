"""Count-only Viterbi: how many pieces a text has, without making the pieces.

An Aho-Corasick automaton lists the vocabulary's matches in a word; a pass over the word carries the best
score (for a BPE model: the last piece of the one path that merging makes) and the piece count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.pieces import BYTES_AT_ONCE, SPACE, Vocabulary, merge_bpe, split_words, unit_of
from pactum.llm.words import returning_memory, slices, utf8


class Counter:
    """Counts pieces, keeping the counts of the words that it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary, max_words: int = 500_000) -> None:
        import ahocorasick

        self.vocab, self.max_words = vocab, max_words
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.borders: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.bpe = vocab.kind == "bpe"
        for i in vocab.normal:
            if self.bpe and not vocab.proper[i]:
                continue
            self.automaton.add_word(vocab.text[i], (len(vocab.text[i]), i))
        self.automaton.make_automaton()
        self.score = vocab.score.astype(float).tolist()
        self.lowest = float(np.float32(vocab.score[vocab.normal].min()) - np.float32(10))
        if self.bpe:
            self.rank, self.left, self.right = vocab.rank.tolist(), vocab.left.tolist(), vocab.right.tolist()
            self.pairs = dict(zip(vocab.pair_keys.tolist(), vocab.pair_ranks.tolist(), strict=True))

    def _border(self, a: int, b: int) -> bool:
        """Whether merging can leave a border between pieces a and b; see Lattice._borders."""
        limit = float("inf")
        while True:
            if self.pairs.get((a << 32) | b, limit) < limit:
                return False
            x, y = self.rank[a], self.rank[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.right[a]
            else:
                limit, b = y + 1, self.left[b]

    def _merged(self, unit: str) -> int:
        n = len(unit)
        if SPACE * 2 in unit:
            return len(merge_bpe(self.vocab, unit))
        last: list[int | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        last[0] = -3
        borders = self.borders
        for end, (width, piece) in self.automaton.iter(unit):
            e = end + 1
            if last[e] is not None:
                continue
            prior = last[e - width]
            if prior is None:
                # An unknown character ends here: it stands alone, as its bytes.
                if e - width and not self._close(unit, last, count, e - width):
                    continue
                prior = last[e - width]
            if prior >= 0:
                key = (prior << 32) | piece
                ok = borders.get(key)
                if ok is None:
                    if len(borders) > 2_000_000:
                        borders.clear()
                    ok = borders[key] = self._border(prior, piece)
                if not ok:
                    continue
            last[e], count[e] = piece, count[e - width] + 1
        if last[n] is None and not self._close(unit, last, count, n):
            return len(merge_bpe(self.vocab, unit))
        return count[n]

    def _close(self, unit: str, last: list, count: list, e: int) -> bool:
        """Reach ``e`` through the run of unknown characters that ends there; False if there is none."""
        start = e
        while start and last[start] is None and unit[start - 1] not in self.vocab.id:
            start -= 1
        if start == e or last[start] is None:
            return False
        for k in range(start, e):
            new = len(unit[k].encode("utf-8", "surrogatepass")) if self.vocab.byte else int(last[k] != -2)
            last[k + 1], count[k + 1] = -2, count[k] + new
        return True

    def _scored(self, unit: str) -> int:
        n = len(unit)
        best = array("f", [float("-inf")]) * (n + 1)
        best[0] = 0.0
        at = array("f", [0.0])  # rounds to single precision
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, hit in self.automaton.iter(unit):
            matches[end + 1].append(hit)
        for e in range(1, n + 1):
            found = sorted(matches[e], reverse=True)
            # Longer pieces begin earlier and were reached first: they win ties.
            for width, piece in found:
                at[0] = self.score[piece] + best[e - width]
                total = at[0]
                if total > best[e]:
                    best[e], count[e], unknown[e] = total, count[e - width] + 1, False
            if not found or found[-1][0] != 1:
                at[0] = self.lowest + best[e - 1]
                total = at[0]
                if total > best[e]:
                    new = len(unit[e - 1].encode("utf-8", "surrogatepass")) if self.vocab.byte else int(not unknown[e - 1])
                    best[e], count[e], unknown[e] = total, count[e - 1] + new, True
        return count[n]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of pieces of each text."""
        if len(self.known) > self.max_words:
            self.known.clear()
        if len(self.parts) > self.max_words:
            self.parts.clear()
        split = [split_words(t, self.vocab.dummy_prefix) for t in texts]
        one = self._merged if self.bpe else self._scored
        known, parts, cut = self.known, self.parts, self.vocab.cut.split
        for word in set().union(*split) - known.keys():
            total = 0
            for part in cut(unit_of(word)):
                n = parts.get(part)
                if n is None:
                    n = parts[part] = one(part)
                total += n
            known[word] = total
        get = known.__getitem__
        return np.array([sum(map(get, words)) for words in split], dtype=np.int64)


def count_pieces(docs: DataFrame, vocab: Vocabulary, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(``id_cols``, n_pieces) of every row's whole text; null and empty texts have 0 pieces.

    Repeated rows are counted alike; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start, stop in slices(utf8(column)[1], BYTES_AT_ONCE):
                texts = column.slice(start, stop - start).fill_null("").to_pylist()
                cols = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counter.count(texts), pa.int64())], names=[*batch.schema.names[:-1], "n_pieces"])

    first = docs.select(*id_cols, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-1])
    return first.mapInArrow(returning_memory(run), f"{kinds}, n_pieces long")
