"""SentencePiece encoding and decoding by a Viterbi search over batches of equal-length words.

Words are cut before each run of U+2581 that follows another character, and into parts between characters
that no piece has side by side; both are exact (the vocabulary is checked on loading).  All words of a length advance together
through one lattice: hashes of their substrings probe the sorted hashes of the pieces, and the best way
to reach each position is kept as a backpointer.

A unigram model keeps the path of the highest score, with the tokenizer's tie rule: single-precision
path scores, and of equal paths the one whose last piece is longest.  A BPE model's ids are not those of
a best-scored path, so there a path is valid if it is the one that merging makes: adjacent pieces must be
such that no merge across their border would have come first.  One path of each word is valid.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.words import mix, returning_memory, slices, utf8

SPACE = "▁"
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
#: Longer parts of words take the plain merge or search of one word, which is exact as well.
MAX_BATCHED = 40
#: Substrings that are probed in one step.
PROBES = 150_000
#: Bytes of text that are encoded in one step.
BYTES_AT_ONCE = 1_000_000
#: Ids that are decoded in one step to compare their texts with the given ones.
DECODED_AT_ONCE = 100_000
_UNKNOWN, _NONE, _START = -2, -1, -3


class Vocabulary:
    """The pieces of a SentencePiece model file and what encoding needs to know of them."""

    def __init__(self, model_file: str, kind: str | None = None) -> None:
        """``kind``: "bpe" or "unigram"; the file's own if not given."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with escaped white space is built")
        self.kind = kind or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.dummy_prefix = spec.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces], dtype=np.float32)
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not built")
        self.normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.id = {self.text[i]: i for i in self.normal}
        if any(SPACE in t.lstrip(SPACE) for t in self.id):
            raise ValueError("pieces with white space inside are not built")
        self.surface = [b""] * len(self.text)
        for i in self.normal:
            self.surface[i] = self.text[i].replace(SPACE, " ").encode()
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.widest = max(map(len, self.id))
        self.cut = self._cut()
        if self.kind == "bpe":
            self._merges()

    def _cut(self) -> re.Pattern:
        """Where a word can be cut: between two characters that no piece has side by side.

        Finds the cuts after a letter, and those around characters that are in no longer piece.
        """
        pairs = {pair for t in self.id for pair in zip(t, t[1:], strict=False)}
        after_letter = {b for a, b in pairs if a.isalpha()}
        joined = {c for pair in pairs for c in pair}
        ascii_ = [chr(b) for b in range(128) if not chr(b).isalnum()]
        safe = "".join(re.escape(c) for c in ascii_ if c not in after_letter)
        lone = "".join(re.escape(c) for c in ascii_ if c not in joined)
        ways = [rf"(?<=[^\W\d_])(?=[{safe}])"] * bool(safe) + [rf"(?<=[{lone}])|(?=[{lone}])"] * bool(lone)
        return re.compile("|".join(ways) or r"(?!)")

    def _merges(self) -> None:
        """rank[i]: when piece i is merged, -1 for one character; left and right: its last merge; proper: it encodes as itself."""
        order = sorted((i for i in self.normal if len(self.text[i]) > 1), key=lambda i: -self.score[i])
        self.rank = np.full(len(self.text), -1, dtype=np.int64)
        at, before = -1, None
        for i in order:
            at, before = at + (self.score[i] != before), self.score[i]
            self.rank[i] = at
        self.left = np.full(len(self.text), -1, dtype=np.int64)
        self.right = np.full(len(self.text), -1, dtype=np.int64)
        self.proper = np.zeros(len(self.text), dtype=bool)
        pairs = {}
        for i in self.normal:
            t = self.text[i]
            if SPACE * 2 in t:
                continue
            for k in range(1, len(t)):
                a, b = self.id.get(t[:k]), self.id.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = self.rank[i]
            last: list[tuple[int, int]] = []
            if len(t) == 1:
                self.proper[i] = True
            elif merge_bpe(self, t, last) == [i]:
                self.proper[i] = True
                self.left[i], self.right[i] = last[-1]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]


def split_words(text: str, dummy_prefix: bool = True) -> list[str]:
    """The text's words, each from a run of U+2581 up to the next run.

    A word that begins with exactly one U+2581 is given without it; any other has a NUL before it.
    """
    if not text:
        return []
    if dummy_prefix and "  " not in text and SPACE not in text and text[0] != " " and "\0" not in text:
        return text.split(" ")
    whole = (" " + text if dummy_prefix else text).replace(" ", SPACE)
    out, start, n = [], 0, len(whole)
    while start < n:
        stop = start
        while stop < n and whole[stop] == SPACE:
            stop += 1
        nxt = whole.find(SPACE, stop)
        nxt = n if nxt < 0 else nxt
        unit = whole[start:nxt]
        out.append(unit[1:] if unit[0] == SPACE and unit[1:2] != SPACE and unit[1:2] != "\0" else "\0" + unit)
        start = nxt
    return out


def unit_of(word: str) -> str:
    """The characters that a word of :func:`split_words` stands for."""
    return word[1:] if word[:1] == "\0" else SPACE + word


def merge_bpe(vocab: Vocabulary, unit: str, last: list | None = None) -> list[int]:
    """The pieces of one word by merging: the highest-scored pair first, of equal ones the leftmost."""
    own = [vocab.id.get(c, _UNKNOWN) for c in unit]
    text = list(unit)
    n = len(unit)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        whole = vocab.id.get(text[a] + text[b])
        if whole is not None:
            heapq.heappush(heap, (-vocab.score[whole], a, b, len(text[a]), len(text[b]), whole))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, x, y, whole = heapq.heappop(heap)
        if len(text[a]) != x or len(text[b]) != y or not text[a] or not text[b] or after[a] != b:
            continue
        if last is not None:
            last.append((own[a], own[b]))
        text[a], text[b], own[a] = text[a] + text[b], "", whole
        after[a] = after[b]
        if after[b] < n:
            before[after[b]] = a
            offer(a, after[b])
        if before[a] >= 0:
            offer(before[a], a)
    return _expanded(vocab, [(own[a], text[a]) for a in range(n) if text[a]])


def search_unigram(vocab: Vocabulary, unit: str) -> list[int]:
    """The pieces of one word of any length by the highest score."""
    n = len(unit)
    best = np.full(n + 1, -np.inf, dtype=np.float32)
    best[0] = 0
    back = [0] * (n + 1)
    own = [_UNKNOWN] * (n + 1)
    lowest = np.float32(vocab.score[vocab.normal].min()) - np.float32(10)
    for e in range(1, n + 1):
        for w in range(min(e, vocab.widest), 0, -1):
            i = vocab.id.get(unit[e - w : e], _UNKNOWN if w == 1 else None)
            if i is not None:
                total = (vocab.score[i] if i >= 0 else lowest) + best[e - w]
                if total > best[e]:
                    best[e], back[e], own[e] = total, w, i
    out, e = [], n
    while e:
        out.append((own[e], unit[e - back[e] : e]))
        e -= back[e]
    return _expanded(vocab, out[::-1])


def _expanded(vocab: Vocabulary, found: list[tuple[int, str]]) -> list[int]:
    """Ids, with unknown characters as their bytes, or a run of them as one unknown piece."""
    out: list[int] = []
    unknown = False
    for i, text in found:
        if i >= 0:
            out.append(i)
        elif vocab.byte or not unknown:
            out += vocab.fallback(text)
        unknown = i < 0
    return out


class Lattice:
    """The batched search of one worker."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        usable = [i for i in vocab.normal if SPACE * 2 not in vocab.text[i] and (vocab.kind != "bpe" or vocab.proper[i])]
        self.up = np.array([pow(_BASE, k, 2**64) for k in range(MAX_BATCHED + 1)], dtype=np.uint64)
        self.down = np.array([pow(pow(_BASE, -1, 2**64), k, 2**64) for k in range(MAX_BATCHED + 1)], dtype=np.uint64)
        keys = np.zeros(len(usable), dtype=np.uint64)
        for n in {len(vocab.text[i]) for i in usable}:
            own = [k for k, i in enumerate(usable) if len(vocab.text[i]) == n]
            sums = self._sums(_codes([vocab.text[usable[k]] for k in own], n))
            keys[own] = self._key(sums, 0, n)
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], np.zeros(8, np.uint64)])
        self.ids = np.concatenate([np.array(usable, dtype=np.int64)[order], np.full(8, _NONE)])
        self.starts = np.searchsorted(keys[order], np.arange(1 << 18, dtype=np.uint64) << _U(46)).astype(np.int32)
        self.deep = int(np.bincount((keys >> _U(46)).astype(np.int64)).max(initial=1))
        self.widths = sorted({len(vocab.text[i]) for i in usable} | {1}, reverse=True)
        self.steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if vocab.kind == "bpe":
            self.tags = np.full(1 << 20, -1, dtype=np.int64)
            self.fits = np.zeros(1 << 20, dtype=bool)
        else:
            self.lowest = vocab.score[vocab.normal].min() - np.float32(10)

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * self.up[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _key(self, sums: np.ndarray, start: int, width: int) -> np.ndarray:
        return mix((sums[:, start + width] - sums[:, start]) * self.down[start] + _U(width))

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key among the sorted piece keys, or _NONE."""
        at = self.starts[(keys >> _U(46)).astype(np.int64)]
        out = np.where(self.keys[at] == keys, self.ids[at], _NONE)
        for k in range(1, self.deep):
            hit = self.keys[at + k] == keys
            out[hit] = self.ids[at[hit] + k]
        return out

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging can leave a border between the two pieces, from a cache of pairs."""
        tag = (left << 32) | right
        slot = (mix(tag.view(np.uint64)) >> _U(44)).astype(np.int64)
        out = self.fits[slot]
        miss = np.flatnonzero(self.tags[slot] != tag)
        if len(miss):
            fresh = np.unique(tag[miss])
            ok = self._borders(fresh >> 32, fresh & 0xFFFFFFFF)
            own = (mix(fresh.view(np.uint64)) >> _U(44)).astype(np.int64)
            self.tags[own], self.fits[own] = fresh, ok
            out[miss] = ok[np.searchsorted(fresh, tag[miss])]
        return out

    def _borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo merges on both sides of the border, the latest first; no pair across may have come before the next one undone."""
        v = self.vocab
        a, b = left.copy(), right.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            key = (a[live] << 32) | b[live]
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            crossed = (v.pair_keys[at] == key) & (v.pair_ranks[at] < limit[live])
            ok[live[crossed]] = False
            live = live[~crossed]
            ra, rb = v.rank[a[live]], v.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            of_left = ra > rb
            # Of equal merges the left one comes first, so a crossing pair of the same rank wins over the right one.
            limit[live] = np.where(of_left, ra, rb + 1)
            a[live] = np.where(of_left, v.right[a[live]], a[live])
            b[live] = np.where(of_left, b[live], v.left[b[live]])
        return ok

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of pieces of each)."""
        groups: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            groups.setdefault(len(unit) if SPACE * 2 not in unit else 0, []).append(k)
        order, flat, sizes = [], [], []
        for n, members in groups.items():
            batched = 0 < n <= MAX_BATCHED
            step = max(1, PROBES // len(self._steps(n)[0])) if batched else 20_000
            for start in range(0, len(members), step):
                part = np.array(members[start : start + step])
                own = [units[k] for k in part.tolist()]
                if batched:
                    ids, size, at = self._batch(own, n)
                    part = part[at]
                else:
                    found = [self._plain(u) for u in own]
                    ids, size = np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)
                order.append(part)
                flat.append(ids)
                sizes.append(size)
        at = np.argsort(np.concatenate(order))
        size = np.concatenate(sizes)
        starts = np.cumsum(size) - size
        return np.concatenate(flat)[ragged(starts[at], size[at])], size[at]

    def _plain(self, unit: str) -> np.ndarray:
        found = merge_bpe(self.vocab, unit) if self.vocab.kind == "bpe" else search_unigram(self.vocab, unit)
        return np.array(found, dtype=np.int32)

    def _steps(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, width) of every substring of a word of length n that may be a piece, by end, longest first, and the first of each end."""
        if n not in self.steps:
            found = [(e - w, w) for e in range(1, n + 1) for w in self.widths if w <= e]
            start, width = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            self.steps[n] = start, width, np.searchsorted(start + width, np.arange(1, n + 2))
        return self.steps[n]

    def _batch(self, units: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of pieces of each word, its place in ``units``) of words of length n, in any order."""
        sums = self._sums(_codes(units, n)).T
        rows = len(units)
        bpe = self.vocab.kind == "bpe"
        start, width, first = self._steps(n)
        found = self._probe(mix((sums[start + width] - sums[start]) * self.down[start, None] + width.astype(np.uint64)[:, None]))
        found[(found == _NONE) & (width == 1)[:, None]] = _UNKNOWN
        which, row = np.nonzero(found != _NONE)
        piece, wide = found[which, row], width[which]
        ends = np.searchsorted(which, first)
        own = np.full((n + 1, rows), _NONE, dtype=np.int64)
        own[0] = _START
        back = np.zeros((n + 1, rows), dtype=np.int8)
        twice = np.zeros(rows, dtype=bool)
        best = np.full((n + 1, rows), -np.inf, dtype=np.float32)
        best[0] = 0
        for e in range(1, n + 1):
            part = slice(ends[e - 1], ends[e])
            at, now, w = row[part], piece[part], wide[part]
            prior = own[e - w, at]
            ok = prior != _NONE
            if bpe:
                ask = np.flatnonzero(ok & (prior >= 0) & (now >= 0))
                ok[ask] = self._compatible(prior[ask], now[ask])
                at, now, w = at[ok], now[ok], w[ok]
                twice |= np.bincount(at, minlength=rows) > 1
            else:
                at, now, w = at[ok], now[ok], w[ok]
                total = np.where(now >= 0, self.vocab.score[now], self.lowest) + best[e - w, at]
                np.maximum.at(best[e], at, total)
                # Longer pieces come first here and win ties: they are written last.
                top = np.flatnonzero(total == best[e, at])[::-1]
                at, now, w = at[top], now[top], w[top]
            own[e, at], back[e, at] = now, w
        bad = twice | (own[n] == _NONE)
        at = np.where(bad, 0, n)
        path = np.full((n, rows), _NONE, dtype=np.int64)
        k = n
        everyone = np.arange(rows)
        while at.any():
            k -= 1
            live = at > 0
            path[k, live] = own[at[live], everyone[live]]
            at = at - np.where(live, back[at, everyone], 0)
        path = path[k:].T
        other = bad | (path == _UNKNOWN).any(axis=1)
        real = (path >= 0) & ~other[:, None]
        flat, size = path[real].astype(np.int32), real.sum(axis=1)
        if not other.any():
            return flat, size, everyone
        # Words with unknown characters, and any that the lattice did not settle.
        odd = np.flatnonzero(other)
        more = [self._plain(units[i]) if bad[i] else self._with_unknown(units[i], path[i]) for i in odd]
        return np.concatenate([flat, *more]), np.concatenate([size[~other], [len(x) for x in more]]), np.concatenate([everyone[~other], odd])

    def _with_unknown(self, unit: str, steps: np.ndarray) -> np.ndarray:
        found, at = [], 0
        for i in steps[steps != _NONE].tolist():
            w = len(self.vocab.text[i]) if i >= 0 else 1
            found.append((i, unit[at : at + w]))
            at += w
        return np.array(_expanded(self.vocab, found), dtype=np.int32)


def _codes(units: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(units), n)


class Store:
    """Numbered id lists, grown on demand."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 16, dtype=np.int64)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        ends = self.at[n] + np.cumsum(sizes)
        while len(self.at) < n + len(names) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.at[n] : ends[-1]] = ids
        self.at[n + 1 : n + 1 + len(names)] = ends
        self.number.update(zip(names, range(n, n + len(names)), strict=True))

    def take(self, names: list[str], which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the named lists one after the other, or of ``which`` of them."""
        at = np.fromiter(map(self.number.__getitem__, names), dtype=np.int64, count=len(names))
        at = at if which is None else at[which]
        starts = self.at[at]
        sizes = self.at[at + 1] - starts
        return self.flat[ragged(starts, sizes)], sizes


class Encoder:
    """Encodes texts, keeping the words and parts of words that it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary, max_words: int = 100_000) -> None:
        self.vocab, self.max_words, self.lattice = vocab, max_words, Lattice(vocab)
        self.words, self.parts = Store(), Store()
        # joined[a, b]: whether a piece has the two characters side by side; 0 stands for characters of no piece.
        chars = sorted(set().union(*vocab.id))
        place = {c: k for k, c in enumerate(chars, 1)}
        self.place = np.zeros(max(map(ord, chars)) + 2, dtype=np.uint16 if len(chars) < 65535 else np.uint32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        self.joined[0, 0] = True
        for t in vocab.id:
            for a, b in zip(t, t[1:], strict=False):
                self.joined[place[a], place[b]] = True

    def _cut(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """(parts of all words in order, number of parts of each), cut between characters that no piece has side by side."""
        whole = "".join(units)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = self.place[np.minimum(codes, len(self.place) - 1)]
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[place[:-1], place[1:]]
        ends = np.cumsum([len(u) for u in units])
        cut[ends] = True
        at = np.flatnonzero(cut)
        edges = at.tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)], np.diff(np.searchsorted(at, ends), prepend=0)

    def _learn(self, words: list[str]) -> None:
        parts, counts = self._cut([unit_of(w) for w in words])
        new = list(set(parts) - self.parts.number.keys())
        if new:
            self.parts.add(new, *self.lattice.encode(new))
        ids, sizes = self.parts.take(parts)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        self.words.add(words, ids, np.diff(ends, prepend=0))

    def _split(self, texts: pa.Array) -> pa.Array:
        """The list of words of every text; see :func:`split_words`."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))
        odd = pc.or_(pc.or_(odd, pc.match_substring(texts, "\0")), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        if not self.vocab.dummy_prefix:
            odd = pc.or_(odd, True)
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        if len(plain) == len(texts):
            return plain
        others = pa.array([split_words(t, self.vocab.dummy_prefix) for t in texts.filter(odd).to_pylist()], plain.type)
        order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([plain, others]).take(pa.array(order))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        if len(self.words.number) > self.max_words:
            self.words = Store()
        if len(self.parts.number) > self.max_words:
            self.parts = Store()
        split = self._split(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        new = [w for w in words if w not in self.words.number]
        if new:
            self._learn(new)
        ids, sizes = self.words.take(words, flat.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        count = split.value_lengths().to_numpy()
        return ids, ends[np.concatenate([[0], np.cumsum(count)])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts
    return np.repeat(shift, lengths) + np.arange(total)


class Decoder:
    """Texts from ids."""

    def __init__(self, vocab: Vocabulary) -> None:
        lengths = np.array([len(x) for x in vocab.surface], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.frombuffer(b"".join(vocab.surface), dtype=np.uint8)
        self.dummy_prefix = vocab.dummy_prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets): the UTF-8 texts of the rows, without the space that encoding put first."""
        starts = self.at[ids]
        lengths = self.at[ids + 1] - starts
        if self.dummy_prefix:
            first = offsets[:-1][offsets[1:] > offsets[:-1]]
            spaced = first[(lengths[first] > 0) & (self.flat[np.minimum(starts[first], len(self.flat) - 1)] == 32)]
            starts[spaced] += 1
            lengths[spaced] -= 1
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged(starts, lengths)], ends[offsets]


def encode(docs: DataFrame, vocab: Vocabulary, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(``id_cols``, ids array<int>, n_pieces long, round_trip boolean) of every row's whole text.

    round_trip: decoding the ids gives the text again.  A null or empty text has no pieces and
    round_trip is true.  Characters outside the vocabulary become byte pieces.  Repeated rows are
    encoded alike; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start, stop in slices(utf8(column)[1], BYTES_AT_ONCE):
                texts = column.slice(start, stop - start).fill_null("")
                ids, at = encoder.encode(texts)
                raw, raw_at = utf8(texts)
                same = []
                for lo, hi in slices(at, DECODED_AT_ONCE):
                    data, ends = decoder.decode(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    given = raw_at[lo : hi + 1]
                    same += [np.array_equal(data[ends[i] : ends[i + 1]], raw[given[i] : given[i + 1]]) for i in range(hi - lo)]
                cols = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(np.diff(at), pa.int64()), pa.array(same)], names=[*batch.schema.names[:-1], "ids", "n_pieces", "round_trip"])

    first = docs.select(*id_cols, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-1])
    return first.mapInArrow(returning_memory(run), f"{kinds}, ids array<int>, n_pieces long, round_trip boolean")


def decode(rows: DataFrame, vocab: Vocabulary, id_cols: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(``id_cols``, text) of every row's ids; null ids give an empty text.

    Bytes that are not UTF-8 become U+FFFD.  Ids outside the vocabulary, and null ids within a list,
    fail the job.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = np.concatenate([[0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64))])
            data, ends = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            whole = data.tobytes()
            texts = [whole[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    first = rows.select(*id_cols, ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-1])
    return first.mapInArrow(returning_memory(run), f"{kinds}, text string")
