"""Whitening, centroid clustering and packing against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest

from pactum.llm import centroids, packing, queries, whitening

SF = "/root/testdata/sf0.01"
VEC = "vec_id long, embedding array<float>, n int, x string"


def _eigen(x):
    """(n, sums, falling eigenvalues, vectors) of the distinct rows' covariance, divisor n."""
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    return len(fit), fit.sum(axis=0), e[::-1], u[:, ::-1], fit


def test_whitening_of_the_table_is_that_of_numpy(spark):
    got = queries.op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in table}
    n, s, e, u, fit = _eigen(np.array(list(x.values())))
    assert len(got) == 4 * len(x)
    flips = {}
    for r in got:
        k = r.component - 1
        want = (x[r.vec_id] - s / n) @ u[:, k] / math.sqrt(e[k])
        flip = flips.setdefault(k, np.sign(want * r.whitened) or 1)
        assert abs(flip * r.whitened - want) < 1e-8
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())
        assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-10 and r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [(i, [float(v) for v in rng.standard_normal(3) * (9, 3, 1) + 50_000]) for i in range(60)]
    odd = [(None, base[0][1]), (1, base[1][1]), (100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [50_000.0, 50_000.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in base + odd], VEC)
    got = whitening.whiten(df, k=4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    # A null id and a repeated row are rows; the short vector is padded with a zero; three components at most.
    assert len(rows) == 3 * 63 and {r.component for r in rows} == {1, 2, 3}
    x = np.array([np.floor(256 * np.array([*np.float32(v).astype(np.float64), *[0.0] * (3 - len(v))])) for _, v in [*base, odd[-1]]])
    n, s, e, u, fit = _eigen(x)
    assert {r.n for r in rows} == {n} == {61}
    assert max(r.identity_error for r in rows) < 1e-6
    share = {r.component: r.explained for r in rows}
    assert all(abs(share[k + 1] / (e[k] / e.sum()) - 1) < 1e-4 for k in range(3))
    exact = {tuple(r): sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x}
    assert {int(r.deviation) for r in rows} == set(exact.values())


def test_whitening_without_variance_or_rows(spark):
    for rows in ([], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, None)], [(1, [])]):
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VEC)
        assert whitening.whiten(df).collect() == []
    line = spark.createDataFrame([(i, [float(i), 0.0], 1, "x") for i in range(9)], VEC)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    # Far beyond what 64-bit products hold.
    big = spark.createDataFrame([(i, [float(i) * 1e15, float(i % 3)], 1, "x") for i in range(9)], VEC)
    assert whitening.whiten(big, k=1).where("identity_error < 1e-6").count() == 9


def test_feast_finds_all_pairs_even_close_and_equal_ones():
    rng = np.random.default_rng(5)
    for d, values in ((30, np.r_[3.0, 3.0, 3.0, 2.999999, rng.uniform(0, 1, 26)]), (30, 10.0 ** -np.arange(30)), (12, np.r_[5.0, np.zeros(11)]), (6, np.ones(6))):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        want = np.sort(values)[::-1][:4]
        want = want[want > 0]
        e, u = whitening.leading(v, 4)
        assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-14)
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12 and np.abs(v @ u - u * e).max() < 1e-12 * want[0]
        for shift in rng.uniform(0, 4, 10):
            assert whitening.inertia(v, shift) == (values > shift).sum()


def _lloyd(vectors, k, rounds, factor=1024, seed=3):
    """vec_id -> (cluster, distance), and the final centroids, one plain step after the other."""
    x = {i: [math.floor(factor * float(np.float32(c))) for c in v] for i, v in vectors.items()}
    c = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]]

    def nearest():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for i, v in x.items()}

    for _ in range(rounds):
        groups = {}
        for i, (_, j) in nearest().items():
            groups.setdefault(j, []).append(x[i])
        for j, g in groups.items():
            c[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    return {i: (j, d) for i, (d, j) in nearest().items()}, c


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_are_those_of_plain_rounds(spark, spread, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(8)
    mids = rng.standard_normal((6, 8))
    vectors = {i: [float(np.float32(c)) for c in mids[i % 6] + spread * rng.standard_normal(8)] for i in range(1500)}
    vectors |= {i: vectors[0] for i in range(1500, 2000)}  # a large group of copies
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], VEC).repartition(5)
    stats = []
    got = {r.vec_id: r for r in centroids.cluster(df, k=8, rounds=10, dims=8, stats=stats).collect()}
    want, final = _lloyd(vectors, 8, 10)
    assert {i: (r.cluster, r.distance) for i, r in got.items()} == want
    for j in range(8):
        mine = [r for r in got.values() if r.cluster == j]
        assert {r.cluster_inertia for r in mine} <= {sum(r.distance for r in mine)}
        assert {r.centroid_sha256 for r in mine} <= {hashlib.sha256(",".join(map(str, final[j])).encode()).hexdigest()}
    assert {r.inertia for r in got.values()} == {sum(d for _, d in want.values())}
    assert stats[0] == (2000, 2000) and stats[-1][1] < (400 if spread < 1 else 2000)


def test_rounds_join_without_a_shuffle(spark):
    from pactum.llm import storage

    a, a_name = storage.bucketed(spark.range(50).withColumnRenamed("id", "block"), "a", "block", 3)
    b, b_name = storage.bucketed(spark.range(50).withColumnRenamed("id", "block"), "b", "block", 3)
    plan = a.hint("merge").join(b, "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    storage.drop_bucketed(a, a_name)
    storage.drop_bucketed(b, b_name)
    assert not [t for t in spark.catalog.listTables() if t.name in (a_name, b_name)]


def test_clusters_of_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 0.0]), (4, [5.0, 5.0])]
    bad = [(5, None), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("-inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], VEC)
    rows = centroids.cluster(df, k=8, rounds=3, dims=2).collect()
    # Four rows, four centroids, two of them equal: the smaller number has both rows.
    assert len(rows) == 4 and len({r.cluster for r in rows}) == 3 and {r.distance for r in rows} == {0}
    assert len({r.cluster for r in rows if r.vec_id == 1}) == 1
    assert centroids.cluster(df.where("vec_id > 4"), dims=2).collect() == []
    assert {r.cluster for r in centroids.cluster(df, k=1, rounds=2, dims=2).collect()} == {0}
    with pytest.raises(ValueError, match="component"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0], 1, "x")], VEC), dims=2)


def test_no_point_of_a_sphere_gets_nearer_than_the_bound():
    rng = np.random.default_rng(1)
    tight = 0
    for _ in range(600):
        d = int(rng.integers(1, 6))
        own, before = rng.integers(-1000, 1000, (2, d))
        after = before + np.round(rng.standard_normal(d) * 10 ** rng.uniform(0, 3)).astype(int)
        radius = 10 ** rng.uniform(0, 3.5)
        p = rng.standard_normal((300, d))
        p *= radius * rng.uniform(0, 1, (300, 1)) ** 0.1 / np.linalg.norm(p, axis=1, keepdims=True)
        nearer = np.linalg.norm(own + p - before, axis=1) - np.linalg.norm(own + p - after, axis=1)
        bound = centroids.approach(own, radius, before, after)
        assert nearer.max() <= bound + 1e-9
        tight += bound < 0.99 * np.linalg.norm(after - before)
    assert tight > 300


def _best_fit(sizes, capacity):
    """Numbers of sequences of a plain best fit: large pieces paired with the largest that fits, small ones one at a time."""
    large, small = sorted((s for s in sizes if 3 * s > capacity), reverse=True), sorted((s for s in sizes if 3 * s <= capacity), reverse=True)
    gaps = []
    while large:
        size = large.pop(0)
        mate = next((k for k, s in enumerate(large) if s + size <= capacity), None)
        gaps.append(capacity - size - (large.pop(mate) if mate is not None else 0))
    for s in small:
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


def test_plan_is_that_of_plain_best_fit():
    rng = np.random.default_rng(2)
    for case in range(300):
        capacity = int(rng.integers(4, 120))
        high = int(rng.integers(1, capacity + 1))
        sizes = rng.integers(1, high + 1, int(rng.integers(0, 200))).tolist()
        if case % 3 == 0:
            sizes += [high] * 70
        counts = {s: sizes.count(s) for s in set(sizes)}
        runs, made = packing.plan(counts, capacity)
        filled = {}
        for size, _, n, sequence, each, offset in runs:
            for k in range(n):
                filled.setdefault(sequence + k // each, []).append((offset + k % each * size, size))
        for parts in filled.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= capacity
        assert sum(map(len, filled.values())) == len(sizes) and set(filled) == set(range(made))
        for s in counts:  # ranks are covered once
            spans = sorted((r[1], r[2]) for r in runs if r[0] == s)
            assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == counts[s]
        assert made == _best_fit(sizes, capacity)


def test_packed_documents_of_the_table(spark):
    from tokenizers import Tokenizer

    rows = queries.op13_packing(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    tok = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    names = sorted(docs)
    ids = dict(zip(names, (e.ids + [0] for e in tok.encode_batch([docs[i] for i in names], add_special_tokens=False)), strict=True))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and (r.length == 2048 if k else r.length <= 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[i]) and (len(parts) == 1 or at > 2048)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.005 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_pieces_and_sequences_of_odd_rows(spark):
    long = "word " * 3000 + "x" * 5000 + " \n\t" * 4000 + "語" * 3000 + "<|endoftext|> 's 12"
    docs = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "a b", 7), (2, long, 7), (3, "a b", 7), (3, "a b", 7)], "doc_id long, text string, length long")
    tok = packing.ByteTokenizer(queries.BYTE_TOKENIZER)
    made = packing.tokenised(docs, tok, capacity=64, end_id=0)
    packed = packing.pack(made, 64)
    rows = packed.collect()
    assert sorted(r.length for r in rows if r.doc_id == 1) == [1, 1] and len([r for r in rows if r.doc_id == 3]) == 2
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(queries.BYTE_TOKENIZER).encode(long, add_special_tokens=False).ids + [0]
    assert [t for r in sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.piece) for t in r.ids] == want
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)
    assert sum(map(len, whole.values())) == sum(r.length for r in rows) and max(map(len, whole.values())) <= 64
    assert packing.pack(packing.tokenised(docs.limit(0), tok, 64), 64).collect() == []
    loose = spark.createDataFrame([("a", 3, 1), ("b", None, 2), ("c", 0, 3), ("d", 65, 4), ("e", 64, 5)], "name string, length long, offset int")
    got = {r.name: r for r in packing.pack(loose, 64).collect()}
    assert [got[k].sequence_id is None for k in "abcde"] == [False, True, True, True, False] and got["a"].offset == 0


def test_fast_ids_are_the_librarys_at_all_code_points_and_cuts():
    from tokenizers import Tokenizer

    tok, lib = packing.ByteTokenizer(queries.BYTE_TOKENIZER), Tokenizer.from_file(queries.BYTE_TOKENIZER)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} b " for c in points[k : k + 4000]) for k in range(0, len(points), 4000)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tok.encode(text).tolist() == want.ids
    assert tok._fast is not None
    rng = np.random.default_rng(4)
    parts = list(" \n\t'sSt.,!?aé語1_-|<>") + ["don't", "<|endoftext|>", "the", " a", "\r\n", "٣", "²"]
    for _ in range(300):
        text = "".join(rng.choice(parts, int(rng.integers(0, 80))))
        cut = list(packing.text_slices(text, 5))
        assert "".join(cut) == text
        if "<|endoftext|>" not in text:
            assert [t for part in cut for t in lib.encode(part, add_special_tokens=False).ids] == lib.encode(text, add_special_tokens=False).ids
        assert tok.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
