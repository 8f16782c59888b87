"""Cases of single operators, and the registered queries on small tables of their own."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pactum.llm import bitslice, langid, pieces, queries, storage, urlfilter, warc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ---- WARC


def record(number: int, payload: bytes, extra: str = "") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{number}>\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def ids(content: bytes) -> list[str]:
    return [x["head"]["warc-record-id"] for x in warc.salvage(content) if "head" in x]


def test_digests_in_any_spelling_and_folded_headers():
    payload = b"some text"
    sha1, sha256 = hashlib.sha1(payload), hashlib.sha256(payload)
    good = [f"sha1:{sha1.hexdigest()}", f"sha1:{sha1.hexdigest().upper()}", f"sha1:{base64.b32encode(sha1.digest()).decode()}", f"sha256:{sha256.hexdigest()}", f"SHA-9:{'0' * 40}"]
    raw = [record(k, payload, f"WARC-Block-Digest: {d}\r\n") for k, d in enumerate(good)]
    raw.append(record(5, payload, "WARC-Target-URI: http://a/\r\n  and-more\r\n"))
    raw.append(record(6, payload, f"WARC-Block-Digest: sha1:{'0' * 40}\r\n"))
    assert ids(b"".join(raw)) == [f"<urn:{k}>" for k in range(6)]
    assert list(warc.salvage(raw[5]))[0]["head"]["warc-target-uri"] == "http://a/ and-more"


def test_records_inside_a_damaged_record_are_not_genuine():
    inner = record(9, b"quoted")
    bad = record(1, b"see " + inner + b" there", f"WARC-Block-Digest: sha1:{'0' * 40}\r\n")
    for content in (record(0, b"x") + bad + record(2, b"y"), gzip.compress(record(0, b"x") + bad + record(2, b"y"))):
        assert ids(content) == ["<urn:0>", "<urn:2>"]
        assert [x["reason"].split(" (")[0] for x in warc.salvage(content) if "reason" in x] == ["block digest differs"]


@pytest.mark.parametrize("flags", [8, 16, 24, 26, 30])
def test_member_headers_of_any_length(flags):
    plain = gzip.compress(record(1, b"x"))
    extra = (b"\x06\0ab\x02\0cd" if flags & 4 else b"") + b"n" * 50_000 + b"\0" + (b"c" * 5_000 + b"\0" if flags & 24 == 24 else b"")
    head = plain[:3] + bytes([flags]) + plain[4:10] + extra
    head += (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little") if flags & 2 else b""
    member = head + plain[10:]
    assert gzip.decompress(member) == record(1, b"x")
    assert ids(gzip.compress(record(0, b"x")) + b"\x1f\x8b\x08\x08junk" + member + gzip.compress(record(2, b"x"))) == ["<urn:0>", "<urn:1>", "<urn:2>"]


@pytest.mark.parametrize("part", [b"WARC/1.0\r\n", b"WARC/", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08abcdef", b"\x1f\x8b\x08\x1aabcdef", b"\x1f\x8b\x08\x08abcde\0", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0\r\nContent-Length: 9999999\r\n\r\n"])
def test_junk_takes_linear_time(part):
    start = time.time()
    assert ids(part * (1_000_000 // len(part)) + record(1, b"x")) == ["<urn:1>"]
    assert time.time() - start < 10


def test_gaps_are_logged(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(record(0, b"x") + b"junk" + record(1, b"y"))
    rows = storage.written(warc.read_warc(spark, str(tmp_path / "w")), "rows")
    records, gaps = warc.split_gaps(rows, str(tmp_path / "log"))
    assert records.count() == 2 and gaps == 1
    logged = spark.read.parquet(str(tmp_path / "log")).first()
    assert (logged["end"] - logged["start"], logged["reason"]) == (4, "neither a gzip member nor a version line")


# ---- URL rules


def brute_rule(url, rules: list[tuple[str, str]]) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("max_shapes", [2_000, 1])
def test_url_rules_against_brute_force(spark, max_shapes):
    rng = random.Random(1)
    rules = [("a.com/x", "allow"), ("a.com/x", "block"), ("b.a.com", "allow"), ("com/xx/y/", "block"), ("a.com/", "allow"), ("com/", "block")]
    rules += [(f"{rng.choice(['a.com', 'b.a.com', 'com'])}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(6)))}", rng.choice(["allow", "block"])) for _ in range(30)]
    rules = list(dict((r, v) for r, v in reversed(rules)).items()) + [("a.com/x", "block"), ("a.com/x", "allow")]
    urls = [f"http://{rng.choice(['', 'b.', 'c.b.'])}A.com/{''.join(rng.choice('xy/') for _ in range(rng.randrange(8)))}{rng.choice(['', '?q', '#f'])}" for _ in range(80)]
    urls += [None, None, "", "x", "http://", "http://a.com/" + "x" * 100_000, urls[0], urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    got = urlfilter.judge_urls(df, spark.createDataFrame(rules, "rule string, verdict string"), max_shapes=max_shapes).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute_rule(u, rules) for u in urls]


# ---- top-k


@pytest.mark.parametrize(("row_block", "query_block"), [(None, None), (7, 3), (1, 1)])
def test_top_k_of_odd_tables(spark, row_block, query_block):
    rows = [(k, [1, -2, 3]) for k in range(40)] + [(40, []), (41, None), (None, [1, 1, 1]), (42, [5]), (3, [0, 0, 9])]
    df = spark.createDataFrame(rows, "id long, vec array<long>").withColumn("score", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bitslice.top_k(df, df.where("id % 20 = 0"), 5, row_block, query_block).collect()}
    known = [(i, v + [0] * (3 - len(v))) for i, v in rows if i is not None and v is not None]
    for q in (0, 20, 40):
        vec = next(v for i, v in known if i == q)
        want = sorted((-int(np.dot(vec, v)), i) for i, v in known if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]


# ---- languages


def test_votes_against_brute_force(spark):
    rng = random.Random(5)
    alphabets = {"de": "abcdefgh", "en": "abcdijkl", "nl": "abcdmnop", "fr": "qrstuvwx", "es": "qrstyzab", "xx": "0123é漢", "fi": "aeioukln"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(30)), lang) for i, lang in enumerate(sorted(alphabets) * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert {model.family_of[x] for x in ("de", "en", "nl")} == {"germanic"} and model.family_of["xx"] == "xx"
    tests = ["abc def " * 20, "a", "qrst uvwx yz", "é漢 é漢", rows[3][1], rows[3][1], "Ä1 " * 9]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string").withColumn("lang", F.lit("clash")), model).collect()}
    for i, text in enumerate(tests):
        raw = f" {text.lower()} ".encode()
        codes = [b if b >= 128 or chr(b).isalpha() else 32 for b in raw]
        grams = [((codes[k] | codes[k + 1] << 8 | codes[k + 2] << 16) * 2654435761 % 2**32) >> (32 - langid.BITS) for k in range(len(codes) - 2)]
        margin = sum(model.weights[g].astype(float) for g in grams) / len(grams) + model.bias
        chance = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
        family = {model.families[t[1]]: chance[k] for k, t in enumerate(model.tasks) if t[0] == "family"}
        best = max(model.families, key=lambda f: family[f])
        inside = [x for x in model.langs if model.family_of[x] == best]
        votes = {x: [] for x in inside}
        for k, t in enumerate(model.tasks):
            if t[0] == "pair" and model.langs[t[2]] in votes:
                votes[model.langs[t[2]]].append(chance[k])
                votes[model.langs[t[3]]].append(1 - chance[k])
        within = {x: np.mean(v) if v else 1.0 for x, v in votes.items()}
        want = max(inside, key=lambda x: within[x])
        assert got[i]["lang_pred"] == want
        assert got[i]["score"] == pytest.approx(family[best] / sum(family.values()) * within[want])
    assert got[4][1:] == got[5][1:]


def test_a_long_text_is_predicted_in_pieces(spark):
    import tracemalloc

    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30)), lang) for i, (lang, letters) in enumerate([("de", "abcdef"), ("en", "defghi"), ("fr", "xyzuvw")] * 30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    part = np.frombuffer(b" abcdefghi xyz", dtype=np.uint8)
    data = np.tile(part, 600_000)
    offsets = np.array([0, 3, 3, 65_536, 65_538, 65_540, len(data) - 7, len(data)])
    tracemalloc.start()
    best, score = model.predict(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
    for k in range(len(offsets) - 1):
        one, own = model.predict(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
        assert best[k] == one[0] and score[k] == pytest.approx(own[0], rel=1e-9)


def test_training_is_bounded(spark, monkeypatch):
    rows = [(i, f"word{i} " * 400, f"l{i % 10}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_SAMPLE_BYTES", 200_000)
    taken = []
    old = langid._prepared
    monkeypatch.setattr(langid, "_prepared", lambda column: taken.append(sum(len(x.as_py()) for x in column)) or old(column))
    model = langid.train(df)
    assert taken[0] < 400_000 and len(model.langs) > 5


# ---- SentencePiece


def test_long_and_foreign_words_are_the_librarys():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = ["".join(rng.choice("漢字仮名交文日本語的是不了人") for _ in range(n)) for n in (1, 39, 41, 500)]
    texts += ["".join(rng.choice("กขคงจฉชซญ") for _ in range(300)), "internationalisation" * 30, "a" * 41, "é" * 90, "x  y   z    " * 20, " nbsp ", "don't " * 50, "\0 nul", " ", "  "]
    texts += [" ".join("".join(rng.choice("thenrsiaouedbl%*#") for _ in range(rng.randrange(1, 14))) for _ in range(4000)) for _ in range(4)]
    encoder = pieces.Encoder(pieces.Vocabulary(MODEL), max_words=3000)
    for _ in range(2):
        got, at = encoder.encode(texts)
        for i, t in enumerate(texts):
            assert got[at[i] : at[i + 1]].tolist() == library.encode(t)


# ---- the registered queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with small tables that hold nulls, repeats, ties and columns with clashing names."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(12)
    words = "der die das und the of and to le la les el los que".split()
    texts = [" ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts += [texts[0], texts[0] + " more", None, "", "12 34", "x" * 50_000]
    docs = [(i, t, ("de", "en", "fr", "es", None)[i % 5], ("s1", "s2", None)[i % 3], len(t or ""), "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{folder}/documents.parquet")
    pages = [(i, u, f"<html><body><nav>menu</nav><article><h1>{i % 7}</h1><p>{texts[i % 7]}</p></article></body></html>" if i % 9 else None, "clash") for i, u in enumerate(["http://a.org/de/1", "https://Example.org/en/12?x", None, "", "http://b.com/fr/#y"] * 6)]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(130)] + [(200, None), (201, [float("nan")] * 8), (202, [None] * 8)] + [(220, [0.5] * 8), (240, [0.5] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_queries_give_what_their_sql_gives(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    result = con.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    got = entry.queries()[name](spark, tables)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, result.fetchall()))


def test_queries_without_sql_on_the_same_tables(spark, tables):
    import sentencepiece

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    run = entry.queries()
    ordered = sorted(docs)
    got = {r["doc_id"]: r for r in run["op5_editsketch"](spark, tables).collect()}
    assert sorted(got) == ordered
    for i, nxt in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, half = docs[i], len(docs[i]) // 2
        edited = t[: len(t) - half] + docs[nxt][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["near_next"] <= 1 and (edited != t or got[i]["near_edited"] == 1)
    assert got[60]["group_id"] == 0 and got[60]["fingerprint"] == got[0]["fingerprint"]
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in run["op6_htmltext"](spark, tables).collect()}
    assert texts == {i: (x, len(x)) for i in range(30) for x in [f"{i % 7} {docs[i % 7]}" if i % 9 else ""]}
    langs = run["op8_langid"](spark, tables).collect()
    assert sorted(r["doc_id"] for r in langs) == ordered
    assert {r["doc_id"] for r in langs if r["lang_pred"] == "und"} == {62, 63, 64}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["ids"] for r in run["op9_pieces"](spark, tables).collect()} == {i: library.encode(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["n_pieces"] for r in run["op10_piece_counts"](spark, tables).collect()} == {i: len(library.encode(t)) for i, t in docs.items()}


def test_the_whole_pipeline(spark, tables):
    import sentencepiece

    import corpus_pipeline

    out = entry.queries()["pipeline"](spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"] for r in out} == set(kept) and not set(kept) & {60, 62, 63, 64}
    assert all(r["ids"] == library.encode(kept[r["doc_id"]]) for r in out)
