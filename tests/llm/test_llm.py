import gzip
import hashlib
import os
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.llm import bitslice, components, editsketch, htmltext, langid, minhash, mixing, piece_counts, pieces, urlfilter, warc
from pactum.llm.storage import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ---- WARC


def archive() -> tuple[bytes, list[bytes]]:
    raw = [warc.record_bytes(warc.ID.format(i), f"http://a/{i}", f"page {i} WARC/1.0 \x1f".encode() * 20, None) for i in range(6)]
    return b"".join(gzip.compress(r) for r in raw), [gzip.compress(r) for r in raw]


def ids(content: bytes) -> list[str]:
    return [x["head"]["warc-record-id"] for x in warc.salvage(content) if "head" in x]


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "swap"])
def test_salvage_finds_all_records_but_the_damaged_one(damage):
    _, parts = archive()
    bad = bytearray(parts[2])
    if damage == "flip":
        bad[len(bad) // 2] ^= 255
    elif damage == "cut":
        bad = bad[:-9]
    elif damage == "junk":
        bad = b"\x1f\x8b\x08garbage" * 5
    else:
        bad = gzip.compress(b"WARC/1.0\r\nno colon\r\n\r\n")
    content = b"".join([*parts[:2], bytes(bad), *parts[3:]])
    assert ids(content) == [warc.ID.format(i) for i in (0, 1, 3, 4, 5)]
    gaps = [x for x in warc.salvage(content) if "reason" in x]
    assert [(g["at"], g["end"]) for g in gaps] == [(len(parts[0] + parts[1]), len(parts[0] + parts[1]) + len(bad))]


def test_plain_records_with_a_wrong_length_and_a_wrong_digest():
    raw = [warc.record_bytes(warc.ID.format(i), None, b"x" * i, None) for i in range(4)]
    raw[1] = raw[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    raw[2] = raw[2].replace(b"xx\r\n\r\n", b"xy\r\n\r\n")
    assert ids(b"".join(raw)) == [warc.ID.format(0), warc.ID.format(3)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_salvage_never_fails_and_covers_all_bytes(junk):
    content, parts = archive()
    found = list(warc.salvage(junk + content))
    assert sum("head" in x for x in found) >= 5
    assert found[-1]["end"] == len(junk + content)


def test_members_of_several_records_lose_only_the_damaged_ones(spark, tmp_path):
    rng = random.Random(5)
    raw = [warc.record_bytes(warc.ID.format(i), None, bytes(rng.randrange(97, 123) for _ in range(3000)), None) for i in range(6)]
    raw[2] = raw[2].replace(b"\r\n\r\n", b"\r\nno colon\r\n\r\n", 1)
    grouped = gzip.compress(b"".join(raw))
    assert ids(grouped) == [warc.ID.format(i) for i in (0, 1, 3, 4, 5)]
    gaps = [x for x in warc.salvage(grouped) if "reason" in x]
    start = len(raw[0] + raw[1])
    assert [g["reason"] for g in gaps] == [f"header line without a colon (bytes {start} to {start + len(raw[2])} of the inflated member)"]
    for level in (9, 0):
        whole = gzip.compress(raw[0] + raw[1] + raw[3] + raw[4], level)
        at = len(whole) * 5 // 8
        cut, bad = whole[:at], whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
        assert ids(cut) == [warc.ID.format(i) for i in (0, 1)]
        assert ids(cut + gzip.compress(raw[5])) == [warc.ID.format(i) for i in (0, 1, 5)]
        assert ids(bad)[:2] == [warc.ID.format(i) for i in (0, 1)] and len(set(ids(bad))) == len(ids(bad))
    (tmp_path / "a.warc").write_bytes(raw[0])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[1]))
    assert warc.read_warc(spark, str(tmp_path)).where("status = 'record'").count() == 2
    assert warc.read_warc(spark, str(tmp_path), files="*.gz").count() == 1


def test_headers_of_any_length_come_back(spark, tmp_path):
    rows = [(1, "http://a/" + "x" * 100_000, "same"), (2, "http://b/" + "\n" * 100_000, "same"), (3, "c", "own")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).select("status", "warc_type", "target_uri", warc.record_key("record_id").alias("k")).orderBy("k").collect()
    assert [(r["status"], r["k"], r["warc_type"], len(r["target_uri"])) for r in back] == [("record", 1, "response", 100_009), ("record", 2, "revisit", 300_009), ("record", 3, "response", 1)]
    plain = b"".join(warc.record_bytes(warc.ID.format(i), "http://" + "y" * 100_000 * i, b"x", None) for i in range(3))
    assert ids(plain) == [warc.ID.format(i) for i in range(3)]


def test_pages_come_back_from_archives(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "same"), (2, "http://b", "same"), (3, None, None), (4, "c", ""), (5, "d", "é" * 50_000), (5, "d", "other"), (None, "e", "lost")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    warc.write_warc(df, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.where("status = 'gap'").count() == 0
    got = sorted((r["k"] if r["k"] is not None else -1, r["warc_type"], r["payload_bytes"], r["f"]) for r in back.select("*", warc.record_key("record_id").alias("k"), warc.record_key("refers_to").alias("f")).collect())
    assert got == [(-1, "response", 4, None), (1, "response", 4, None), (2, "revisit", 4, 1), (3, "response", 0, None), (4, "revisit", 0, 3), (5, "response", 5, None), (5, "response", 100_000, None)]


# ---- URL rules


def test_url_rules(spark):
    rules = spark.createDataFrame([("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("example.org", "block"), (None, "block")], "rule string, verdict string")
    urls = ["https://WWW.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org?x", "http://myexample.org/es/", "nothing", None, "http://a.com/é#x", "http://example.org/en/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("clash"))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, rules).orderBy("page_id").collect()]
    assert got == [
        ("www.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "", "example.org", "block"),
        ("myexample.org", "/es/", "org/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.com", "/é", None, "allow"),
        ("example.org", "/en/2", "example.org", "block"),
    ]
    assert urlfilter.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0


# ---- mixing


def brute_targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """By repeated resharing of what is above a source's limit."""
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (share * sum(sizes) - sum(fixed.values())) / (sum(weights[i] for i in free) or 1)
        over = [i for i in free if weights[i] * level > most * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in over}


def test_targets_stop_at_the_limit_and_share_the_rest(spark):
    for sizes, share in (([100, 1000, 1000], 1.5), ([5, 7, 11, 0], 1.5), ([0, 0], 1.5), ([10, 20], 3.0), ([1, 2, 3, 4, 5, 600], 1.7)):
        # The last source is null.
        rows = spark.createDataFrame([(f"s{i}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows, (3, 1, 2), share, 2).collect()}
        want = brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], share, 2)
        assert [got[f"s{i}" if i < len(sizes) - 1 else None] for i in range(len(sizes))] == pytest.approx(want)


def brute_rate(sizes: list[int], rest: float) -> tuple[float, set[int]]:
    """The chance for each word, and the sizes that are certain, by peeling off one size at a time."""
    sure: set[int] = set()
    while True:
        left = [n for n in sizes if n and n not in sure]
        rate = (rest - sum(n for n in sizes if n in sure)) / (sum(n * n for n in left) or 1)
        if not left or rate * max(left) <= 1:
            return rate, sure
        sure.add(max(left))


def test_certain_documents_leave_the_rest_to_the_others(spark):
    sizes = [900, 500, 500, 40, 30, 20, 10, 10, 5, 5, 5, 1, 1, 0]
    hist = spark.createDataFrame([("a", n, sizes.count(n)) for n in set(sizes)], "source string, size long, c long")
    for rest in (0.5, 30.0, 1200.0, 1980.0, 2000.0):
        rate, sure = brute_rate(sizes, rest)
        got = mixing._rates(hist, spark.createDataFrame([("a", rest)], "source string, rest double")).first()
        assert got["rate"] == pytest.approx(rate) and got["certain"] == sum(n for n in sizes if n in sure)
        # Expected words are the rest.
        assert sum(n if n in sure else rate * n * n for n in sizes) == pytest.approx(rest)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(3000)] + [(3000, None, "a"), (3001, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    one = mixing.mix(df, bins=16)
    out = one.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["t"] - r["goal"]) <= 60 and r["over"] <= 0 for r in out)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, one.collect())) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


# ---- components and near-duplicates


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_components(texts: list, width: int) -> list[int]:
    import re

    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 120, 200]))]
        for _ in range(40 if g == 0 else 8):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", None, "  \n ", "A b", "a B", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = minhash.near_duplicates(df, 4).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_components(texts, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()) == [(0, None, True), (1, 1, True), (1, 1, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bucket_members_far_from_the_pivot_are_compared(spark, monkeypatch):
    """Each bucket of 5 or 40 documents has pairs that its least member has next to nothing in common with."""
    rng = random.Random(11)
    docs, bucket_of = [], {}
    for b, size in enumerate([5] * 12 + [40] * 2):
        for k in range(size):
            if k in (1, 3):
                words = docs[-1][1].split()
                words[50] = f"x{b}_{k}"
            else:
                words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
            bucket_of[len(docs)] = b
            docs.append((len(docs), " ".join(words)))
    # A pair of which one has 28 % in common with a third, and the other 22 %.
    base = [f"s{i}" for i in range(100)]
    third = base[:45] + [f"t{i}" for i in range(55)]
    other = [f"r{i}" for i in range(7)] + base[7:]
    for words in (base, third, other):
        bucket_of[len(docs)] = 99
        docs.append((len(docs), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = F.create_map(*[F.lit(x) for item in bucket_of.items() for x in item])
    monkeypatch.setattr(minhash, "_buckets", lambda nodes, tables: written(nodes.select("set_id", near[F.col("doc_id").cast("int")].cast("long").alias("key")), "buckets"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 4).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for _, t in docs]
    want = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i] = min(want[i], want[j])
    assert sum(i != w for i, w in enumerate(want)) == 29
    assert [got[i] for i in range(len(docs))] == want


# ---- fingerprints


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=20), st.text("abc", max_size=20), st.integers(0, 8))
def test_edit_distance(a, b, limit):
    assert editsketch.edit_distance(a, b, limit) == min(distance(a, b), limit + 1)


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh é漢") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["", None, "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = {r["doc_id"]: r for r in editsketch.fingerprints_with_edits(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i]["near_edited"] == 1.0
    long = [got[i] for i in range(59) if got[i]["n_chars"] > 100 and got[i + 1]["n_chars"] > 100]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    walker = editsketch.Walker()
    one = walker.fingerprints(["same text", "other", "same text"])
    assert (one[0] == one[2]).all()
    assert editsketch.fingerprints_with_edits(df.limit(0)).count() == 0


def test_near_texts(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij ") for _ in range(600))
    other = "".join(rng.choice("abcdefghij ") for _ in range(600))
    rows = [("1", base), ("2", base[:300] + "XY" + base[300:]), ("3", base), ("4", other), ("5", None), (None, base), ("6", ""), ("7", "x"), ("7", "x"), ("8", "x" * 300_000), ("9", "x" * 299_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("group_id", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = sorted(((r["doc_id"], r["group_id"]) for r in editsketch.near_texts(df).collect()), key=str)
    assert got == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "5"), ("6", "6"), ("7", "7"), ("7", "7"), ("8", "8"), ("9", "8"), (None, None)]
    full = editsketch.fingerprints_with_edits(df)
    assert sorted(((r["doc_id"], r["group_id"]) for r in full.collect()), key=str) == got
    assert editsketch.near_texts(df.limit(0)).count() == 0


def edits(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = [rng.choice("abcdefghij")] * (kind < 2)
    return "".join(out)


@pytest.mark.parametrize("settle", [True, False])
def test_near_texts_against_brute_force(spark, settle):
    """Links are exact; of those that there are, nine in ten or more are found, at every length."""
    rng = random.Random(7)
    texts = []
    shared = "".join(rng.choice("abcdefghij ") for _ in range(400))
    for length in (60, 200, 800, 3000, 9000):
        for _ in range(12):
            base = "".join(rng.choice("abcdefghij ") for _ in range(length))
            texts += [base, edits(rng, base, rng.randrange(1, max(2, length // 33)))]
    # Texts that share a passage and little else: their buckets hold strangers.
    for _ in range(30):
        own = shared + "".join(rng.choice("abcdefghij ") for _ in range(400))
        texts += [own, edits(rng, own, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["group_id"] for r in editsketch.near_texts(df, 0.03, settle=settle).collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= 0.03 * max(len(texts[i]), len(texts[j]))]
    linked = [(i, j) for i, j in pairs if editsketch.edit_distance(texts[i], texts[j], int(0.03 * max(len(texts[i]), len(texts[j])))) <= int(0.03 * max(len(texts[i]), len(texts[j])))]
    found = [group[i] == group[j] for i, j in linked]
    assert np.mean(found) >= 0.95
    for low, high in ((0, 500), (500, 2000), (2000, 20_000)):
        assert np.mean([f for f, (i, _) in zip(found, linked, strict=True) if low <= len(texts[i]) < high]) >= 0.9
    assert {(group[i], group[j]) for i, j in linked} >= {(g, g) for i, g in group.items() if i != g}
    apart = np.zeros(60, dtype=np.int64)
    apart[::2] = np.arange(30) + 1
    want = {(i, j) for i, j in linked if j < 60 and apart[i] != apart[j]}
    got = {tuple(sorted(x)) for x in editsketch._near(texts[:60], 0.03, apart)}
    assert got <= want
    # Groups, if not each link: what is linked is in one group.
    group = apart.copy()
    for i, j in got:
        group[group == group[j]] = group[i]
    assert all(group[i] == group[j] for i, j in want)


# ---- main text


def main_texts(spark, pages: list, **options) -> list[str]:
    rows = [(i, f"http://host/{i}", p) if not isinstance(p, tuple) else (i, *p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    return [r["text"] for r in sorted(htmltext.extract_main_text(df, **options).collect(), key=lambda r: r["page_id"])]


def test_main_text_by_markup(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href="/">home</a></ul></nav><div class="ad">buy</div><!-- note --><article><header><h1>Title &amp; &lt;more&gt;</h1></header>
    <p>One <b>two</b>three.<br>four<p>five&nbsp;six<aside>side</aside><form><input>mail</form><section id="comments"><p>first!</p></section></article><footer>&copy;</footer></body></html>"""
    odd = ["", "plain text", "<p>", "<p a='>'>x</p>", None, "a < b & c > d <e", "<p title=\"a>b\">q</p> <!-- no end", "<select><option>x</select>y<button>Go<p>z", "<script>no end"]
    assert main_texts(spark, [page, *odd]) == ["Title & <more> One twothree. four five six", "", "plain text", "", "x", "", "a < b & c > d <e", "q", "y Go z", ""]
    kept = '<article><h1>T</h1><p id="related-work">What came before</p><p class="notice">As noticed</p><ul class="menu-of-the-day"><li>Soup</ul></article>'
    assert main_texts(spark, [kept]) == ["T What came before As noticed Soup"]


def test_small_marked_blocks_within_articles_go_if_they_repeat(spark):
    story = "<p>The {0} boat left the {0} harbour early, and all who had come to see it waved until the fog took it away.</p>"
    shared = "<p>" + "One passage of many words that two articles quote. " * 6 + "</p>"
    box = '<div class="newsletter">Sign up for {0}</div><div class="ad">BUY</div>'

    def page(name: str, more: str = "") -> str:
        return f"<body><nav>Home {name}</nav><article><h1>{name}</h1>{story.format(name)}{shared}{more}</article>"

    def text(name: str, more: str = "") -> str:
        return f"{name} The {name} boat left the {name} harbour early, and all who had come to see it waved until the fog took it away. " + ("One passage of many words that two articles quote. " * 6).strip() + more

    pages = [page("red", box.format("news")), page("blue", box.format("more")), page("green", '<p class="ad">BUY</p>'), page("green", '<p class="ad">BUY</p>')]
    want = [text("red", " Sign up for news"), text("blue", " Sign up for more"), text("green", " BUY"), text("green", " BUY")]
    assert main_texts(spark, pages) == want
    assert main_texts(spark, pages, max_broadcast=0) == want
    assert main_texts(spark, pages, repeats=False)[0] == text("red", " Sign up for news BUY")
    # Copies of one article are one article, whatever stands around it; other hosts do not count.
    copies = [("http://a.com/", page("red", box.format("news"))), ("http://a.com/", "<p>x</p>" + page("red", box.format("news"))), ("http://b.com/", page("blue", box.format("news")))]
    assert main_texts(spark, copies) == [text("red", " Sign up for news BUY")] * 2 + [text("blue", " Sign up for news BUY")]
    # A block that is more than a quarter of the article is no notice.
    large = ["<article><h1>{}</h1><div class=body>The whole of what there is to read on this page, word for word.</div></article>".format(x) for x in "ab"]
    assert main_texts(spark, large) == [f"{x} The whole of what there is to read on this page, word for word." for x in "ab"]


def test_main_with_teasers_is_the_text(spark):
    assert main_texts(spark, ["<main><article>teaser</article><p>the text proper</p></main><p>beside</p>"]) == ["teaser the text proper"]
    assert main_texts(spark, ["<main><article>the text proper, at length</article><p>more like it</p></main>"]) == ["the text proper, at length"]


def test_hostile_pages_take_linear_time():
    import time

    for part in ("<a b", "<a b>", '<a b="', "<a b='>\"", "</x>", "<title>", "<!--", "<div>", "<", "&amp", "<button>", "<p><b></p>"):
        start = time.time()
        htmltext.blocks_of(part * (1_000_000 // len(part)))
        assert time.time() - start < 6, part


def brute_main_texts(pages: list[tuple[str, str]], n: int = 8) -> list[str]:
    """Of pages (host, html) without articles: every token in a run that another page of the host has too goes."""

    def streams(source: str) -> list[list[str]]:
        return [[b.mark, *b.text.lower().split(" ")] for b in htmltext.blocks_of(source)]

    def substrings(source: str) -> list[tuple[int, tuple]]:
        own = streams(source)
        flat, at = [w for b in own for w in b], np.cumsum([0, *map(len, own)])
        return [(k, tuple(flat[k : k + n])) for k in range(len(flat) - n + 1)] + [(int(at[k]), ("short", *b)) for k, b in enumerate(own) if len(b) < n]

    on: dict[tuple, set] = {}
    for host, source in pages:
        for _, w in substrings(source):
            on.setdefault((host, w), set()).add(source)
    out = []
    for host, source in pages:
        gone = set()
        for k, w in substrings(source):
            if len(on[host, w]) > 1:
                gone |= set(range(k, k + (n if w[0] != "short" else len(w) - 1)))
        at, kept = 0, []
        for b in htmltext.blocks_of(source):
            words = [w for i, w in enumerate(b.text.split(" "), at + 1) if i not in gone]
            at += 1 + len(b.text.split(" "))
            kept += [" ".join(words)] * bool(words and not b.dropped)
        out.append(" ".join(kept))
    return out


@pytest.mark.parametrize("max_broadcast", [1_000_000, 0])
def test_repeats_of_a_host_against_brute_force(spark, max_broadcast):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    pages = []
    for k in range(60):
        blocks = ["<nav>home and news</nav>"] * (k % 2) + [f"<div class=d{rng.randrange(2)}>{' '.join(rng.choice(words) for _ in range(rng.randrange(1, 14)))}</div>" for _ in range(rng.randrange(0, 5))]
        pages.append((f"h{k % 3}", "".join(blocks) + ("<div>please subscribe to our weekly letter and read all that is new on this site</div>" if k % 4 else "")))
    pages += [pages[0]] * 3 + [("h9", pages[0][1])]
    got = main_texts(spark, [(f"http://{h}/x", p) for h, p in pages], max_broadcast=max_broadcast)
    assert got == brute_main_texts(pages)
    # Two of two pages, and two of forty.
    shared, own = "<div>read our news each week and tell all of your friends</div>", ["<p>the first text</p>", "<p>a second text</p>"]
    two = [shared + x for x in own]
    assert main_texts(spark, two, max_broadcast=max_broadcast) == ["the first text", "a second text"]
    assert main_texts(spark, two + [f"<p>page number {i} of many</p>" for i in range(38)], max_broadcast=max_broadcast)[:2] == ["the first text", "a second text"]
    assert main_texts(spark, two[:1] * 2, max_broadcast=max_broadcast) == ["read our news each week and tell all of your friends the first text"] * 2


def test_articles_stay_whole_and_mark_what_is_not_text(spark):
    shared = "<div>Big sale of shoes today and all of this week in our shop</div>"
    pages = [f"{shared}<div class=ad>Ad {i}</div><article><p>Copied text that all of these pages have word for word</p></article>" for i in range(3)]
    pages.append(f"{shared}<div>A page without an article has its own words</div>")
    want = ["Copied text that all of these pages have word for word"] * 3 + ["A page without an article has its own words"]
    assert main_texts(spark, pages) == want
    off = main_texts(spark, pages, repeats=False)
    assert off[:3] == want[:3] and off[3].startswith("Big sale")
    assert main_texts(spark, [(None, pages[3]), ("", pages[3])]) == [off[3]] * 2


# ---- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(300)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, e array<double>").select("id", bitslice.quantised(F.col("e"), 16).alias("vec"), F.lit(1).alias("score"))
    got = {}
    for r in bitslice.top_k(df, df.where("id % 20 = 0"), 7, row_block=100, query_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    m = np.floor(16 * np.array([v for _, v in rows[:300]])).astype(int)
    for q in range(0, 300, 20):
        best = sorted(((-int(m[q] @ m[i]), i) for i in range(300) if i != q))[:7]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    few = df.where("id < 3")
    assert bitslice.top_k(few, few.where("id = 0"), 7).count() == 2
    assert bitslice.top_k(df.limit(0), df.limit(0)).count() == 0


# ---- languages


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "sh", "wh"], "de": ["der", "ung", "sch", "ein", "ü"], "fr": ["le", "eau", "é", "ment", "ç"], "es": ["el", "ción", "ñ", "os", "ar"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", "fr"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 5 <> 2 OR doc_id >= 900"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df.withColumn("score", F.lit(0)), model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    assert [got[i][0] for i in (900, 901, 902)] == ["und"] * 3
    assert langid.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


# ---- SentencePiece


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("abcehinorst THE.,\n\t▁é漢字\U0001f600\0 ")), max_size=60))
def test_ids_and_counts_are_the_librarys(text, vocab, library):
    enc = test_ids_and_counts_are_the_librarys.__dict__.setdefault("enc", None) or pieces.Encoder(vocab)
    cnt = test_ids_and_counts_are_the_librarys.__dict__.setdefault("cnt", None) or piece_counts.Counter(vocab)
    test_ids_and_counts_are_the_librarys.__dict__.update(enc=enc, cnt=cnt)
    want = library.encode(text)
    ids_, at = enc.encode([text, "x"])
    assert ids_[: at[1]].tolist() == want
    assert cnt.count([text])[0] == len(want)


def test_unigram_paths_are_the_librarys(vocab, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(Path(MODEL).read_bytes())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = pieces.Vocabulary(str(path))
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdehilnorstu .,é漢ไ") for _ in range(rng.randrange(0, 50))) for _ in range(300)] + ["the " * 20, "internationalization", "a" * 90]
    got, at = pieces.Encoder(own).encode(texts)
    counts = piece_counts.Counter(own).count(texts)
    for i, want in enumerate(library.encode(texts)):
        assert got[at[i] : at[i + 1]].tolist() == want
        assert counts[i] == len(want)


def test_round_trip_and_odd_rows(spark, vocab):
    rows = [(1, "Hello  world\n é 漢字 \U0001f600"), (2, ""), (3, None), (4, "x" * 20_000), (5, " lead"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = pieces.encode(df, vocab)
    assert coded.where("NOT round_trip").count() == 0
    back = sorted((r["doc_id"], r["text"]) for r in pieces.decode(coded, vocab).collect())
    assert back == sorted((k, t or "") for k, t in rows)
    counts = piece_counts.count_pieces(df, vocab)
    assert sorted((r["doc_id"], r["n_pieces"]) for r in counts.collect()) == sorted((r["doc_id"], r["n_pieces"]) for r in coded.collect())
    assert pieces.encode(df.limit(0), vocab).count() == 0


# ---- pipeline


def brute_mix(rows: list[tuple]) -> dict[int, int]:
    """Copies of each (doc_id, text, source), by one sort for each source."""
    import re

    size = {i: len(re.findall(mixing.WORD, t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(size[i] for i, _, s in rows if s == name) for name in names]
    goals = brute_targets(totals, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    out = {}
    for name, total, goal in zip(names, totals, goals, strict=True):
        whole = int(goal // total)
        rest = goal - whole * total
        own = [i for i, _, s in rows if s == name]
        rate, sure = brute_rate([size[i] for i in own], rest)
        ranked = []
        for i in own:
            out[i] = whole
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            chance = rate * size[i]
            if size[i] and rest > 0:
                ranked.append((0.0 if size[i] in sure else (u / (1 - u)) / (chance / (1 - chance)), i))
        run = 0
        for _, i in sorted(ranked):
            out[i] += run + size[i] / 2 <= rest
            run += size[i]
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path, library):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    if not os.path.isdir(src):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "source_mixing", "sentencepiece"]

    def step(k: int) -> list[tuple]:
        nonlocal docs
        out = corpus_pipeline.STAGES[k][1](spark, docs, src)
        assert k == 3 or out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        return docs.collect()

    before = docs.collect()
    first = step(0)
    assert sorted(r["doc_id"] for r in first) == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
    known = {r["doc_id"]: r["lang"] for r in before}
    assert np.mean([r["lang"] == known[r["doc_id"]] for r in first if known[r["doc_id"]]]) > 0.95
    first.sort(key=lambda r: r["doc_id"])
    comp = brute_components([r["text"] for r in first], 5)
    second = step(1)
    assert sorted(r["doc_id"] for r in second) == [r["doc_id"] for k, r in enumerate(first) if comp[k] == k]
    copies = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in second])
    third = step(2)
    assert sorted(r["doc_id"] for r in third) == sorted(i for i, n in copies.items() for _ in range(n))
    texts = {r["doc_id"]: r["text"] for r in third}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in step(3))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string, copy string, size string, set_id string"


def odd_documents(spark, rows: list[tuple]):
    """Documents with columns named like those that the stages use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 5) for r in rows], ODD)


def test_stages_keep_odd_rows_apart(spark):
    import corpus_pipeline

    long = "the same words in every row but " + " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, long, "en", "a"), (1, long, "en", "a"), (2, long + " more", "en", "b"), (3, "der eine und der andere Hund", "de", None),
        (3, "quite another text under that id", "en", "a"), (None, "no id at all here", None, "b"), (None, "no id at all here", None, "b"),
        (4, None, "en", "a"), (5, "", "en", None), (6, "12 34", "de", "b"), (7, "word " * 50_000, "en", "a"), (8, "x", None, None),
    ]
    docs = odd_documents(spark, rows)
    found = corpus_pipeline.identify(spark, docs, "")
    assert found.dtypes == docs.dtypes and found.where("score = 'clash' AND set_id = 'clash'").count() == len(rows) - 3
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, None, 7, 8}

    once = corpus_pipeline.dedup(spark, docs, "")
    assert once.dtypes == docs.dtypes
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in once.collect())
    assert got == [(0, "no id at "), (0, "no id at "), (1, "the same "), (3, "der eine "), (3, "quite ano"), (4, ""), (5, ""), (6, "12 34"), (7, "word word"), (8, "x")]

    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.dtypes == docs.dtypes
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"], r["text"], r["source"]] = taken.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    assert all(n <= 2 * rows.count((i, t, lang, s)) for (i, t, s), n in taken.items() for _, _, lang, _ in [next(r for r in rows if (r[0], r[1], r[3]) == (i, t, s))])
    assert all(n % rows.count(next(r for r in rows if (r[0], r[1], r[3]) == k)) == 0 for k, n in taken.items())
    assert sorted(r["n_pieces"] for r in corpus_pipeline.tokenize(spark, docs, "").collect())[:2] == [0, 0]


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    docs = odd_documents(spark, [(1, "a", "en", "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.tokenize(spark, docs, "").count() == 0


def test_operators_take_empty_tables(spark, vocab, tmp_path):
    docs = odd_documents(spark, [(1, "a", "en", "a")]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "id long, vec array<long>")
    warc.write_warc(pages, str(tmp_path / "w"), min_bytes=0)
    results = [
        warc.read_warc(spark, str(tmp_path / "w")), urlfilter.judge_urls(pages, spark.createDataFrame([], "rule string, verdict string")), mixing.mix(docs),
        minhash.near_duplicates(docs), editsketch.fingerprints_with_edits(docs), editsketch.near_texts(docs), htmltext.extract_main_text(pages),
        bitslice.top_k(vectors, vectors), langid.identify(docs, langid.train(docs)), pieces.encode(docs, vocab), piece_counts.count_pieces(docs, vocab),
    ]
    assert [r.count() for r in results] == [0] * len(results)
