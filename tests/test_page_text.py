"""Text of pages: the same as Python's decoder and plain patterns give, in time that grows with the length."""

from __future__ import annotations

import html
import random
import re
import time

from pyspark.sql import functions as F

from pactum.functions import markup
from pactum.sources import tables


def _plain(page: str) -> str:
    for tag in tables.SILENT:
        page = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ", page)
    page = re.sub(r"(?s)<!--.*?-->", " ", page)
    page = re.sub(rf"(?i)</?({'|'.join(tables.BLOCKS)})\b[^>]*>", "\n", page)
    lines = html.unescape(re.sub(r"(?s)<[^>]+>", " ", page)).split("\n")
    lines = [re.sub(r"[ \t\r\f\x0b]+", " ", x).strip(" ") for x in lines]
    return "\n".join(x for x in lines if len(x) > tables.LEAST_LINE)


def _texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r["text"] for r in tables.html_text(df).orderBy("i").collect()]


def test_references_are_decoded_like_pythons(spark):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    texts = ["", "&", "&&amp;", "&#;", "&#x;", "&#xg;", "&notit;", "&notin;", "&ampamp;", "&copy2024", "&#0;", "&#x80;", "&#129;", "&#13;", "&#xD800;", "&#x110000;", "&#99999999999999999999999;", "&#xFFFE;", "&#x1F600;", "&#00000065", "&#xfdd0;x", "&#127;&#11;y", "&unknown;", "& lt;", "&LT", "&" + "a" * 40 + ";", "$1 &lt; \\1"]
    texts += ["&" + rng.choice(names) + rng.choice(["", "x", ";", " y", "&lt"]) for _ in range(1500)]
    texts += [f"a&#{rng.randrange(0x120000)}{rng.choice([';', ' ', 'b'])}&#x{rng.randrange(0x120000):x};" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(markup.unescaped(F.col("t"))).collect()]
    assert [(t, x) for t, x in zip(texts, got, strict=True) if x != html.unescape(t)] == []


def test_random_markup(spark):
    rng = random.Random(7)
    words = ["<script>", "<SCRIPT src='x'>", "</script >", "<nav class=a>", "</nav>", "<p>", "</p>", "<b>", "<!--", "-->", "<", ">", "&lt;", " some words of a text ", "long enough to be a line of text", "\n", "<br/>", "<scripted>", "<header\n>", "</header>"]
    pages = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    # <!--> is an empty comment here; an end tag inside a start tag closes that.
    odd = re.compile(r"<!--+>|<(script|nav|header)\b[^>]*</\1", re.I)
    pages = [p for p in pages if not odd.search(p)]
    assert len(pages) > 300
    assert [(p, x, _plain(p)) for p, x in zip(pages, _texts(spark, pages), strict=True) if x != _plain(p)] == []


def test_null_and_empty(spark):
    assert _texts(spark, [None, "", "<p>short</p>"]) == [None, "", ""]


def test_hostile_pages_take_linear_time(spark):
    n = 1_000_000
    _texts(spark, ["warm"])
    for piece in ("<script>", "<script ", "<", "<!--", "<nav></script>", "<p ", "</script>", "&amp", "<b <p>"):
        start = time.time()
        _texts(spark, [piece * (n // len(piece))])
        assert time.time() - start < 20, piece


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "html string")
    assert "Python" not in tables.html_text(df)._jdf.queryExecution().executedPlan().toString()
