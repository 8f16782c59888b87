"""URL rules by host suffix and path prefix, found through short hash prefixes.

Each URL is expanded into its host-suffix and path-prefix expressions; these are joined to the rules on
the first hex digits of their SHA-256 and confirmed on the whole digest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.storage import broadcast_if_small

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", hash_digits: int = 8, max_broadcast_rules: int = 100_000, max_shapes: int = 2_000) -> DataFrame:
    """The verdict of ``rules(rule, verdict)`` on every row's URL: page id, host, path, rule, verdict.

    A rule is a host followed by a path, such as ``example.org/en/``; it fits that host and all its
    subdomains if the URL's path starts with the rule's.  The longest rule wins, then the longer host,
    then ``block``.  A URL that no rule fits, and one that is null or has no ``://``, gets a null rule
    and the ``default`` verdict.  Null or empty rules are ignored, repeated rows are judged alike, and
    other columns play no part.

    Only the (host labels, path length) shapes that occur among the rules are expanded; of up to
    ``max_shapes`` shapes, the shapes, not the rules, come to the driver.  Beyond that each host
    suffix is joined to the path lengths of the rules with as many labels, so that a URL of n characters has
    no more prefixes than rules have lengths.  Rules are broadcast up to ``max_broadcast_rules`` rows and joined with a
    shuffle beyond.  Each distinct URL is expanded once.
    """
    at = F.instr("rule", "/")
    rule_host = F.when(at > 0, F.substr("rule", F.lit(1), at - 1)).otherwise(F.col("rule"))
    table = (
        rules.where("rule IS NOT NULL AND rule <> ''")
        .select(F.concat(F.translate(rule_host, UPPER, UPPER.lower()), F.substr("rule", F.length(rule_host) + 1)).alias("rule"), "verdict", rule_host.alias("h"))
        .select("rule", "verdict", F.length("h").alias("host_chars"), F.size(F.split("h", r"\.")).alias("labels"), (F.length("rule") - F.length("h")).alias("path_chars"), F.sha2("rule", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, hash_digits))
    )
    shapes = sorted((r[0], r[1]) for r in table.select("labels", "path_chars").distinct().limit(max_shapes + 1).collect())
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = rows.where("url IS NOT NULL").select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    if len(shapes) <= max_shapes:
        # One constant array, however many shapes there are.
        wanted = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
        fitting = F.filter(wanted, lambda s: (F.size(labels) >= s["k"]) & (F.length("path") >= s["n"]))
    else:
        # The lengths of the rules of each number of labels; joined, they are a URL's own.
        lengths = table.groupBy(F.col("labels").alias("k")).agg(F.collect_set("path_chars").alias("lengths"))
        parts = parts.select("url", "host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k")).join(broadcast_if_small(lengths, max_shapes), "k")
        fitting = F.transform(F.filter("lengths", lambda n: F.length("path") >= n), lambda n: F.struct(F.col("k").alias("k"), n.alias("n")))
    suffix = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    expressions = F.transform(fitting, lambda s: F.concat(suffix(s["k"]), F.substr("path", F.lit(1), s["n"])))
    expanded = parts.select("url", F.explode(F.array_distinct(expressions)).alias("expression")).withColumn("full", F.sha2("expression", 256))
    expanded = expanded.withColumn("prefix", F.substring("full", 1, hash_digits))
    hits = expanded.join(broadcast_if_small(table, max_broadcast_rules), "prefix").where("full = digest")
    rank = F.struct(F.length("rule"), F.col("host_chars"), F.col("verdict") == "block")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    # Null URLs fit no rule; joined, they would all meet in one task.
    judged = rows.where("url IS NOT NULL").join(best, "url", "left")
    judged = judged.unionByName(rows.where("url IS NULL"), allowMissingColumns=True)
    host, path = host_and_path(F.col("url"))
    return judged.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
