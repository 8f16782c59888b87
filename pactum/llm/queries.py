"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import bitslice, centroids, editsketch, htmltext, langid, minhash, mixing, packing, piece_counts, pieces, storage, urlfilter, warc, whitening

#: The model file of op9 and op10.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The tokenizer file of op13.
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back by the salvage reader; gaps are logged and counted."""
    path = storage.new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    rows = storage.written(warc.read_warc(spark, path, with_payload=False), "warc-rows")
    back, gaps = warc.split_gaps(rows, storage.new_path(spark, "warc-gaps"))
    return back.select(
        warc.record_key("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        warc.record_key("refers_to").alias("refers_to"),
        F.lit(gaps).cast("long").alias("gaps"),
    )


#: Host and path rules and their verdicts.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the URL rules on every page."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), rules, default="allow")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources by weights 3, 1, 2 takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with equal or near-equal sets of 4-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_editsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited copies, and groups of near texts: all that share a band are compared."""
    return editsketch.fingerprints_with_edits(_table(spark, sf_dir, "documents"), max_share=0.05)


def op6_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"))


def op7_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every query vector."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), bitslice.quantised(F.col("embedding"), 64).alias("vec"))
    return bitslice.top_k(rows, rows.where("id % 20 = 0"), k=20)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document, and whether decoding gives the text again."""
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.Vocabulary(PIECE_MODEL))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of SentencePiece pieces of every document."""
    return piece_counts.count_pieces(_table(spark, sf_dir, "documents"), pieces.Vocabulary(PIECE_MODEL))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components of the distinct ones, scaled to unit variance.

    A deviation that does not fit 64 bits is null here.
    """
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), k=4, factor=256)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of exact clustering of all embeddings around eight centroids."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, factor=1024, seed=3)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    pieces_of = packing.tokenised(_table(spark, sf_dir, "documents"), packing.ByteTokenizer(BYTE_TOKENIZER), capacity=2048, keep_ids=False)
    return packing.pack(pieces_of, capacity=2048)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_urlfilter": op2_urlfilter,
    "op3_mixing": op3_mixing,
    "op4_minhash": op4_minhash,
    "op5_editsketch": op5_editsketch,
    "op6_htmltext": op6_htmltext,
    "op7_bitslice": op7_bitslice,
    "op8_langid": op8_langid,
    "op9_pieces": op9_pieces,
    "op10_piece_counts": op10_piece_counts,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}

_WORDS = r"""
  SELECT i.doc_id, i.text, [x FOR x IN regexp_split_to_array(translate(i.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents i
"""



def _rounds(rounds: int, k: int) -> str:
    """SQL of ``rounds`` rounds of clustering ``v`` (r, vec_id, e) around ``k`` centroids of at most 16, from c0 (j, c) on."""
    out = []
    for t in range(rounds + 1):
        out.append(f"""
a{t} AS MATERIALIZED (SELECT v.r, min(16 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.e, c.c)])::BIGINT + c.j) AS m FROM v, c{t} c GROUP BY v.r)""")
        if t < rounds:
            out.append(f"""
u{t} AS (SELECT m % 16 AS j, unnest(v.e) AS x, unnest(range(64)) AS i FROM a{t} JOIN v USING (r)),
s{t} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM u{t} GROUP BY j, i),
c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(g.c, c.c) AS c FROM c{t} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j) g USING (j))""")
    return ",".join(out)


_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)

SQL = {
    "op12_centroids": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS j, e AS c FROM v QUALIFY j < 8),
{_rounds(10, 8)},
f AS (SELECT v.vec_id, (m % 16)::INT AS cluster, (m // 16)::BIGINT AS distance FROM a10 JOIN v USING (r))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c10 ON cluster = j
""",
    "op7_bitslice": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product([x::DOUBLE FOR x IN q.e], [x::DOUBLE FOR x IN v.e])::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS b FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT
      + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT, 1) FOR k IN range(32)], '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, 0::BIGINT AS gaps
FROM f
""",
    "op2_urlfilter": rf"""
WITH rules(rule, verdict) AS (VALUES {_RULES}),
r AS (SELECT rule, verdict, substr(rule, 1, instr(rule, '/') - 1) AS h, substr(rule, instr(rule, '/')) AS q FROM rules),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, length(r.h) DESC, r.verdict = 'block' DESC) AS k
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * s / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(s) FROM s)::DOUBLE - coalesce(sum(2 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
c AS (SELECT min(k) AS k0, arg_min(level, k) AS level FROM l WHERE w * level <= 2 * s),
t AS (SELECT source, s, CASE WHEN k >= k0 THEN w * c.level ELSE (2 * s)::DOUBLE END AS target FROM l, c),
p AS (SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE floor(target / s)::BIGINT END AS whole FROM t),
r AS (SELECT *, target - whole * s AS rest FROM p),
h AS (SELECT source, size, count(*) AS c FROM d WHERE size > 0 GROUP BY source, size),
g AS (SELECT h.source, h.size, (r.rest - coalesce(sum(h.size * h.c) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(h.size::HUGEINT * h.size * h.c) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, arg_max(rate, size) AS rate FROM g WHERE rate * size <= 1 GROUP BY source),
x AS (SELECT d.doc_id, d.source, d.size, r.s AS source_size, r.target, r.whole, r.rest, coalesce(e.rate, 'Infinity'::DOUBLE) * d.size AS chance,
  (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source),
y AS (SELECT *, CASE WHEN size = 0 OR rest <= 0 THEN NULL WHEN chance >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (chance / (1 - chance)) END AS key FROM x),
z AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE - size / 2.0::DOUBLE AS mid FROM y)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN key IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM z
""",
    "op4_minhash": rf"""
WITH RECURSIVE words AS ({_WORDS}),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] FOR k IN range(1, len(w) - 2)]) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
rare AS (SELECT g FROM flat GROUP BY g HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM flat a JOIN rare USING (g) JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
""",
}
