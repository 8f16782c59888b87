"""A training-corpus pipeline over ``documents``: each stage's result is written and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import langid, minhash, mixing, pieces, queries, storage

ORACLE_SQL = None
#: Ids that may be broadcast, so that documents stay where they are.
MAX_BROADCAST = 1_000_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with a null text or no letter go.

    Rows of the table that are not held out are learned from; ``lang`` becomes the predicted language.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    # Numbered columns cannot clash with those of the result.
    plain = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    rest = tuple(name for c, name in plain.items() if c not in ("text", "lang"))
    found = langid.identify(docs.toDF(*plain.values()), model, plain["text"], plain["text"], keep=rest)
    return found.where("lang_pred <> 'und'").select(*[F.col("lang_pred" if c == "lang" else name).alias(c) for c, name in plain.items()])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    Rows that repeat an id and its text are one document, rows that repeat an id with another text are
    different ones.  Rows without an id stay.
    """
    key = F.col("doc_id")
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        key = F.when(key.isNotNull(), F.struct(key.alias("id"), F.xxhash64("text").alias("text")))
    keyed = docs.withColumn("__key", key)
    found = storage.written(minhash.near_duplicates(keyed, id_col="__key").select(F.col("doc_id").alias("__key"), "kept"), "found")
    gone = found.where("NOT kept").select("__key").distinct()
    # Those that go are fewer than those that stay; null ids match none of them.
    stay = keyed.join(storage.broadcast_if_small(gone, MAX_BROADCAST), "__key", "left_anti")
    again = found.where("kept AND __key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("c")).where("c > 1").select("__key")
    again = storage.written(again, "again")
    if not again.isEmpty():
        once = stay.join(again, "__key", "left_anti")
        stay = once.unionByName(stay.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return stay.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document that the mix takes twice is there twice.

    Rows with one id, source and size (repeated rows, and rows without an id) are taken alike.
    """
    taken = mixing.mix(docs, max_repeat=2).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("w")).agg(F.max("copies").alias("n"))
    plain = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*plain.values()).withColumn("size", mixing.word_count(F.col(plain["text"])))
    alike = F.col(plain["doc_id"]).eqNullSafe(F.col("i")) & F.col(plain["source"]).eqNullSafe(F.col("s")) & (F.col("size") == F.col("w"))
    repeated = rows.join(taken, alike).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return repeated.select(*plain.values()).toDF(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document."""
    return pieces.encode(docs, pieces.Vocabulary(queries.PIECE_MODEL), id_cols=("doc_id", "lang", "source"))


STAGES = [("language_id", identify), ("minhash_near_dedup", dedup), ("source_mixing", mix), ("sentencepiece", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each but the last written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
        storage.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
