"""The corpus pipeline: toxicity, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayguard.llm import flow_mix, pattern_pack, secret_ownership, toxicity, weighted_minhash
from stayguard.llm.scratch import saved

#: SQL cannot express the learned score of the first stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("held_out", "score", "predicted")}  # names that the scores use
    rows = docs.withColumnsRenamed(aside)
    rows = toxicity.scored(rows, labels, keep=tuple(c for c in rows.columns if c != "doc_id")).filter("predicted = 0")
    return rows.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id.

    A document without an id stays; of rows that share an id one stays (the same one on every run).
    """
    classes = saved(weighted_minhash.classes(docs), "classes")
    rows = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    gone = rows.filter("class_id <> doc_id").select("doc_id")
    again = rows.filter("class_id = doc_id and n > 1").select("doc_id")
    whole = F.struct(*(c for c in docs.columns if c != "doc_id"))
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_row")).select("doc_id", "_row.*")
    return docs.join(gone.unionByName(again), "doc_id", "left_anti").unionByName(one.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials of few owners are masked in the text; widely copied examples stay."""
    found = secret_ownership.scanned(docs).filter("n_live > 0").select(F.col("digest").alias("_digest"), F.col("found").alias("_found"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = docs.withColumn("_digest", digest).join(found.dropDuplicates(["_digest"]), "_digest", "left")
    text = secret_ownership.masked(F.col("text"), F.col("_found"))
    rows = rows.withColumn("n_chars", F.when(F.col("_found").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast("bigint"))
    return rows.withColumn("text", text).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, up to three times; without an id, once."""
    taken = flow_mix.mixed(docs.filter("doc_id is not null")).filter("taken > 0")
    taken = taken.select("doc_id", F.expr("cast(taken / size as int)").alias("_times")).groupBy("doc_id").agg(F.max("_times").alias("_times"))
    rows = docs.join(taken, "doc_id").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids with their sequence and place."""
    return pattern_pack.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
