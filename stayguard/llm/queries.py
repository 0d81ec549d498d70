"""The numbered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from . import (flow_mix, merkle, multi_index, nra, path_templates, pattern_pack, preference, radix_suffix, robust_quality, secret_ownership, token_rollup, toxicity,
               weighted_minhash)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


@query("op8_pattern_pack")
def op8(spark, sf):
    return pattern_pack.packed(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE))


@query("op4_flow_mix", flow_mix.SQL)
def op4(spark, sf):
    return flow_mix.mixed(table(spark, sf, "documents"))


@query("op10_token_rollup", r"""
WITH counted AS (
  SELECT source, lang, substr(md5(coalesce(text, '')), 1, 1) < '5' AS gone, coalesce(lang, '') >= 'en' AS moved,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_words,
    coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[^\x20\x09-\x0DA-Za-z]')), 0) AS n_pieces
  FROM documents
)
SELECT source, lang, CASE WHEN moved THEN 'pieces-2' ELSE 'words-1' END AS version, COUNT(*) AS n_docs,
  CAST(SUM(CASE WHEN moved THEN n_pieces ELSE n_words END) AS BIGINT) AS n_tokens
FROM counted WHERE NOT gone GROUP BY ALL
""")
def op10(spark, sf):
    return token_rollup.maintained(table(spark, sf, "documents"))


@query("op1_mcd_outliers")
def op1(spark, sf):
    return robust_quality.judged(table(spark, sf, "documents"))


@query("op2_secret_ownership", secret_ownership.SQL)
def op2(spark, sf):
    return secret_ownership.scanned(table(spark, sf, "documents")).drop("found", "digest")


@query("op5_preference", preference.SQL)
def op5(spark, sf):
    return preference.preference_rows(table(spark, sf, "conversations"))


@query("op6_radix_suffix", radix_suffix.SQL)
def op6(spark, sf):
    return radix_suffix.removed(table(spark, sf, "documents"))


@query("op3_weighted_minhash", weighted_minhash.SQL)
def op3(spark, sf):
    return weighted_minhash.classes(table(spark, sf, "documents"))


@query("op7_bigru_toxicity")
def op7(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_multi_index")
def op9(spark, sf):
    return multi_index.searched(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query("op11_nra", nra.SQL)
def op11(spark, sf):
    return nra.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_path_templates", path_templates.SQL)
def op12(spark, sf):
    return path_templates.judged(table(spark, sf, "pages"))


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    return merkle.manifest(docs, merkle.newlines_cut(docs))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
