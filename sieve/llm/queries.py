"""The registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import decontaminate, divergence, licenses, mixing, permutation, quality, quotes, rules, secrets, simhash, tokens, toxicity, variants
from sieve.llm.common import crc_mod, read


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 0
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), "quality", ~held, 0.3)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 3) == 1
    scored = toxicity.classify(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read(spark, sf_dir, "labels"), "toxic", ~held, 0.7)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "lang_threshold", "flagged")


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(read(spark, sf_dir, "conversations"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.load_vocabulary(TOKENIZER))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, most=3)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(F.col("quality") == 1))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_toxicity, op3_quotes, op4_permutation_index, op5_trie_tokens,
    op6_simhash, op7_licenses, op8_decontaminate, op9_secrets, op10_mixing,
    op11_spelling_variants, op12_quality_rules, op13_source_divergence)}
ORACLE_SQL = {"op7_licenses": licenses.ORACLE_SQL, "op9_secrets": secrets.ORACLE_SQL, "op11_spelling_variants": variants.ORACLE_SQL, "op12_quality_rules": rules.ORACLE_SQL,
              "op13_source_divergence": divergence.ORACLE_SQL}
