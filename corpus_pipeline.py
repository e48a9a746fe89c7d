"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last keep
the columns of documents; labels and benchmark come from ``sf_dir``. Part of the
subpackage ``sieve.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import decontaminate, mixing, quality, secrets, simhash
from sieve.llm.common import crc_mod, read
from sieve.session import configure, ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.3 or more); it learns from the
    labelled rows among them whose id's remainder isn't held out. Null and empty
    texts score the classifier's bias, repeated rows are judged alike, texts of
    any length are scored whole; all columns stay, an empty table stays empty."""
    configure(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"), "quality", crc_mod(F.col("doc_id"), 5) != 0)
    return docs.where(quality.score(docs, model) >= 0.3)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest id, of rows that
    share it the smallest hash of the text, of repeated rows any one. Null and empty texts have fingerprint zero
    and are one component; null ids come after all others. All columns stay, an
    empty table stays empty."""
    configure(spark)
    return simhash.keep_one(docs, shingle=3, most=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none,
    repeated rows go or stay together, a long text is looked through whole; items
    that are null or without words match nothing. All columns stay; an empty table
    stays empty, and without a benchmark all documents stay."""
    configure(spark)
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind and ``n_chars`` made to fit. Null
    texts stay null, repeated rows are redacted alike, texts of any length whole;
    all columns stay, whatever their names, and an empty table stays empty."""
    configure(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, size, source_size,
    target, taken``. Null texts have size 0, a null source is one of its own, rows
    that repeat share their words evenly; an empty table gives no rows."""
    configure(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The quality stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result goes to the checkpoint folder."""
    configure(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
