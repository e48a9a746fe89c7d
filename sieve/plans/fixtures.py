"""How the driver's tables stand in for the reference's inputs.

The reference reads conversation pools, benchmark files and model hidden
states that are not shipped; these functions derive the equivalent inputs from
the given tables with plain DataFrame expressions, so every query's work grows
with the tables.

Fixed mapping (kept identical in the oracle SQL of ``sieve.plans.catalog``):

* target vectors: ``embeddings`` rows whose ``vec_id`` is a ``benchmark.item_id``
  (the benchmark items are the target task); pool: all other embeddings,
  ``pool_id = vec_id``, ``src = 0``, domain = ``label``;
* token states: sample ``vec_id div 8``, position ``vec_id % 8 + 1``, and
  layers 0..4 where layer ``l`` is the embedding rotated left by ``l``;
* conversations: one row per turn, gathered into ``messages`` per conversation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions import vectors as V
from sieve.session import ensure_checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

N_LAYERS = 4          # hidden layers; layer 0 is the input embedding, as in LM hidden-state tuples
POSITIONS = 8         # token positions per derived sample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sieve-io/{name}-{uuid.uuid4().hex}"


def target_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return emb.join(bench, "vec_id", "left_semi").select(
        F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec"), "label")


def pool_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return emb.join(bench, "vec_id", "left_anti").select(
        F.lit(0).alias("src"), F.col("vec_id").alias("pool_id"), F.col("embedding").alias("vec"),
        F.col("label").cast("string").alias("domain"), "label")


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, layer, pos, vec``: one row per (sample, layer, position)."""
    emb = table(spark, sf_dir, "embeddings")
    return (emb.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS))).alias("layer"))
            .select(F.floor(F.col("vec_id") / POSITIONS).cast("long").alias("sample_id"),
                    F.col("layer").cast("int").alias("layer"),
                    (F.col("vec_id") % POSITIONS + 1).cast("int").alias("pos"),
                    V.rotate(F.col("embedding"), F.col("layer")).alias("vec")))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages array<struct<role, content>>`` in turn order."""
    conv = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return (conv.groupBy("conv_id").agg(turns.alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"),
                                                                  x["content"].alias("content"))).alias("messages")))


def pool_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list of pool ids: those with a quality-1 row in ``labels``."""
    lab = table(spark, sf_dir, "labels")
    return lab.filter(F.col("quality") == 1).select(F.lit(0).alias("src"), F.col("doc_id").alias("pool_id"))
