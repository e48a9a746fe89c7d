"""Streaming query: pool rows arrive as files and are scored as they come."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.operators import similarity as SIM
from sieve.plans import fixtures as FX
from sieve.plans.catalog import r6, register
from sieve.plans.q_io import scratch
from sieve.plans.q_select import K_TOPK, SQL_VECTORS
from sieve.streaming import scoring as ST


@register("stream_topk_per_target", f"""
WITH {SQL_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, pool_id) AS rank FROM scores)
SELECT target_id, rank, pool_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {K_TOPK}""")
def stream_topk_per_target(spark, sf):
    """The pool is written as several files (one per label), streamed through
    the scorer until all files are processed, and the exact top-k per target is
    taken over the appended candidates."""
    base = scratch(spark, "stream")
    pool = FX.pool_vectors(spark, sf).select("src", "pool_id", "vec", "label")
    pool.repartition(4, "label").drop("label").write.parquet(f"{base}/in")
    tm = SIM.target_matrix(FX.target_vectors(spark, sf))
    q = ST.start_scoring(spark, f"{base}/in", tm, f"{base}/out", f"{base}/chk", K_TOPK, trigger_once=True,
                         max_files_per_trigger=1)
    q.awaitTermination()
    top = ST.topk_from_candidates(spark, f"{base}/out", K_TOPK)
    return top.select("target_id", F.col("rank").cast("long").alias("rank"), "pool_id", r6("score").alias("score"))


@register("stream_topk_state", f"""
WITH {SQL_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, pool_id) AS rank FROM scores)
SELECT target_id, rank, pool_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {K_TOPK}""")
def stream_topk_state(spark, sf):
    """The pool streamed file by file; the running exact top-k per target is
    kept in the state store (bounded: k rows per target) and republished after
    every micro-batch."""
    base = scratch(spark, "stream-state")
    pool = FX.pool_vectors(spark, sf).select("src", "pool_id", "vec", "label")
    pool.repartition(4, "label").drop("label").write.parquet(f"{base}/in")
    tm = SIM.target_matrix(FX.target_vectors(spark, sf))
    q = ST.start_running_topk(spark, f"{base}/in", tm, f"{base}/out", f"{base}/chk", K_TOPK, trigger_once=True,
                              max_files_per_trigger=1)
    q.awaitTermination()
    top = ST.current_topk(spark, f"{base}/out")
    return top.select("target_id", F.col("rank").cast("long").alias("rank"), "pool_id", r6("score").alias("score"))
