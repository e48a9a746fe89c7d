"""Scoring newly arriving pool rows against a fixed target set.

The reference has no streaming; this is the one streaming use of its model.
Pool vectors arrive as files; each micro-batch is scored against the broadcast
(size-checked) target matrix with the same Arrow map as the batch path, and the
per-target top-k candidates of the micro-batch are appended to a table. The
stream is stateless (no watermark or state store is needed): the exact global
per-target top-k, and any selection after it, is a batch query over the
appended candidates, because the union of per-batch top-k sets contains the
global top-k. Progress lives in a checkpoint folder inside the session's
shared checkpoint directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sieve.operators import similarity as SIM

POOL_STREAM_SCHEMA = "src int, pool_id bigint, vec array<float>"


def pool_stream(spark: SparkSession, path: str, schema: str = POOL_STREAM_SCHEMA, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(stream: DataFrame, targets: SIM.TargetMatrix, k: int, largest: bool = True) -> DataFrame:
    """Per micro-batch top-k candidates of every target (stateless map)."""
    cand = SIM.cosine_scores(stream, targets, mode="topk", k=k, largest=largest)
    return cand.withColumn("scored_at", F.current_timestamp())


def start_scoring(spark: SparkSession, source: str, targets: SIM.TargetMatrix, out: str, checkpoint: str,
                  k: int, largest: bool = True, trigger_once: bool = False, **reader_opts):
    """Start the stream: ``source`` files -> candidates appended as Parquet."""
    cand = score_stream(pool_stream(spark, source, **reader_opts), targets, k, largest)
    writer = (cand.writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def topk_from_candidates(spark: SparkSession, out: str, k: int, largest: bool = True) -> DataFrame:
    """Exact per-target top-k over everything the stream has scored so far."""
    cand = spark.read.parquet(out).select("target_id", "src", "pool_id", "score")
    return SIM.topk_per_target(cand, k, largest=largest)


# --------------------------------------------------------------------------
# stateful variant: the running top-k per target lives in the state store
# --------------------------------------------------------------------------

TOPK_STATE_SCHEMA = "src array<int>, pool_id array<bigint>, score array<double>"
TOPK_OUT_SCHEMA = "target_id bigint, rank int, src int, pool_id bigint, score double"


def _best_k(frame: pd.DataFrame, k: int, largest: bool) -> pd.DataFrame:
    """First k rows by score (ties by src, pool_id), one row per pool row."""
    frame = frame.drop_duplicates(["src", "pool_id"])
    key = -frame["score"].to_numpy() if largest else frame["score"].to_numpy()
    order = np.lexsort((frame["pool_id"].to_numpy(), frame["src"].to_numpy(), key))
    return frame.iloc[order[:k]]


def running_topk(cand: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """Exact per-target top-k over everything seen so far, kept as state.

    The state of a target is its current k best rows, so it stays bounded
    however long the stream runs. Each micro-batch's candidates of a target
    arrive in chunks and are folded into the running k one chunk at a time, so
    a hot target never holds more than a chunk plus k rows. Emits the new top-k
    of every target the batch touched (update mode)."""
    def merge(key, chunks, state):
        best = pd.DataFrame({"src": pd.Series(dtype="int32"), "pool_id": pd.Series(dtype="int64"),
                             "score": pd.Series(dtype="float64")})
        if state.exists:
            s_src, s_pid, s_score = state.get
            best = pd.DataFrame({"src": np.asarray(s_src, dtype=np.int32), "pool_id": np.asarray(s_pid, dtype=np.int64),
                                 "score": np.asarray(s_score, dtype=np.float64)})
        for chunk in chunks:
            best = _best_k(pd.concat([best, chunk[["src", "pool_id", "score"]]], ignore_index=True), k, largest)
        state.update((best["src"].tolist(), best["pool_id"].tolist(), best["score"].tolist()))
        yield pd.DataFrame({"target_id": np.full(len(best), key[0], dtype=np.int64),
                            "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                            "src": best["src"].to_numpy(), "pool_id": best["pool_id"].to_numpy(),
                            "score": best["score"].to_numpy()})

    return (cand.select("target_id", "src", "pool_id", "score").groupBy("target_id")
            .applyInPandasWithState(merge, TOPK_OUT_SCHEMA, TOPK_STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout))


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Batch ids of the complete versions of the current top-k table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(st.getPath().getName()[2:]) for st in fs.listStatus(path)
                  if st.getPath().getName().startswith("v=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))


def start_running_topk(spark: SparkSession, source: str, targets: SIM.TargetMatrix, out: str, checkpoint: str,
                       k: int, largest: bool = True, trigger_once: bool = False, **reader_opts):
    """Stream ``source`` files through the scorer and the stateful top-k.

    After every micro-batch the updated targets replace their rows in the
    current table (at most targets x k rows), written as a new version folder
    ``v=<batch id>``; a replayed batch rewrites the same folder, so the sink is
    idempotent. Readers take the newest complete version."""
    top = running_topk(score_stream(pool_stream(spark, source, **reader_opts), targets, k, largest), k, largest)

    def publish(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        # the base is the newest version before this batch, so a replayed batch
        # rebuilds the same table
        earlier = [v for v in _versions(session, out) if v < batch_id]
        updates = batch.persist()           # at most targets x k rows
        cur = updates
        if earlier:
            old = session.read.parquet(f"{out}/v={earlier[-1]}")
            cur = old.join(updates.select("target_id").distinct(), "target_id", "left_anti").unionByName(updates)
        cur.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        updates.unpersist()

    writer = (top.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
              .outputMode("update"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_topk(spark: SparkSession, out: str) -> DataFrame:
    """The current exact per-target top-k published by :func:`start_running_topk`."""
    done = _versions(spark, out)
    if not done:
        return spark.createDataFrame([], TOPK_OUT_SCHEMA)
    return spark.read.parquet(f"{out}/v={done[-1]}")
