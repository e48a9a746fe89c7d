"""Writers for similarity scores, selections, predictions and metrics.

All writes are distributed DataFrame writes into a folder the caller names
(on a cluster: a shared file system); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.tiles import ScoreTiles


def similarity_name(target_set: str, n_layer, sec_pooling, model: str, trunc: int, whiten_dim: int | None) -> str:
    """Name of a score set, encoding the parameters that produced it."""
    name = f"{target_set}_{n_layer}_{sec_pooling}_{model.rstrip('/').split('/')[-1]}_{trunc}"
    return name + (f"_whiten_reddim_{whiten_dim}" if whiten_dim else "")


def write_similarity(scores: ScoreTiles, path: str, target_set: str, mode: str = "append", **params) -> None:
    """The tiles and, beside them, the targets of their blocks, both partitioned
    by target set; the parameters are kept as columns so several runs can share
    one folder. Shards of a pool are appended one after the other: the blocks are
    written with the first, and a shard scored against other targets is refused."""
    spark = scores.tiles.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/targets/target_set={target_set}")
    if mode == "append" and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        held = spark.read.parquet(f"{path}/targets/target_set={target_set}")
        ScoreTiles(scores.tiles, held.select("block", "target_ids")).union(scores)           # raises if the blocks differ
    else:
        scores.blocks.withColumn("target_set", F.lit(target_set)).write.mode(mode).partitionBy("target_set").parquet(f"{path}/targets")
    out = scores.tiles.withColumn("target_set", F.lit(target_set))
    for k, v in params.items():
        out = out.withColumn(k, F.lit(v))
    out.write.mode(mode).partitionBy("target_set").parquet(f"{path}/tiles")


def write_influence(columns: DataFrame, path: str) -> None:
    """``target_id, pool_ids, scores`` arrays as JSON lines, each a target and a
    map from pool index to score: the influence-file form, in bounded pieces."""
    ids = F.transform("pool_ids", lambda i: i.cast("string"))
    columns.select("target_id", F.map_from_arrays(ids, F.col("scores")).alias("scores")).write.mode("append").json(path)


def write_selected_rows(selection: DataFrame, pool: DataFrame, path: str, keys=("src", "pool_id")) -> None:
    """Selected pool rows with their ``influence_score`` in selection order
    (range-partitioned by ``sel_rank``, so part files follow the order)."""
    rows = (selection.select(*keys, "sel_rank", F.col("score").alias("influence_score"))
            .join(pool, list(keys)))
    rows.repartitionByRange("sel_rank").sortWithinPartitions("sel_rank").write.mode("overwrite").json(path)


def write_selected_ids(selection: DataFrame, path: str) -> None:
    """Ids only; only meaningful for a single pool."""
    if selection.select("src").distinct().limit(2).count() > 1:
        raise ValueError("Can only output dataset idxes with single input file.")
    (selection.select("sel_rank", "pool_id").repartitionByRange("sel_rank").sortWithinPartitions("sel_rank")
     .write.mode("overwrite").json(path))


def write_predictions(predictions: DataFrame, path: str, gzip: bool = True) -> None:
    """Append predictions as JSON lines (optionally gzip)."""
    w = predictions.write.mode("append")
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def write_metrics(metrics: DataFrame, path: str, partition_by: str | None = None, fmt: str = "json") -> None:
    w = metrics.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)
