"""PCA whitening fitted on a sample of the pool, applied to pool and targets.

Fit: an exact seeded sample of ``fit`` rows (hash order; only the narrow
``(hash, id)`` pairs go through the global top-``fit``, the vectors are then
semi-joined), one distributed pass (count, mean and co-moments per Arrow batch,
merged pairwise within a task and then, in row blocks, between tasks), and the
eigendecomposition of the D x D covariance on the driver.
Its size depends on D only, not on the number of rows.

Apply: ``(x - mean) @ V_r.T / sqrt(lambda_r)`` per Arrow batch with the model
broadcast; eigenvalues use the n - 1 denominator, as the PCA the reference
calls does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import sampling


@dataclass
class WhiteningModel:
    mean: np.ndarray          # (D,)
    components: np.ndarray    # (r, D), rows are unit principal directions
    variances: np.ndarray     # (r,), sample variances along them
    covariance: np.ndarray    # (D, D)
    n: int

    def to_df(self, spark) -> DataFrame:
        """One-row table ``mean, components, variances`` (for storage)."""
        return spark.createDataFrame(
            [(self.mean.tolist(), self.components.tolist(), self.variances.tolist(), self.n)],
            "mean array<double>, components array<array<double>>, variances array<double>, n bigint")


def _matrix(batch: pa.RecordBatch, col: str) -> np.ndarray:
    arr = batch.column(col)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(batch.num_rows, -1)


BLOCK_VALUES = 1 << 17       # co-moments of a row of the partial tables (1 MB)
MOMENT_SCHEMA = "block int, first int, n bigint, mean array<double>, m2 array<double>"


def merge_moments(n1: int, mean1: np.ndarray, m1: np.ndarray, n2: int, mean2: np.ndarray, m2: np.ndarray, rows: slice = slice(None)):
    """Count, mean and co-moments (rows ``rows`` of the matrix) of two samples
    together; either may be empty."""
    n = n1 + n2
    if not n1 or not n2:
        return (n, mean1, m1) if n1 else (n, mean2, m2)
    delta = mean2 - mean1
    return n, mean1 + delta * (n2 / n), m1 + m2 + np.outer(delta[rows], delta) * (n1 * n2 / n)


def moments(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """``block, first, n, mean, m2``: count, mean and sums of products of deviations
    of all vectors, in one scan. Blocks hold some rows of the D x D matrix, from row
    ``first`` on. A task merges its batches one by one; tasks are merged pairwise by
    block, in groups of 32 partitions and then together, so no task receives a whole
    matrix per partition. No vectors, no rows; vectors of unequal length raise."""
    def partial(batches):
        n, mean, m2 = 0, None, None
        for b in batches:
            if b.num_rows:
                X = _matrix(b, "v")
                if mean is not None and X.shape[1] != len(mean):
                    raise ValueError("vectors have different lengths")
                mu = X.mean(axis=0)
                Y = X - mu
                n, mean, m2 = merge_moments(n, mean, m2, len(X), mu, Y.T @ Y)
        if n:
            step = max(1, BLOCK_VALUES // len(mean))
            for k, i in enumerate(range(0, len(mean), step)):       # one block a batch: a batch is bounded by the block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([mean]), pa.array([m2[i:i + step].ravel()])],
                    names=["block", "first", "n", "mean", "m2"])

    def merge(rows):
        n, mean, m2 = 0, None, None
        first = int(rows["first"].iloc[0])
        for r in rows.sort_values(["n", "mean"], key=lambda c: c if c.name == "n" else c.map(lambda m: m[0])).itertuples():
            mu = np.asarray(r.mean)
            block = np.asarray(r.m2).reshape(-1, len(mu))
            if mean is not None and len(mu) != len(mean):
                raise ValueError("vectors have different lengths")
            n, mean, m2 = merge_moments(n, mean, m2, int(r.n), mu, block, slice(first, first + len(block)))
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "first": [first], "n": [n], "mean": [mean], "m2": [m2.ravel()]})

    parts = vectors.select(F.transform(vec, lambda x: x.cast("double")).alias("v")).mapInArrow(partial, MOMENT_SCHEMA)
    groups = parts.groupBy("block", F.floor(F.spark_partition_id() / 32).alias("part")).applyInPandas(lambda key, rows: merge(rows), MOMENT_SCHEMA)
    return groups.groupBy("block").applyInPandas(merge, MOMENT_SCHEMA)


def covariance_blocks(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """``first, n, mean, cov``: the sample covariance (n - 1) in blocks of rows from
    row ``first`` on, row after row; zero for a single vector."""
    scale = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    return moments(vectors, vec).select("first", "n", "mean", F.zip_with("m2", F.array_repeat(scale, F.size("m2")), lambda m, s: m / s).alias("cov"))


def covariance(vectors: DataFrame, vec: str = "vec"):
    """Sample mean, covariance (n - 1) and row count. D x D values reach the driver
    in blocks: bounded by D, not by the rows."""
    blocks = covariance_blocks(vectors, vec).orderBy("first").collect()
    if not blocks:
        raise ValueError("empty fit sample")
    mean = np.asarray(blocks[0]["mean"], dtype=np.float64)
    return mean, np.concatenate([np.asarray(r["cov"], dtype=np.float64) for r in blocks]).reshape(len(mean), len(mean)), int(blocks[0]["n"])


def whiten_fit(vectors: DataFrame, reddim: int, fit: int | None = None, seed: int = 42,
               id_col: str = "pool_id", vec: str = "vec") -> WhiteningModel:
    if fit is not None:
        if fit <= 0:
            raise ValueError(f"fit must be positive, got {fit}")
        vectors = sampling.sample_fit(vectors, fit, seed=seed, id_col=id_col)
    mean, cov, n = covariance(vectors, vec)
    d = len(mean)
    if reddim > min(n - 1, d):
        raise ValueError(f"reddim={reddim} must be <= min(n - 1, D) = {min(n - 1, d)}")
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:reddim]
    var = w[order]
    if np.any(var <= 0):
        raise ValueError("whitening needs positive variances along every kept direction")
    return WhiteningModel(mean=mean, components=v[:, order].T.copy(), variances=var, covariance=cov, n=n)


def whiten_apply(df: DataFrame, model: WhiteningModel, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Whiten ``vec`` of every row; other columns pass through."""
    sc = df.sparkSession.sparkContext
    proj = model.components / np.sqrt(model.variances)[:, None]   # (r, D)
    bc = sc.broadcast((model.mean, proj))
    r = proj.shape[0]
    others = [c for c in df.columns if c != vec]
    slim = df.select(*others, F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    out_fields = [f for f in slim.schema.fields if f.name != "_v"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_fields)
    schema = (schema + ", " if schema else "") + f"`{out}` array<double>"

    def fn(batches):
        mu, P = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            Xw = (_matrix(b, "_v") - mu) @ P.T
            arr = pa.FixedSizeListArray.from_arrays(pa.array(Xw.ravel()), r).cast(pa.list_(pa.float64()))
            cols = [b.column(f.name) for f in out_fields] + [arr]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_fields] + [out])

    return slim.mapInArrow(fn, schema)
