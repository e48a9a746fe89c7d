"""Random sign projection per layer, then concatenation ("redcat").

Each selected layer ``li`` has its own matrix R_li in {+1, -1}^{D x D//n}.
Signs are a pure function of ``(seed, li, i, j)``: the first hex digit of
``md5("seed|li|i|j")`` below 8 gives +1. The same rule is one SQL expression
(``md5(concat_ws('|', ...))``), so the projection has a SQL oracle, and the
matrices need no state: every task can rebuild or receive them.

The matrices depend only on (D, n, seed), never on the data; they are built
once on the driver and broadcast as int8. The product runs per Arrow batch in
NumPy. Scaling of R is irrelevant for cosine scores, so R is left unscaled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.pooling import concat_by_layer


@lru_cache(maxsize=16)
def sign_matrix(seed: int, li: int, d: int, m: int) -> np.ndarray:
    out = np.empty((d, m), dtype=np.int8)
    for i in range(d):
        for j in range(m):
            h = hashlib.md5(f"{seed}|{li}|{i}|{j}".encode()).hexdigest()[0]
            out[i, j] = 1 if int(h, 16) < 8 else -1
    return out


def sign_column(seed, li, i, j):
    """The sign rule as a Column expression (SQL form of the projection)."""
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), li.cast("string"), i.cast("string"),
                                      j.cast("string"))), 1, 1)
    return F.when(h < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))


def project(per_layer: DataFrame, n: int, d: int, seed: int = 42) -> DataFrame:
    """``sample_id, li, vec`` -> ``sample_id, li, proj`` with ``proj = vec @ R_li``."""
    m = d // n
    if m <= 0:
        raise ValueError("n_layer larger than the vector size")
    sc = per_layer.sparkSession.sparkContext
    mats = sc.broadcast(np.stack([sign_matrix(seed, li, d, m) for li in range(n)]))

    def fn(batches):
        R = mats.value
        for b in batches:
            if b.num_rows == 0:
                continue
            li = b.column("li").to_numpy(zero_copy_only=False)
            flat = b.column("vec").flatten().to_numpy(zero_copy_only=False)
            X = np.asarray(flat, dtype=np.float64).reshape(b.num_rows, d)
            out = np.empty((b.num_rows, m))
            for layer in np.unique(li):
                rows = li == layer
                out[rows] = X[rows] @ R[layer].astype(np.float64)
            proj = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), m).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("li"), proj],
                                             names=["sample_id", "li", "proj"])

    slim = per_layer.select(F.col("sample_id").cast("long"), F.col("li").cast("int"),
                            F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return slim.mapInArrow(fn, "sample_id bigint, li int, proj array<double>")


def combine_redcat(per_layer: DataFrame, n: int, seed: int = 42, d: int | None = None) -> DataFrame:
    """Project every layer to D//n dims and concatenate in layer order; with a
    single layer the pooled vector is returned unchanged. Without ``d``, the
    vectors' length, the table is read once more to learn it."""
    if n == 1:
        return per_layer.select("sample_id", "vec")
    if d is None:
        d = int(per_layer.agg(F.max(F.size("vec"))).first()[0])
    return concat_by_layer(project(per_layer, n, d, seed), "proj")
