"""One batch from a pool and a target set to selected rows or ids.

``run`` chains what the single operators do: render pool rows and build the target
set, encode both, whiten, score, select, and write rows (with their score, in order
of selection) or ids. The encoder is the caller's function from a DataFrame with a
``text`` column to the same rows with ``vec`` (a model's forward pass is not part
of this package); a side that already has ``vec`` is taken as it is.

    run(spark, pool, "gsm8k_shots", "/data/eval", encode=embed, method="max", k=70_000, out="/out/run1")
    run(spark, pool_vectors, target_vectors, method="normalized_mean_max", k=1_000, out="/out/run2", output="ids")
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators import selection as S
from sieve.operators import similarity as SIM
from sieve.operators import tiles as TL
from sieve.operators import whitening as W
from sieve.plans import target_sets as TS
from sieve.sources import readers as RD
from sieve.sources import sinks as SK

Encoder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Whitening:
    reddim: int
    fit: int | None = None          # rows of the seeded sample; None: all
    seed: int = 42


def pool_vectors(spark: SparkSession, pool: str | DataFrame, encode: Encoder | None) -> DataFrame:
    """Pool rows with ``src, pool_id, vec``. A name or path is read; rows without
    ``vec`` are rendered (by the pool's own renderer, if its name has one) and encoded."""
    name = pool if isinstance(pool, str) else ""
    rows = RD.read_named_pool(spark, pool) if isinstance(pool, str) else pool
    if "pool_id" not in rows.columns:
        if "row_pos" not in rows.columns:
            raise ValueError("pool rows need pool_id or row_pos")
        rows = rows.withColumn("pool_id", F.col("row_pos").cast("long"))
    if "src" not in rows.columns:
        rows = rows.withColumn("src", F.lit(0))
    if "vec" in rows.columns:
        return rows
    if encode is None:
        raise ValueError("a pool without vectors needs an encoder")
    return encode(rows if "text" in rows.columns else RD.render_pool(rows, name))


def target_vectors(spark: SparkSession, targets: str | DataFrame, data: str | TS.Inputs | None, encode: Encoder | None, **options) -> DataFrame:
    """``target_id, vec`` and what else the rows have. A name is a registered target
    set over ``data``; its text for the encoder is the sample's tokens, which hold the
    options' cuts."""
    if isinstance(targets, str):
        rows = TS.build(spark, targets, data if data is not None else {}, **options).withColumn("text", F.array_join("tokens", " "))
    else:
        rows = targets
    if "vec" in rows.columns:
        return rows
    if encode is None:
        raise ValueError("targets without vectors need an encoder")
    return encode(rows)


def whitened(pool: DataFrame, targets: DataFrame, how: Whitening) -> tuple[DataFrame, DataFrame]:
    """Both sides by one model, fitted on a sample of the pool."""
    model = W.whiten_fit(pool, reddim=how.reddim, fit=how.fit, seed=how.seed)
    return W.whiten_apply(pool, model), W.whiten_apply(targets.select("target_id", "vec"), model)


def run(spark: SparkSession, pool: str | DataFrame, targets: str | DataFrame, data: str | TS.Inputs | None = None, *, out: str, method: str = "max", k: int,
        output: str = "rows", encode: Encoder | None = None, whiten: Whitening | None = None, allow: DataFrame | None = None, weights: DataFrame | None = None,
        keep_scores: str | None = None, **target_options) -> DataFrame:
    """The selection (``src, pool_id, score, sel_rank`` and more), after its rows or
    ids were written to ``out``.

    ``weights`` (domain, weight) makes an ascending round robin with quotas over the
    pool's ``domain``, for ``method="min"`` only; ``allow`` (src, pool_id) goes with the
    round robins. ``keep_scores`` names a folder for the whole score matrix as tiles.
    Vectors are stored beside the output and read by every scan, so an encoder runs
    once; pool columns besides ``vec`` are written with the selected rows.
    """
    if output not in ("rows", "ids"):
        raise ValueError(f"output must be rows or ids, not {output!r}")
    if method not in S.METHODS:
        raise ValueError(f"unsupported selection method {method!r}")
    if weights is not None and method != "min":
        raise ValueError("quotas go with method min")
    if allow is not None and "mean" in method:
        raise ValueError("an allow-list goes with the round robins")
    rows, wanted = pool_vectors(spark, pool, encode), target_vectors(spark, targets, data, encode, **target_options)
    if whiten is not None:
        rows, wanted = whitened(rows, wanted, whiten)
    rows.write.mode("overwrite").parquet(f"{out}/vectors")
    rows = spark.read.parquet(f"{out}/vectors")
    matrix = SIM.target_matrix(wanted)
    if keep_scores is not None:
        SK.write_similarity(TL.score_tiles(rows, matrix), keep_scores, targets if isinstance(targets, str) else "targets", mode="overwrite")
    if weights is not None:
        chosen = S.select_round_robin_quota_from_pool(rows, matrix, weights, k, allow)
    else:
        chosen = S.select_from_pool(rows, matrix, method, k, allow)
    chosen = chosen.checkpoint()
    if output == "ids":
        SK.write_selected_ids(chosen, f"{out}/ids")
    else:
        SK.write_selected_rows(chosen, rows.drop("vec"), f"{out}/rows")
    return chosen
