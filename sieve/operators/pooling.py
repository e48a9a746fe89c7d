"""Pooling of token states into one vector per sample.

Input: long table ``sample_id, layer, pos, vec`` (positions 1..L, layer 0 is
the input embedding, layers 1..N the hidden layers, as in a hidden-state
tuple). Output: ``sample_id, vec array<double>``.

Element-wise means and sums use ``pyspark.ml.stat.Summarizer``: a JVM
aggregate with a partial (map-side) step, so the states of a sample are
reduced to one vector per partition before the shuffle on ``sample_id``.
As in the reference, the attention mask is ignored: every stored position
counts.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions import vectors as V


def _vec():
    return array_to_vector(V.as_double(F.col("vec")))


def total_layers(states: DataFrame) -> int:
    """Number of hidden layers (the largest layer index)."""
    return int(states.agg(F.max("layer")).first()[0])


def layer_pick(states: DataFrame, layer: int = -1, n_layers: int | None = None) -> DataFrame:
    """One layer; a negative index counts from the end (-1 = last)."""
    if layer < 0:
        n_layers = total_layers(states) if n_layers is None else n_layers
        layer = n_layers + 1 + layer
    return states.filter(F.col("layer") == layer)


def layers_strided(states: DataFrame, n: int, n_layers: int | None = None) -> DataFrame:
    """Layers ``step * i`` for i = 1..n with ``step = total / n`` (must divide).
    Adds ``li``, the 0-based index of the layer in the selection."""
    total = total_layers(states) if n_layers is None else n_layers
    if n <= 0 or total % n:
        raise ValueError(f"n_layer must be a positive integer that divides {total}")
    step = total // n
    return (states.filter((F.col("layer") % step == 0) & (F.col("layer") > 0))
            .withColumn("li", (F.col("layer") / step - 1).cast("int")))


def layers_tail(states: DataFrame, n: int, n_layers: int | None = None) -> DataFrame:
    """The last ``n`` layers, ``li`` = 0 for the earliest of them."""
    if n <= 0:
        raise ValueError("n_layer must be a positive integer")
    total = total_layers(states) if n_layers is None else n_layers
    return (states.filter(F.col("layer") > total - n)
            .withColumn("li", (F.col("layer") - (total - n + 1)).cast("int")))


def pool_mean(states: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Mean over all positions."""
    return states.groupBy(*keys).agg(vector_to_array(Summarizer.mean(_vec())).alias("vec"))


def pool_weighted_mean(states: DataFrame, keys=("sample_id",)) -> DataFrame:
    """``sum(pos * h) / sum(pos)`` with positions 1..L."""
    return states.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(_vec(), F.col("pos").cast("double"))).alias("vec"))


def pool_last_token(states: DataFrame, keys=("sample_id",)) -> DataFrame:
    """State at the last position."""
    return states.groupBy(*keys).agg(F.max_by(V.as_double(F.col("vec")), F.col("pos")).alias("vec"))


def combine_sum(per_layer: DataFrame) -> DataFrame:
    return per_layer.groupBy("sample_id").agg(vector_to_array(Summarizer.sum(_vec())).alias("vec"))


def combine_avg(per_layer: DataFrame) -> DataFrame:
    return per_layer.groupBy("sample_id").agg(vector_to_array(Summarizer.mean(_vec())).alias("vec"))


def concat_by_layer(per_layer: DataFrame, part_col: str = "vec") -> DataFrame:
    """Concatenate per-layer parts in ``li`` order (one small group per sample:
    at most n_layer rows)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("li"), F.col(part_col).alias("p"))))
    return (per_layer.groupBy("sample_id").agg(parts.alias("_parts"))
            .select("sample_id", F.flatten(F.transform("_parts", lambda s: s["p"])).alias("vec")))


def combine_segment_cat(per_layer: DataFrame, n: int) -> DataFrame:
    """Layer i contributes dims ``[i*D/n, (i+1)*D/n)``; D must divide by n."""
    seg = F.when(F.size("vec") % n == 0, V.segment(F.col("vec"), F.col("li"), n)).otherwise(
        F.raise_error(F.lit("vector size must divide by n_layer for segment concatenation")))
    return concat_by_layer(per_layer.withColumn("_seg", seg), "_seg")


def pooled_layers(states: DataFrame, pooling: str, n: int, n_layers: int | None = None) -> DataFrame:
    """Per-layer position-weighted means of the selected layers
    (``multilayer``: strided, ``lastlayer``: tail): ``sample_id, li, vec``."""
    if pooling == "multilayer":
        chosen = layers_strided(states, n, n_layers)
    elif pooling == "lastlayer":
        chosen = layers_tail(states, n, n_layers)
    else:
        raise ValueError(pooling)
    return pool_weighted_mean(chosen, keys=("sample_id", "li"))


def embed(states: DataFrame, pooling: str = "weighted_mean", n_layer: int | None = None,
          sec_pooling: str | None = None, take_layer: int = -1, seed: int = 42,
          n_layers: int | None = None) -> DataFrame:
    """All pooling options of the reference's embedding step.

    ``mean`` / ``weighted_mean`` / ``none`` (last token) use ``take_layer``;
    ``multilayer`` accepts sec_pooling sum / cat / redcat and ``lastlayer``
    avg / redcat, anything else raises as in the reference.
    """
    if pooling in ("mean", "weighted_mean", "none"):
        one = layer_pick(states, take_layer, n_layers)
        return {"mean": pool_mean, "weighted_mean": pool_weighted_mean, "none": pool_last_token}[pooling](one)
    if n_layer is None:
        raise ValueError("n_layer is required for multilayer and lastlayer pooling")
    allowed = {"multilayer": ("sum", "cat", "redcat"), "lastlayer": ("avg", "redcat")}
    if pooling not in allowed or sec_pooling not in allowed[pooling]:
        raise ValueError(f"Unsupported sec_pooling: {sec_pooling}")
    per_layer = pooled_layers(states, pooling, n_layer, n_layers)
    if sec_pooling == "sum":
        return combine_sum(per_layer)
    if sec_pooling == "avg":
        return combine_avg(per_layer)
    if sec_pooling == "cat":
        return combine_segment_cat(per_layer, n_layer)
    from sieve.operators.projection import combine_redcat
    size = states.select(F.size("vec").alias("d")).limit(1).collect()          # one row of the input, not the pooled table
    return combine_redcat(per_layer, n_layer, seed=seed, d=size[0]["d"] if size else n_layer)


def explode_dims(vectors: DataFrame, key: str = "sample_id", vec: str = "vec") -> DataFrame:
    """Long form ``key, d, x`` (0-based d) for comparisons and SQL joins."""
    return vectors.select(key, F.posexplode(vec).alias("d", "x"))


__all__ = ["layer_pick", "layers_strided", "layers_tail", "pool_mean", "pool_weighted_mean", "pool_last_token",
           "combine_sum", "combine_avg", "combine_segment_cat", "concat_by_layer", "pooled_layers", "embed",
           "explode_dims"]
