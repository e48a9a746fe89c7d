"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it ranks a fixed set of pivots,
nearest first, and posted in the inverted files of its first pivots. A query
visits the files of its own first pivots, ranks what is posted there by the
footrule distance of the two orders (the sum over all pivots of the differences
in rank), and reranks the best share of each file by the exact inner product.
Files are split into blocks by hash; queries meet them block by block.

The orders tell directions only, while the measure, the inner product, also grows
with a vector's length. So vectors are indexed in bands of nearly equal length,
each with pivots and files of its own, and a query visits every band's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 128           # at most; one for every ROWS_PER_PIVOT vectors in small tables
ROWS_PER_PIVOT = 32
FILES = 12             # a vector's and a query's first pivots
KEEP = 0.12            # share of a file's block that is reranked
KEEP_LEAST = 400
BLOCK = 8_000          # vectors of a file, or queries, that meet in a task
BAND = 0.25            # lengths of a band differ by this power of two at most
BAND_LEAST = 400       # neighbouring bands are one while they hold no more together: 12 pivots, so each file holds all of it


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _length(vector: Column) -> Column:
    """Euclidean length; no square overflows."""
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: F.hypot(acc, x.cast("double")))


def _starts(counts: list[tuple[int, int]]) -> list[int]:
    """First step of each band, from (step, vectors) in order of step."""
    starts, held = [], 0
    for step, n in counts:
        if starts and held + n <= BAND_LEAST:
            held += n
        else:
            starts.append(step)
            held = n
    return starts


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")


def _ranks(orders: np.ndarray) -> np.ndarray:
    ranks = np.empty(orders.shape, np.int16)
    np.put_along_axis(ranks, orders, np.arange(orders.shape[1], dtype=np.int16)[None, :], 1)
    return ranks


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query`` the k
    rows of largest inner product found, itself left out, ties to smaller ids.

    Equal vectors are indexed and searched once and stand for all their rows.
    Vectors may differ in Euclidean length; where they don't, they make a single
    band. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do rows with a null key; vectors of different numbers of components
    have no inner product, so each number is indexed and searched by itself. Of rows
    repeated in key and vector one takes part. An empty table gives an empty result;
    columns besides key and vector are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = sorted(r["n"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("asks").alias("asks")).where("asks").collect())      # a handful at most
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, n in enumerate(sizes):
        found = _search(rows.where(F.size("v") == n), k)
        out = found if i == 0 else out.unionByName(found)
    return out


def _search(rows: DataFrame, k: int) -> DataFrame:
    """``search`` among vectors (id, v, asks) of one number of components."""
    spark = rows.sparkSession
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    # Distinct vectors with their k + 1 smallest ids: more never reach a result.
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    distinct = (first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
                .withColumn("length", _length(F.col("v"))).checkpoint())
    longest = distinct.agg(F.max("length")).first()[0]
    step = F.floor((F.log2(F.lit(longest)) - F.log2("length")) / BAND).cast("int")
    starts = _starts([(r["step"], r["count"]) for r in distinct.groupBy(step.alias("step")).count().orderBy("step").collect()])
    distinct = distinct.withColumn("band", (F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= step)) - 1).cast("int"))
    sizes = {r["band"]: r["count"] for r in distinct.groupBy("band").count().collect()}
    bands = range(len(starts))
    n_pivots = [max(1, min(PIVOTS, sizes[b] // ROWS_PER_PIVOT)) for b in bands]
    files = [min(FILES, p) for p in n_pivots]
    pivots = [_matrix(distinct.where(F.col("band") == b).orderBy(F.xxhash64("rep"), "rep").limit(n_pivots[b]).select("v").toPandas()["v"]) for b in bands]
    shared = spark.sparkContext.broadcast([p / np.linalg.norm(p, axis=1, keepdims=True) for p in pivots])
    asking = rows.where("asks").select("v", F.col("id").alias("query_id")).join(distinct.select("v", "rep"), "v").select("query_id", "rep")
    queries = distinct.join(asking.select("rep").distinct(), "rep", "left_semi")
    n_queries = queries.count()
    v_blocks = [-(-sizes[b] * files[b] // (n_pivots[b] * BLOCK)) for b in bands]
    q_blocks = [max(1, -(-n_queries * files[b] // (n_pivots[b] * BLOCK))) for b in bands]

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for band, own in b.groupby("band"):
                order = _orders(_matrix(own["v"]), shared.value[band])[:, :files[band]]
                n = order.shape[1]
                yield pd.DataFrame({"band": np.int32(band), "pivot": order.ravel().astype(np.int32), "rep": own["rep"].to_numpy().repeat(n), "v": own["v"].repeat(n).to_numpy()})

    kind = distinct.schema["v"].dataType.simpleString()
    of_band = lambda values: F.get(F.array(*map(F.lit, values)), F.col("band"))
    def post(df: DataFrame, own: str, blocks: list[int], other: str, others: list[int]) -> DataFrame:
        return (df.select("band", "rep", "v").mapInPandas(posted, f"band int, pivot int, rep long, v {kind}")
                .withColumn(own, F.pmod(F.xxhash64("rep"), of_band(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), of_band(others) - 1))))

    def met(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Best of a block of a file for a block of the queries that visit it."""
        out = []
        if len(left) and len(right):
            q, v = _matrix(left["v"]), _matrix(right["v"])
            own = shared.value[key[0]]
            rq, rv = _ranks(_orders(q, own)), np.ascontiguousarray(_ranks(_orders(v, own)).T)
            q_ids, v_ids = left["rep"].to_numpy(), right["rep"].to_numpy()
            keep = min(len(v), max(KEEP_LEAST, int(KEEP * len(v))))
            for i in range(len(q)):
                foot = np.zeros(len(v), np.int32 if len(own) > 180 else np.int16)
                for p in range(len(own)):
                    foot += np.abs(rv[p] - rq[i, p])
                near = np.argpartition(foot, keep - 1)[:keep] if keep < len(v) else np.arange(len(v))
                scores = v[near] @ q[i]
                if len(near) > k + 1:
                    cut = np.partition(scores, len(near) - k - 1)[len(near) - k - 1]
                    near, scores = near[scores >= cut], scores[scores >= cut]
                best = np.lexsort((v_ids[near], -scores))[:k + 1]
                out.append(pd.DataFrame({"q": q_ids[i], "rep": v_ids[near[best]], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []})

    visits = queries.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    found = (post(visits, "qb", q_blocks, "vb", v_blocks).groupBy("band", "pivot", "qb", "vb")
             .cogroup(post(distinct, "vb", v_blocks, "qb", q_blocks).groupBy("band", "pivot", "qb", "vb"))
             .applyInPandas(met, "q long, rep long, score double"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    # Files of one pair may differ in the last bit of its score: one of them counts.
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    rows_found = found.join(distinct.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    ordered = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows_found = rows_found.withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= k + 1)
    answer = (asking.join(rows_found, asking["rep"] == rows_found["q"]).where("query_id <> vec_id")
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("rank") <= k))
    return answer.select("query_id", "rank", "vec_id", "score")
