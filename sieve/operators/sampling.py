"""Seeded, deterministic sampling.

The reference draws with Python/HF RNGs; bit-equal draws are not a goal. Here a
row's random key is ``md5("<seed>|<id>")`` (hex string, ties by id), which is
the same under any partitioning and the same in DuckDB, so every sampler has a
SQL oracle. ``DataFrame.sample`` is not used where an exact n is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_topk(df: DataFrame, order: list[Column], k: int, fan_in: int = 32) -> DataFrame:
    """First k rows of ``df`` in ``order``, reduced as a two-level tree.

    ``orderBy().limit(k)`` alone sends k rows from every partition to one task
    (partitions x k rows). Here each input partition first keeps its best k
    (a partial group limit inside the map stage, keyed by the partition number
    divided by ``fan_in``), groups of ``fan_in`` partitions are reduced to k in
    parallel, and only ``partitions / fan_in x k`` rows reach the final merge.
    """
    w = Window.partitionBy("_grp").orderBy(*order)
    reduced = (df.withColumn("_grp", F.floor(F.spark_partition_id() / F.lit(fan_in)))
               .withColumn("_grn", F.row_number().over(w))
               .filter(F.col("_grn") <= k)
               .drop("_grp", "_grn"))
    return reduced.orderBy(*order).limit(k)


def bottom_by_key(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest (``key``, ``id_col``), where ``key`` is a
    uniformly distributed hex digest. A distributed prefix filter first keeps
    about 1.2 n rows (widened until it holds at least n), so the ordered cut
    never sees the whole table."""
    total = df.count()
    if total <= n:
        return df
    frac = min(1.0, 1.2 * n / total + 1e-9)
    while True:
        limit = min(16 ** 8 - 1, int(frac * 16 ** 8))
        cand = df.filter(F.substring(F.col(key), 1, 8) <= F.lit(f"{limit:08x}"))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    return global_topk(cand, [F.col(key), F.col(id_col)], n)


def seeded_key(seed: int, id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def shuffle_order(seed: int, id_col: str) -> list[Column]:
    return [seeded_key(seed, id_col), F.col(id_col)]


def sample_shuffle_take(df: DataFrame, n: int | None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded shuffle, then the first n rows (n capped at the size; None = all).
    Adds ``shuffle_rank`` (1-based order in the shuffled set)."""
    keyed = df.withColumn("_k", seeded_key(seed, id_col))
    if n is None:
        # whole set: order is irrelevant for a set, keep the key for callers
        return keyed.withColumnRenamed("_k", "shuffle_key")
    if n is not None:
        if n <= 0:
            return keyed.drop("_k").withColumn("shuffle_rank", F.lit(0).cast("long")).limit(0)
        # only (key, id) go through the global top-n; the rows are joined back
        cut = global_topk(keyed.select("_k", id_col), [F.col("_k"), F.col(id_col)], n)
        keyed = keyed.join(cut, ["_k", id_col], "left_semi")
    w = Window.orderBy("_k", id_col)   # at most n rows here: the sample size
    return keyed.withColumn("shuffle_rank", F.row_number().over(w).cast("long")).drop("_k")


def sample_fit(df: DataFrame, fit: int, seed: int = 42, id_col: str = "pool_id") -> DataFrame:
    """Exact uniform sample of ``fit`` rows for the whitening fit (all rows when
    fit exceeds the count). Independent of the number of partitions."""
    keyed = df.withColumn("_k", seeded_key(seed, id_col))
    cut = bottom_by_key(keyed.select("_k", id_col), "_k", id_col, fit)
    return keyed.join(cut, ["_k", id_col], "left_semi").drop("_k")


def sample_group_cap(df: DataFrame, group: str, m: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """At most m rows per group, without replacement. ``row_number <= m`` lets
    Spark keep only m rows per group and partition before the shuffle, so a
    hot group costs no more than any other."""
    w = Window.partitionBy(group).orderBy(*shuffle_order(seed, id_col))
    return df.withColumn("group_rank", F.row_number().over(w)).filter(F.col("group_rank") <= m)


def sample_n_shot(df: DataFrame, group: str, n: int, seed: int = 42, id_col: str = "id",
                  check: bool = True) -> DataFrame:
    """Exactly n rows per group; a group with fewer rows is an error."""
    out = sample_group_cap(df, group, n, seed, id_col)
    if check:
        short = out.groupBy(group).count().filter(F.col("count") < n).limit(1).collect()
        if short:
            raise ValueError(f"group {short[0][group]!r} has fewer than {n} rows")
    return out


def sample_round_robin(df: DataFrame, group: str, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One random row per group per pass until at least n rows are drawn (full
    passes), then a seeded shuffle and the first n. A group that runs out is
    skipped in later passes."""
    if n <= 0:
        return df.withColumn("shuffle_rank", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy(group).orderBy(*shuffle_order(seed, id_col))
    # a pass beyond n is never needed (every pass draws at least one row), and
    # the limit keeps only n rows per group before the shuffle
    passes = df.withColumn("_pass", F.row_number().over(w)).filter(F.col("_pass") <= n)
    per_pass = passes.groupBy("_pass").agg(F.count(F.lit(1)).alias("c"))
    # pass p is drawn when fewer than n rows were drawn before it (full passes);
    # one row per pass, at most n rows
    running = Window.orderBy("_pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = (per_pass.withColumn("_before", F.sum("c").over(running) - F.col("c"))
              .filter(F.col("_before") < n).select("_pass"))
    drawn = passes.join(needed, "_pass", "left_semi").drop("_pass")
    return sample_shuffle_take(drawn, n, seed, id_col)


def holdout_slice(df: DataFrame, skip: int, n: int, order_col: str) -> DataFrame:
    """Drop the first ``skip`` rows in ``order_col`` order and keep the next n."""
    return df.orderBy(order_col).offset(skip).limit(n)


def repeat_samples(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, numbered ``completion_id`` 0..n-1."""
    return df.withColumn("completion_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
