"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's target is a share of the whole mix by weight, cut at a multiple
of the source's own size with the excess shared anew. Sources are divided into
shards by a seeded hash, and a shard, its documents in seeded order, into blocks
of equal token count. The mix's blocks go to sources by highest quotients
target / (2 k + 1), for the source's block k, and a source's blocks to its shards
in the same way: integer quotas. A shard's quota selects blocks from a seeded
start on, round the shard as often as it takes; a document's taken words are
those that lie in selected blocks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
MIX_PERCENT = 150
MOST_PASSES = 2
BLOCK_WORDS = 16
SHARD_WORDS = 250_000
SHARDS_MOST = 4096           # of a source; its shards grow with it beyond
SOURCES_MOST = 1_000_000     # one row of each is held on the driver
QUOTAS_BROADCAST = 100_000   # rows of quotas that are broadcast; more are joined by shuffle


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, percent: int = MIX_PERCENT,
            most: int = MOST_PASSES) -> dict[str | None, float]:
    """Words wanted of each source. ``sizes`` in the order in which the weights
    repeat; targets stop at ``most`` times the size, and what is over is shared
    anew by weight among the others until none is above."""
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    room = {s: float(most * n) for s, n in sizes}
    left, out, open_ = sum(n for _, n in sizes) * percent / 100, {}, [s for s, _ in sizes]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > room[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = room[s]
        open_ = [s for s in open_ if s not in out]
        left -= sum(room[s] for s in over)
    return out


def sainte_lague(wanted: dict, seats: int, room: dict) -> dict:
    """Integer quotas: each of ``seats`` goes to the highest quotient
    wanted / (2 k + 1); ties go to the earlier key; nobody exceeds its room.
    The seats below a common quotient are counted at once, then the rest, at most
    one for each key and tied or nearly so, are dealt one by one from a heap."""
    seats = min(seats, sum(room.values()))
    keys = [k for k in wanted if wanted[k] > 0 and room[k] > 0]
    got = {k: 0 for k in wanted}
    if not keys or seats <= 0:
        return got

    def above(q: float) -> dict:
        return {k: min(room[k], max(0, int((wanted[k] / q + 1) // 2))) for k in keys}

    low, high = 0.0, 2 * max(wanted[k] for k in keys)      # no seat has a quotient above high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if sum(above(mid).values()) <= seats else (mid, high)
    got |= above(high)
    dealt = sum(got.values())
    waiting = [(-wanted[k] / (2 * got[k] + 1), i) for i, k in enumerate(keys) if got[k] < room[k]]
    heapq.heapify(waiting)
    while dealt < seats and waiting:
        _, i = heapq.heappop(waiting)
        k = keys[i]
        got[k] += 1
        dealt += 1
        if got[k] < room[k]:
            heapq.heappush(waiting, (-wanted[k] / (2 * got[k] + 1), i))
    return got


def quotas(shards: list[tuple[str | None, int, int]], wanted: dict, most: int = MOST_PASSES,
           block: int = BLOCK_WORDS) -> list[tuple[str | None, int, int, int, int]]:
    """(source, shard, words, blocks, quota) of (source, shard, words) rows."""
    blocks = {(s, k): max(1, round(n / block)) if n else 0 for s, k, n in shards}
    room: dict = {}
    for (s, _), b in blocks.items():
        room[s] = room.get(s, 0) + most * b
    total = sum(n for *_, n in shards)
    seats = round(sum(wanted.values()) / (total / max(1, sum(blocks.values())))) if total else 0
    by_source = sainte_lague(wanted, seats, room)
    inside: dict = {}
    for s, k, n in shards:
        inside.setdefault(s, {})[k] = n
    quota = {(s, k): q for s, own in inside.items()
             for k, q in sainte_lague(own, by_source[s], {k: most * blocks[s, k] for k in own}).items()}
    return [(s, k, n, blocks[s, k], quota[s, k]) for s, k, n in shards]


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, percent: int = MIX_PERCENT, most: int = MOST_PASSES,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row's ``doc_id, size, source_size, target, taken``.

    Null texts have size 0; a null source is a source of its own, last in order.
    Rows repeated in id, text and source share one place in the order and divide
    its words evenly, what remains going one each to the first of them. An empty
    table gives an empty table; columns besides key, text and source are not
    read, so their names don't matter. Reruns take the same words: order and
    selection depend on the seed, ids and texts alone.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = (docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("place"))
            .groupBy("source", "place", "doc_id", "size").agg(F.count("*").alias("copies")).checkpoint())
    words = F.sum(F.col("size") * F.col("copies"))
    per_source = rows.groupBy("source").agg(words.alias("n")).limit(SOURCES_MOST + 1).collect()
    if len(per_source) > SOURCES_MOST:
        raise ValueError(f"more than {SOURCES_MOST} sources")
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    wanted = targets([(r["source"], r["n"]) for r in per_source], weights, percent, most)
    of = spark.createDataFrame([(r["source"], r["n"], float(wanted[r["source"]]), max(1, min(SHARDS_MOST, -(-r["n"] // SHARD_WORDS)))) for r in per_source],
                               "source string, source_size long, target double, n_shards long")
    of = F.broadcast(of) if len(per_source) <= QUOTAS_BROADCAST else of
    rows = (rows.join(of.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("shard", F.pmod(F.xxhash64("place"), F.col("n_shards"))))
    per_shard = rows.groupBy("source", "shard").agg(words.alias("n")).collect()     # at most SHARDS_MOST for a source, or one for each SHARD_WORDS
    per_shard = sorted(((r["source"], r["shard"], r["n"]) for r in per_shard), key=lambda r: (r[0] is None, (r[0] or "").encode(), r[1]))
    dealt = spark.createDataFrame(quotas(per_shard, wanted, most), "s string, k long, shard_size long, blocks long, quota long")
    dealt = F.broadcast(dealt) if len(per_shard) <= QUOTAS_BROADCAST else dealt
    rows = rows.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size")
    rows = rows.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("size") * F.col("copies"))
    # Block i begins at word floor(i * shard_size / blocks). Selected: blocks first .. first + rest - 1, round the shard.
    rest, first = F.expr("quota % blocks"), F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard")), F.col("blocks"))
    rows = (rows.withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0).cast("long")))
            .withColumn("first", F.when(F.col("blocks") > 0, first).otherwise(F.lit(0).cast("long")))
            .withColumn("last", F.when(F.col("blocks") > 0, F.col("first") + rest).otherwise(F.lit(0).cast("long"))))

    def inside(lo: str, hi: str) -> Column:
        """Words of [start, end) in blocks lo up to hi."""
        cut = "CASE WHEN blocks > 0 THEN ({}) * shard_size div blocks ELSE 0L END"
        return F.greatest(F.least(F.col("end"), F.expr(cut.format(hi))) - F.greatest(F.col("start"), F.expr(cut.format(lo))), F.lit(0).cast("long"))

    rows = rows.withColumn("whole", F.col("passes") * F.col("size") * F.col("copies")
                           + inside("first", "least(last, blocks)") + inside("0L", "greatest(last - blocks, 0L)"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    taken = F.expr("whole div copies") + (F.col("copy") <= F.expr("whole % copies")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
