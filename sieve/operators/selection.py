"""Selection of pool rows from a score table.

Input everywhere: ``target_id bigint, src int, pool_id bigint, score double``
(one row per scored (target, pool row)). Output: the selected pool rows with
``score`` (the score recorded at selection) and a 1-based ``sel_rank`` giving
the output order.

Round robin in closed form
--------------------------
Targets take turns in ``target_id`` order; each turn pops the next element of
that target's sorted list. The element of rank ``r`` in target ``t``'s list is
therefore popped at step ``(r, t)``, and a pool row is selected at its first
pop. So the selection is: rank every list (window), drop rows that would be
skipped (not allowed, infinite score) *after* ranking because they still use
up the turn, take per pool row the minimal ``(r, t)`` (a grouped ``min`` over
a struct), and keep the first K first-picks in ``(r, t)`` order. Positions are
computed without a global window: a first pick's position is the number of
first picks in earlier rounds plus its place inside its round (a round holds
at most one row per target).

Deviations from the reference (documented): K = 0 returns nothing; an
exhausted set of lists returns fewer rows instead of looping or raising; a
target whose scores are all equal normalises to 0 instead of dividing by zero;
the unhandled method names ``tradeoff`` and ``diff`` are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.sampling import global_topk
from sieve.operators.similarity import TargetBlocks, TargetMatrix, cosine_scores, grouped_topk, mean_scores_fused, rank_order, target_matrix, topk_per_target

DEPTH_SHARE = 2             # the first list depth tried is so many times k / targets
METHODS = ("min", "max", "mean_min", "mean_max", "normalized_mean_min", "normalized_mean_max")


def _finite(c):
    return ~F.isnan(c) & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf")))


def _restrict(df: DataFrame, allow: DataFrame | None) -> DataFrame:
    """Keep rows whose (src, pool_id) is in ``allow`` (semi join)."""
    if allow is None:
        return df
    keys = [c for c in ("src", "pool_id") if c in allow.columns]
    return df.join(allow.select(*keys).distinct(), on=keys, how="left_semi")


def drop_invalid_ids(scores: DataFrame) -> DataFrame:
    """Malformed entries carry pool index -1; drop them (``-1`` and ``"-1"``)."""
    return scores.filter(F.col("pool_id") != -1)


# --------------------------------------------------------------------------
# round robin
# --------------------------------------------------------------------------

def first_picks(ranked: DataFrame) -> DataFrame:
    """(src, pool_id) -> its earliest (rank, target_id) and the score there."""
    first = F.min(F.struct(F.col("rank").alias("r"), F.col("target_id").alias("t"), F.col("score").alias("s")))
    return (ranked.groupBy("src", "pool_id").agg(first.alias("f"))
            .select("src", "pool_id", F.col("f.r").alias("round"), F.col("f.t").alias("target_id"),
                    F.col("f.s").alias("score")))


def order_first_picks(firsts: DataFrame, k: int) -> DataFrame:
    """Number first picks in (round, target) order and keep the first k.

    Every round that appears holds at least one first pick, so the first k
    picks lie in the k smallest rounds: only those rounds are counted (a table
    of at most k rows, so the running sum over it and its broadcast are bounded
    by the selection size). Rows inside a round are numbered per round (at most
    one row per target)."""
    per_round = firsts.groupBy("round").agg(F.count(F.lit(1)).alias("n_round"))
    first_rounds = global_topk(per_round, [F.col("round").asc()], k)
    running = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = first_rounds.select("round", (F.sum("n_round").over(running) - F.col("n_round")).alias("before"))
    inside = Window.partitionBy("round").orderBy("target_id")
    return (firsts.join(F.broadcast(offsets), "round")
            .withColumn("sel_rank", F.col("before") + F.row_number().over(inside))
            .filter(F.col("sel_rank") <= k)
            .drop("before"))


def _no_picks(spark) -> DataFrame:
    return spark.createDataFrame([], "src int, pool_id bigint, round int, target_id bigint, score double, sel_rank bigint")


def _round_robin(scores_at, longest, n_targets: int, k: int, largest: bool, allow: DataFrame | None, salt_buckets: int | None) -> DataFrame:
    """``scores_at(depth)`` holds at least every target's best ``depth`` rows;
    ``longest()`` is no less than the length of the longest list.

    The lists are ranked to a depth that grows from below. Once k first picks lie
    within a depth they are final: what lies deeper is popped in later rounds.
    The first depth gives each target twice its share of k, so with many targets
    lists stay far shorter than k."""
    def attempt(depth: int) -> DataFrame:
        ranked = topk_per_target(scores_at(depth), depth, largest=largest, salt_buckets=salt_buckets)
        if not largest:
            ranked = ranked.filter(_finite(F.col("score")))
        ranked = _restrict(ranked, allow)
        return first_picks(ranked)

    # ``max`` cuts every list at k before the turns start
    depth, most = min(k, math.ceil(DEPTH_SHARE * k / max(1, n_targets))), k if largest else None
    while True:
        # at most targets x depth rows: written once to the checkpoint folder,
        # so the count and the numbering below do not score the pool again
        firsts = attempt(depth).checkpoint()
        if firsts.count() >= k:
            break
        if most is None:
            most = longest()
        if depth >= most:
            break
        depth = min(depth * 4, most)
    return order_first_picks(firsts, k)


def select_round_robin(scores: DataFrame, k: int, largest: bool = True, allow: DataFrame | None = None,
                       salt_buckets: int | None = None) -> DataFrame:
    """Round-robin selection (``max``: best first; ``min``: smallest first).

    ``max`` cuts every list at K before the turns start, as the reference does,
    so rows removed by the allow-list are not replaced and fewer than K can come
    back. ``min`` has no pre-cut. In both the list depth needed is found by
    widening from below, with infinite scores and disallowed rows using up turns.
    """
    if k <= 0:
        return _no_picks(scores.sparkSession)
    scores = drop_invalid_ids(scores)
    return _round_robin(lambda depth: scores, lambda: scores.groupBy("target_id").count().agg(F.max("count")).first()[0] or 0,
                        scores.select("target_id").distinct().count(), k, largest, allow, salt_buckets)


def select_round_robin_from_pool(pool: DataFrame, targets, k: int, largest: bool = True, allow: DataFrame | None = None,
                                 **columns) -> DataFrame:
    """:func:`select_round_robin` over a pool (``pool_id, vec``, maybe ``src``) and
    its targets. Each depth tried is one top-k scan at that depth, so the
    pool x target table is never built, in ``min`` mode and with an allow-list
    neither."""
    if k <= 0:
        return _no_picks(pool.sparkSession)
    pool = pool.filter(F.col(columns.get("pool_id", "pool_id")) != -1)
    tm = targets if isinstance(targets, (TargetMatrix, TargetBlocks)) else target_matrix(targets)
    return _round_robin(lambda depth: cosine_scores(pool, tm, mode="topk", k=depth, largest=largest, **columns), pool.count,
                        len(tm.ids), k, largest, allow, None)


# --------------------------------------------------------------------------
# mean modes
# --------------------------------------------------------------------------

def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean score of each pool row over the targets that scored it."""
    return drop_invalid_ids(scores).groupBy("src", "pool_id").agg(F.avg("score").alias("score"))


def minmax_normalised(scores: DataFrame) -> DataFrame:
    """Per-target min-max scaling to [0, 1]; constant targets give 0. For a whole
    score matrix see :meth:`sieve.operators.tiles.ScoreTiles.scaled`."""
    scores = drop_invalid_ids(scores)
    bounds = scores.groupBy("target_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return (scores.join(bounds, "target_id")
            .withColumn("score", F.coalesce(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")),
                                            F.lit(0.0)))
            .drop("lo", "hi"))


def _take_sorted(means: DataFrame, k: int, largest: bool) -> DataFrame:
    if k <= 0:
        return means.withColumn("sel_rank", F.lit(0).cast("long")).limit(0)
    if largest:
        # sorted ascending, last K kept: ties at the cut keep the later row;
        # output stays ascending (best last)
        top = global_topk(means, [F.col("score").desc(), F.col("src").desc(), F.col("pool_id").desc()], k)
    else:
        top = global_topk(means, [F.col("score").asc(), F.col("src").asc(), F.col("pool_id").asc()], k)
    # at most K rows: the selection size, not the data size
    w = Window.orderBy(F.col("score").asc(), F.col("src").asc(), F.col("pool_id").asc())
    return top.withColumn("sel_rank", F.row_number().over(w).cast("long"))


def select_from_means(means: DataFrame, k: int, largest: bool) -> DataFrame:
    """Mean-mode selection from a ``src, pool_id, score`` table of means (for
    example :func:`sieve.operators.similarity.mean_scores_fused`)."""
    return _take_sorted(means, k, largest)


def select_mean(scores: DataFrame, k: int, largest: bool = False, normalised: bool = False) -> DataFrame:
    base = minmax_normalised(scores) if normalised else scores
    return _take_sorted(mean_scores(base), k, largest)


def select(scores: DataFrame, method: str, k: int, allow: DataFrame | None = None) -> DataFrame:
    """Dispatch by method name as the reference does (substring order:
    normalized_mean, mean, min, max). The allow-list only applies to the
    round-robin modes."""
    if method not in METHODS:
        raise ValueError(f"unsupported selection method {method!r}")
    largest = not method.endswith("min")
    if "normalized_mean" in method:
        return select_mean(scores, k, largest, normalised=True)
    if "mean" in method:
        return select_mean(scores, k, largest)
    return select_round_robin(scores, k, largest=largest, allow=allow)


def select_from_pool(pool: DataFrame, targets, method: str, k: int, allow: DataFrame | None = None, **columns) -> DataFrame:
    """:func:`select` without a score table: the mean modes read the pool in one
    scan (normalised: two) that emits a mean per row, the others as
    :func:`select_round_robin_from_pool`."""
    if method not in METHODS:
        raise ValueError(f"unsupported selection method {method!r}")
    largest = not method.endswith("min")
    if "mean" not in method:
        return select_round_robin_from_pool(pool, targets, k, largest, allow, **columns)
    pool = pool.filter(F.col(columns.get("pool_id", "pool_id")) != -1)
    return select_from_means(mean_scores_fused(pool, targets, normalised="normalized" in method, **columns), k, largest)


# --------------------------------------------------------------------------
# quotas
# --------------------------------------------------------------------------

def domain_quotas(weights: DataFrame, k: int) -> DataFrame:
    """``domain, weight`` -> ``domain, weight (normalised), quota = weight * K``."""
    total = Window.partitionBy()
    return (weights.withColumn("weight", F.col("weight") / F.sum("weight").over(total))
            .withColumn("quota", F.col("weight") * F.lit(float(k))))


def fold_domain(col):
    """Every domain containing "science" counts as the domain "science"."""
    return F.when(col.contains("science"), F.lit("science")).otherwise(col)


def quota_candidates(scored: DataFrame, quotas: DataFrame, factor: int = 1) -> DataFrame:
    """Bound the lists before the sequential pass: each (target, domain) list is
    cut at ``factor * ceil(quota_d)`` rows in ascending score order. Domains
    with quota 0 (or no weight) are always skipped, so they are dropped. The
    cut is a ``row_number`` limit, so Spark keeps only the bounded rows of each
    partition before the shuffle; no full per-target sort is needed. ``_cut``
    marks the last kept row of a list that had more rows."""
    q = quotas.select("domain", "quota").filter(F.col("quota") > 0)
    qmax = q.agg(F.max("quota")).first()[0] or 0.0       # one row per weighted domain
    limit = int(math.ceil(qmax)) * factor
    with_q = scored.join(F.broadcast(q), "domain")        # quotas: one row per domain
    w = Window.partitionBy("target_id", "domain").orderBy(*rank_order(False))
    bound = F.ceil(F.col("quota")) * F.lit(factor)
    counts = with_q.groupBy("target_id", "domain").agg(F.count(F.lit(1)).alias("_dn"))
    return (with_q.withColumn("_drank", F.row_number().over(w))
            .filter(F.col("_drank") <= limit)
            .filter(F.col("_drank") <= bound)
            .join(counts, ["target_id", "domain"])
            .withColumn("_cut", (F.col("_drank") == bound) & (F.col("_dn") > bound))
            .drop("_drank", "_dn"))


def _greedy_quota(pdf, k: int, quota: dict):
    """Sequential turn-taking on the bounded candidate lists of all targets.

    Counts per domain never decrease (a duplicate pick adds and removes one),
    so once a domain is full every later row of it is skipped. The pass is
    exact unless a target popped the last kept row of a cut list while that
    domain was still open; such domains come as rows of ``sel_rank`` 0 whose
    ``exact`` is false, and the caller widens."""
    import pandas as pd

    lists = {}
    ordered = pdf.sort_values(["target_id", "score", "src", "pool_id"], kind="mergesort")
    for t, g in ordered.groupby("target_id", sort=True):
        g = g.reset_index(drop=True)
        lists[t] = list(zip(g["src"], g["pool_id"], g["score"], g["domain"], g["allowed"], g.index + 1, g["_cut"]))
    pos = {t: 0 for t in lists}
    counts: dict = {}
    seen = set()
    out = []
    open_cuts = []  # domains whose list was cut for some target after its last kept row was popped
    while len(out) < k:
        progressed = False
        for t in sorted(lists):
            lst = lists[t]
            while pos[t] < len(lst) and counts.get(lst[pos[t]][3], 0) >= quota.get(lst[pos[t]][3], 0.0):
                pos[t] += 1
            if pos[t] >= len(lst):
                continue
            progressed = True
            src, pid, score, dom, allowed, rank, cut = lst[pos[t]]
            pos[t] += 1
            counts[dom] = counts.get(dom, 0) + 1  # quota is used before the allow-list check
            if cut:
                open_cuts.append(dom)
            if allowed and (src, pid) not in seen:
                seen.add((src, pid))
                out.append((int(src), int(pid), int(rank), int(t), float(score), dom, len(out) + 1))
            elif allowed:
                counts[dom] -= 1
            if len(out) >= k:
                break
        if not progressed:
            break
    res = pd.DataFrame(out, columns=["src", "pool_id", "round", "target_id", "score", "domain", "sel_rank"])
    res["exact"] = True
    # a cut list is harmless when its domain was full by the end of the pass; each other's domain is reported by a row of rank 0
    short = sorted({dom for dom in open_cuts if counts.get(dom, 0) < quota.get(dom, 0.0)})
    said = pd.DataFrame([(0, 0, 0, 0, 0.0, dom, 0, False) for dom in short], columns=[*res.columns])
    return pd.concat([res, said]) if short else res


QUOTA_SCHEMA = ("src int, pool_id bigint, round int, target_id bigint, score double, domain string, "
                "sel_rank int, exact boolean")


def select_round_robin_quota_from_pool(pool: DataFrame, targets, weights: DataFrame, k: int, allow: DataFrame | None = None, domain: str = "domain", **columns) -> DataFrame:
    """:func:`select_round_robin_quota` without a score table: the pool carries its
    ``domain``, and one scan gives every (target, domain) list to a depth.

    A domain can be picked its quota of times, by all targets together, so a first
    depth of twice its share per target mostly does. The walk sees targets times the
    depths' sum, about ``2 K + targets x domains`` rows, bounded by what is selected
    and not by the pool, in one task. If it used up a list that went on while its
    domain was open, that domain's depth is raised and the pool is scanned again."""
    spark = pool.sparkSession
    quotas = {r["domain"]: float(r["quota"]) for r in domain_quotas(weights, max(k, 0)).collect() if r["quota"] > 0}     # one row per domain
    if k <= 0 or not quotas:
        return spark.createDataFrame([], QUOTA_SCHEMA).drop("exact")
    tm = targets if isinstance(targets, (TargetMatrix, TargetBlocks)) else target_matrix(targets)
    rows = pool.filter(F.col(columns.get("pool_id", "pool_id")) != -1).withColumn("__domain", fold_domain(F.col(domain)))
    depths = {d: max(1, math.ceil(DEPTH_SHARE * q / max(1, len(tm.ids)))) for d, q in quotas.items()}
    while True:
        lists = grouped_topk(rows, tm, depths, group="__domain", largest=False, **columns).filter(_finite(F.col("score")))
        cand = lists.select("target_id", "src", "pool_id", "score", F.col("grp").alias("domain"), F.col("more").alias("_cut"))
        if allow is not None:
            allowed = allow.select("src", "pool_id").distinct().withColumn("allowed", F.lit(True))
            cand = cand.join(allowed, ["src", "pool_id"], "left").fillna({"allowed": False})
        else:
            cand = cand.withColumn("allowed", F.lit(True))
        out = (cand.withColumn("_one", F.lit(1)).groupBy("_one")
               .applyInPandas(lambda pdf: _greedy_quota(pdf, k, quotas), QUOTA_SCHEMA)).checkpoint()
        short = {r["domain"] for r in out.where(~F.col("exact")).select("domain").distinct().collect()}
        if not short:
            return out.where("sel_rank > 0").drop("exact")
        depths = {d: n * 4 if d in short else n for d, n in depths.items()}


def select_round_robin_quota(scores: DataFrame, domains: DataFrame, weights: DataFrame, k: int,
                             allow: DataFrame | None = None) -> DataFrame:
    """Round robin (ascending) with per-domain quotas.

    The quota state makes the turn order data dependent, so the final pass is
    sequential. Spark does the heavy work (cutting every (target, domain) list
    at ceil(quota) with a partial group limit), which leaves about
    ``targets x (K + domains)`` candidate rows; the pass over those runs as one
    grouped-map task, and is repeated with deeper lists in the rare case it
    reports that a cut could have mattered. Infinite scores are removed before
    ranking (documented simplification); a quota shortfall returns what fits.
    """
    if k <= 0:
        return scores.sparkSession.createDataFrame([], QUOTA_SCHEMA).drop("exact")
    quotas = domain_quotas(weights, k)
    qmap = {r["domain"]: float(r["quota"]) for r in quotas.collect()}  # one row per domain weight
    dom = domains.select("src", "pool_id", fold_domain(F.col("domain")).alias("domain"))
    scored = drop_invalid_ids(scores).filter(_finite(F.col("score"))).join(dom, ["src", "pool_id"])
    factor = 1
    while True:
        cand = quota_candidates(scored, quotas, factor)
        if allow is not None:
            allowed = allow.select("src", "pool_id").distinct().withColumn("allowed", F.lit(True))
            cand = cand.join(allowed, ["src", "pool_id"], "left").fillna({"allowed": False})
        else:
            cand = cand.withColumn("allowed", F.lit(True))
        cand = cand.select("target_id", "src", "pool_id", "score", "domain", "allowed", "_cut")
        out = (cand.withColumn("_one", F.lit(1)).groupBy("_one")
               .applyInPandas(lambda pdf: _greedy_quota(pdf, k, qmap), QUOTA_SCHEMA)).checkpoint()
        if not out.where(~F.col("exact")).limit(1).count():
            return out.drop("exact")
        if factor > 1 << 20:
            raise RuntimeError("quota lists are still too short to be exact")
        factor *= 4


__all__ = [
    "METHODS", "select", "select_from_pool", "select_round_robin", "select_round_robin_from_pool", "select_mean", "mean_scores", "minmax_normalised",
    "first_picks", "order_first_picks", "drop_invalid_ids", "domain_quotas", "fold_domain",
    "select_round_robin_quota", "select_round_robin_quota_from_pool", "quota_candidates",
]
