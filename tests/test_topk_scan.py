"""The top-k scan of a pool: bounded buffer, ties, K above a batch, no pair table."""

import numpy as np
import pytest

from sieve.operators import selection as S
from sieve.operators import similarity as SIM

POOL = "src int, pool_id long, vec array<double>"
TARGETS = "target_id long, vec array<double>"


def brute(S_, src, pid, k, largest):
    out = set()
    for t in range(S_.shape[1]):
        key = -S_[:, t] if largest else S_[:, t]
        ok = np.flatnonzero(~np.isnan(key))
        order = ok[np.lexsort((pid[ok], src[ok], key[ok]))][:k]
        out |= {(t, int(src[i]), int(pid[i])) for i in order}
    return out


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("k", [1, 7, 60, 10_000])
@pytest.mark.parametrize("values", ["ties", "distinct", "equal"])
def test_running_topk_keeps_the_best_with_a_small_buffer(monkeypatch, largest, k, values):
    monkeypatch.setattr(SIM, "EMIT_ROWS", 64)
    rng = np.random.default_rng(k)
    n, t = 900, 3
    S_ = {"ties": rng.integers(0, 4, (n, t)).astype(float), "distinct": rng.random((n, t)), "equal": np.ones((n, t))}[values]
    S_[rng.random((n, t)) < 0.05] = np.nan
    src, pid = rng.integers(0, 3, n).astype(np.int32), rng.permutation(n).astype(np.int64)
    best, out = SIM._RunningTopk(t, k, largest, 256), []
    for i in range(0, n, 50):
        out += best.add(S_[i:i + 50], src[i:i + 50], pid[i:i + 50])
        assert best.held <= 256
    out += best.end()
    got = {(int(c), int(s), int(p)) for part in out for c, s, p, _ in zip(*part)}
    assert brute(S_, src, pid, k, largest) <= got
    if k * t * 2 <= 256:
        assert len(got) <= 3 * k * t


def pool_and_targets(spark, n=4_000, t=3, d=4, seed=5):
    rng = np.random.default_rng(seed)
    pool = [(0, i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    targets = [(j, [float(x) for x in rng.normal(size=d)]) for j in range(t)]
    return spark.createDataFrame(pool, POOL).repartition(2, "pool_id"), spark.createDataFrame(targets, TARGETS)


def test_k_above_the_batch_emits_k_per_partition(spark):
    pool, targets = pool_and_targets(spark)
    k, before = 300, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        cand = SIM.cosine_scores(pool, targets, mode="topk", k=k)
        assert cand.count() == 2 * 3 * k
        got = {(r["target_id"], r["pool_id"]) for r in SIM.topk_per_target(cand, k).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(r["target_id"], r["pool_id"]) for r in SIM.topk_per_target(SIM.cosine_scores(pool, targets), k).collect()}
    assert got == want


def test_small_score_tiles_give_the_same(spark, monkeypatch):
    pool, targets = pool_and_targets(spark, n=500)
    modes = [dict(mode="topk", k=20), dict(mode="pairs"), dict(mode="mean")]
    key = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())                       # noqa: E731
    whole = [key(SIM.cosine_scores(pool, targets, **m)) for m in modes] + [key(SIM.mean_scores_fused(pool, targets, True))]
    monkeypatch.setattr(SIM, "TILE_BYTES", 200)
    assert whole == [key(SIM.cosine_scores(pool, targets, **m)) for m in modes] + [key(SIM.mean_scores_fused(pool, targets, True))]


@pytest.mark.parametrize("method", S.METHODS)
def test_selection_from_pool_equals_selection_from_scores(spark, method):
    pool, targets = pool_and_targets(spark, n=200)
    pool = pool.unionByName(spark.createDataFrame([(0, -1, [1.0, 0.0, 0.0, 0.0])], POOL))
    allow = None if "mean" in method else pool.where("pool_id % 3 = 0").select("src", "pool_id")
    for k in (0, 5, 150):
        rows = lambda df: [(r["sel_rank"], r["pool_id"], round(r["score"], 9)) for r in df.orderBy("sel_rank").collect()]     # noqa: E731
        assert rows(S.select_from_pool(pool, targets, method, k, allow)) == rows(S.select(SIM.cosine_scores(pool, targets), method, k, allow))


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("normalise", [True, False])
def test_histogram_cutoff_reduces_partitions_smaller_than_k(spark, largest, normalise):
    """K above every partition's rows: without a cut-off nothing could be dropped."""
    pool, targets = pool_and_targets(spark, n=6_000, d=16)
    pool, k = pool.repartition(12, "pool_id"), 700
    how = dict(mode="topk", k=k, largest=largest, normalise=normalise)
    without = SIM.cosine_scores(pool, targets, cutoff=False, **how)
    ahead = SIM.cosine_scores(pool, targets, cutoff=True, **how)
    assert without.count() == 3 * 6_000 and 3 * k <= ahead.count() <= 3 * k * 1.15
    rows = lambda df: sorted((r["target_id"], r["rank"], r["pool_id"]) for r in SIM.topk_per_target(df, k, largest).collect())        # noqa: E731
    assert rows(ahead) == rows(without)


@pytest.mark.parametrize("k", [1, 5, 39, 40, 41, 1_000])
def test_cutoff_with_ties_nan_and_short_lists(spark, k):
    vectors = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.0, 0.0], [float("nan"), 1.0]]
    pool = spark.createDataFrame([(0, i, vectors[i % 5]) for i in range(50)], POOL).repartition(4, "pool_id")
    targets = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], TARGETS)
    rows = lambda cutoff: sorted((r["target_id"], r["rank"], r["pool_id"]) for r in SIM.topk_per_target(                              # noqa: E731
        SIM.cosine_scores(pool, targets, mode="topk", k=k, cutoff=cutoff), k).collect())
    assert rows(True) == rows(False) and len(rows(True)) == 2 * min(k, 40)


def test_round_robin_depth_grows_from_below(spark, monkeypatch):
    """Many targets: lists of twice a target's share of K are ranked, not of K."""
    pool, targets = pool_and_targets(spark, n=3_000, t=40)
    depths, scan = [], S.cosine_scores
    monkeypatch.setattr(S, "cosine_scores", lambda *a, **b: depths.append(b["k"]) or scan(*a, **b))
    got = [(r["sel_rank"], r["pool_id"], r["target_id"]) for r in S.select_round_robin_from_pool(pool, targets, 400).orderBy("sel_rank").collect()]
    assert depths[0] == 20 and max(depths) <= 80
    whole = S.order_first_picks(S.first_picks(SIM.topk_per_target(SIM.cosine_scores(pool, targets), 400)), 400)
    assert got == [(r["sel_rank"], r["pool_id"], r["target_id"]) for r in whole.orderBy("sel_rank").collect()] and len(got) == 400


def test_an_allow_list_that_holds_little_widens_up_to_k(spark, monkeypatch):
    pool, targets = pool_and_targets(spark, n=600, t=5)
    allow = pool.where("pool_id % 50 = 0").select("src", "pool_id")
    depths, scan = [], S.cosine_scores
    monkeypatch.setattr(S, "cosine_scores", lambda *a, **b: depths.append(b["k"]) or scan(*a, **b))
    got = S.select_round_robin_from_pool(pool, targets, 100, allow=allow)
    assert depths == [40, 100]
    want = S.order_first_picks(S.first_picks(SIM.topk_per_target(SIM.cosine_scores(pool, targets), 100).join(allow, ["src", "pool_id"], "left_semi")), 100)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count() < 100
