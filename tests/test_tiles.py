"""The tiled score matrix against the long form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import selection as S
from sieve.operators import similarity as SIM
from sieve.operators import tiles as TL
from sieve.sources import readers as RD
from sieve.sources import sinks as SK


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(0, 90, [0.0] * 6)]
    return spark.createDataFrame(rows, "src int, pool_id long, vec array<double>").repartition(3, "pool_id").cache()


@pytest.fixture(scope="module")
def targets(spark):
    rng = np.random.default_rng(4)
    # the last target is the zero vector: all its scores are equal
    return spark.createDataFrame([(7 * j, [float(x) for x in rng.normal(size=6)]) for j in range(10)] + [(99, [0.0] * 6)], "target_id long, vec array<double>")


def long(df):
    return {(r["target_id"], r["src"], r["pool_id"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("width", [1, 4, 11, 256])
def test_tiles_unnest_to_the_long_form(pool, targets, width):
    t = TL.score_tiles(pool, targets, width)
    assert long(t.unnest()) == pytest.approx(long(SIM.cosine_scores(pool, targets)), abs=1e-12)
    assert t.tiles.count() == 91 * -(-11 // width) and t.blocks.count() == -(-11 // width)


def test_scaling_means_and_bounds_work_on_tiles(pool, targets):
    t, flat = TL.score_tiles(pool, targets, 4), SIM.cosine_scores(pool, targets)
    assert long(t.scaled().unnest()) == pytest.approx(long(S.minmax_normalised(flat)), abs=1e-12)
    means = lambda df: {(r["src"], r["pool_id"]): r["score"] for r in df.collect()}                     # noqa: E731
    assert means(t.means()) == pytest.approx(means(S.mean_scores(flat)), abs=1e-12)
    lo = {r["block"]: r["lo"] for r in t.bounds().collect()}
    want = {r["target_id"]: r["lo"] for r in flat.groupBy("target_id").agg(F.min("score").alias("lo")).collect()}
    assert [x for b in sorted(lo) for x in lo[b]] == pytest.approx([want[i] for i in sorted(want)], abs=1e-12)


def test_no_plan_holds_a_row_per_pair(pool, targets):
    t = TL.score_tiles(pool, targets, 4)
    for df in (t.tiles, t.scaled().tiles, t.means(), TL.columns_of(pool, targets)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Cartesian" not in plan and "Join Cross" not in plan


def test_targets_beyond_the_driver_limit_are_read_block_by_block(spark, pool, targets, monkeypatch):
    flat = SIM.cosine_scores(pool, targets)
    whole = long(flat), long(SIM.topk_per_target(SIM.cosine_scores(pool, targets, mode="topk", k=7), 7)), {r["pool_id"]: r["score"] for r in SIM.mean_scores_fused(pool, targets, True).collect()}
    picks = [r["pool_id"] for r in S.select_round_robin_from_pool(pool, targets, 30).orderBy("sel_rank").collect()]
    monkeypatch.setattr(SIM, "DEFAULT_MAX_DRIVER_BYTES", 100)
    tm = SIM.target_matrix(targets, max_broadcast_bytes=4 * 6 * 8)
    assert isinstance(tm, SIM.TargetBlocks) and [len(ids) for ids, _ in tm.blocks] == [4, 4, 3]
    assert long(SIM.cosine_scores(pool, tm)) == pytest.approx(whole[0], abs=1e-12) and long(TL.score_tiles(pool, tm, 3).unnest()) == pytest.approx(whole[0], abs=1e-12)
    assert long(SIM.topk_per_target(SIM.cosine_scores(pool, tm, mode="topk", k=7, cutoff=True), 7)) == pytest.approx(whole[1], abs=1e-12)
    assert {r["pool_id"]: r["score"] for r in SIM.mean_scores_fused(pool, tm, True).collect()} == pytest.approx(whole[2], abs=1e-12)
    assert [r["pool_id"] for r in S.select_round_robin_from_pool(pool, tm, 30).orderBy("sel_rank").collect()] == picks


def test_empty_sides(pool, targets):
    assert TL.score_tiles(pool, targets.limit(0)).tiles.count() == 0 == TL.score_tiles(pool.limit(0), targets).tiles.count()
    assert TL.columns_of(pool, targets.limit(0)).count() == 0 == TL.columns_of(pool.limit(0), targets).count()
    assert TL.score_tiles(pool.limit(0), targets).scaled().means().count() == 0


def test_shards_are_stored_and_read_as_one(spark, pool, targets, tmp_path):
    path, tm = str(tmp_path / "sim"), SIM.target_matrix(targets)
    for n in (0, 1):
        SK.write_similarity(TL.score_tiles(pool.where(F.col("src") == n), tm, 4), path, "set_a", n_layer=2)
    back = RD.read_similarity(spark, path, "set_a")
    assert long(back.unnest()) == pytest.approx(long(SIM.cosine_scores(pool, targets)), abs=1e-12)
    assert back.blocks.count() == 3 and {r["n_layer"] for r in back.tiles.select("n_layer").distinct().collect()} == {2}
    other = TL.score_tiles(pool, targets.where("target_id < 30"), 4)
    with pytest.raises(ValueError, match="different targets"):
        SK.write_similarity(other, path, "set_a")
    SK.write_similarity(other, path, "set_b", n_layer=2)
    assert RD.read_similarity(spark, path, "set_b").blocks.count() == 2
    with pytest.raises(ValueError, match="different targets"):
        back.union(other)


def test_influence_arrays(spark, pool, targets, tmp_path):
    path = str(tmp_path / "influence")
    SK.write_influence(TL.columns_of(pool, targets, rows=7), path)
    spark.createDataFrame([(0, {"-1": 0.5, "1000": 0.25, "999": 0.125}), (7, {" -1 ": 1.0}), (14, {}), (21, None)], "target_id long, scores map<string,double>").write.mode("append").json(path)
    got = {}
    for r in RD.read_influence_columns(spark, path).collect():
        assert r["pool_ids"] == sorted(r["pool_ids"])
        got |= {(r["target_id"], i): s for i, s in zip(r["pool_ids"], r["scores"])}
    want = {(t, p): s for (t, _, p), s in long(SIM.cosine_scores(pool, targets)).items()}
    assert got == pytest.approx(want | {(0, 999): 0.125, (0, 1000): 0.25}, abs=1e-12)
