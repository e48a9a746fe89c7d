"""From a pool and a target set to written rows and ids, in one call."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import selection as S
from sieve.operators import similarity as SIM
from sieve.operators import whitening as W
from sieve.plans import batch as B
from sieve.plans import fixtures as FX
from sieve.sources import readers as RD

SF = "/root/testdata/sf0.001"


def encode(df):
    """Words by hash into 16 places: a stand-in for a model, in built-in functions."""
    words = F.split(F.lower("text"), r"\s+")
    return df.withColumn("_w", words).withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(
        F.filter("_w", lambda w: F.pmod(F.xxhash64(w), F.lit(16)) == i)).cast("double") + 0.01)).drop("_w")


def test_rows_from_files_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RD, "NAMED_POOLS", {})
    pool = [{"id": f"c{i}", "dataset": "d", "messages": [{"role": "user", "content": f"question {i} {'gold' if i % 5 == 0 else 'tin'}"}, {"role": "assistant", "content": "ok"}]} for i in range(40)]
    (tmp_path / "pool.jsonl").write_text("\n".join(map(json.dumps, pool)))
    (tmp_path / "arena_hard.jsonl").write_text("\n".join(json.dumps({"prompt": f"question gold {i}", "label": "ok"}) for i in range(3)))
    RD.register_pool("mine", str(tmp_path / "pool.jsonl"))
    got = B.run(spark, "mine", "arena_hard", str(tmp_path), encode=encode, method="mean_max", k=6, out=str(tmp_path / "out"), max_length=64, keep_scores=str(tmp_path / "scores"))
    written = spark.read.json(str(tmp_path / "out" / "rows"))
    assert written.count() == got.count() == 6 and {"id", "messages", "influence_score", "sel_rank"} <= set(written.columns) and "vec" not in written.columns
    vectors = RD.render_pool(RD.read_named_pool(spark, "mine"), "mine")
    pv = {r["id"]: np.array(r["vec"]) for r in encode(vectors).collect()}
    tv = [np.array(r["vec"]) for r in B.target_vectors(spark, "arena_hard", str(tmp_path), encode, max_length=64).collect()]
    mean = {i: np.mean([v @ t / np.linalg.norm(v) / np.linalg.norm(t) for t in tv]) for i, v in pv.items()}
    assert sorted(r["influence_score"] for r in written.collect()) == pytest.approx(sorted(mean.values())[-6:])
    assert RD.read_similarity(spark, str(tmp_path / "scores"), "arena_hard").tiles.count() == 40


@pytest.mark.parametrize("method", ["max", "min", "normalized_mean_max"])
def test_ids_of_given_vectors(spark, tmp_path, method):
    pool, targets = FX.pool_vectors(spark, SF), FX.target_vectors(spark, SF)
    B.run(spark, pool, targets, method=method, k=20, out=str(tmp_path / method), output="ids")
    got = {(r["sel_rank"], r["pool_id"]) for r in spark.read.json(str(tmp_path / method / "ids")).collect()}
    assert got == {(r["sel_rank"], r["pool_id"]) for r in S.select(SIM.cosine_scores(pool, targets), method, 20).collect()}


def test_whitening_quotas_and_allow_lists(spark, tmp_path):
    pool, targets = FX.pool_vectors(spark, SF), FX.target_vectors(spark, SF)
    got = B.run(spark, pool, targets, method="mean_max", k=15, out=str(tmp_path / "w"), whiten=B.Whitening(16, fit=200))
    model = W.whiten_fit(pool, reddim=16, fit=200)
    want = S.select_from_pool(W.whiten_apply(pool, model), W.whiten_apply(targets.select("target_id", "vec"), model), "mean_max", 15)
    assert [r["pool_id"] for r in got.orderBy("sel_rank").collect()] == [r["pool_id"] for r in want.orderBy("sel_rank").collect()]
    weights = pool.groupBy("domain").agg(F.count("*").cast("double").alias("weight"))
    allow = pool.where("pool_id % 2 = 0").select("src", "pool_id")
    got = B.run(spark, pool, targets, method="min", k=15, out=str(tmp_path / "q"), weights=weights, allow=allow, output="ids")
    assert all(r["pool_id"] % 2 == 0 for r in got.collect()) and 0 < got.count() <= 15


def test_what_cannot_run(spark, tmp_path):
    pool, targets, out = FX.pool_vectors(spark, SF), FX.target_vectors(spark, SF), str(tmp_path / "x")
    for how, says in ((dict(output="table"), "rows or ids"), (dict(method="diff"), "unsupported"), (dict(weights=pool), "quotas go with"), (dict(method="mean_min", allow=pool), "round robins")):
        with pytest.raises(ValueError, match=says):
            B.run(spark, pool, targets, k=3, out=out, **how)
    with pytest.raises(ValueError, match="needs an encoder"):
        B.run(spark, pool.drop("vec"), targets, k=3, out=out)
    with pytest.raises(ValueError, match="need an encoder"):
        B.run(spark, pool, targets.drop("vec"), k=3, out=out)
    with pytest.raises(ValueError, match="pool_id or row_pos"):
        B.run(spark, pool.drop("pool_id"), targets, k=3, out=out)
