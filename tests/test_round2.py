"""Cases beyond former caps and switches, and inputs that used to go wrong."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sieve.operators import scoring as SC
from sieve.operators import similarity as SIM
from sieve.sources import readers as RD


def test_csv_quoted_newline_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "algebra_test.csv").write_text('"first\nline",a,b,c,d,A\n"say ""hi"", twice",a,b,c,d,B\n')
    got = {r["question"]: r["answer"] for r in RD.read_csv_by_subject(spark, str(tmp_path)).collect()}
    assert got == {"first\nline": "A", 'say "hi", twice': "B"}


def test_file_target_has_no_cap_by_default():
    import inspect
    assert inspect.signature(RD.read_file_target).parameters["limit"].default is None


def test_row_position_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(4)))
    for bound in (RD.SPLITS_BROADCAST, 0):
        monkeypatch.setattr(RD, "SPLITS_BROADCAST", bound)
        got = RD.with_row_position(spark.read.text(str(tmp_path))).orderBy("row_pos").collect()
        assert [r["value"] for r in got] == [f"{i}-{j}" for i in range(3) for j in range(4)]
        assert [r["row_pos"] for r in got] == list(range(12))


def test_cache_is_used_only_if_complete_and_made_alike(spark, tmp_path):
    path, calls = str(tmp_path / "emb"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    RD.cached_embeddings(spark, path, compute, {"pooling": "mean"})
    RD.cached_embeddings(spark, path, compute, {"pooling": "mean"})
    assert len(calls) == 1
    with pytest.raises(ValueError):
        RD.cached_embeddings(spark, path, compute, {"pooling": "last"})
    (tmp_path / "emb" / "_SUCCESS").unlink()
    assert RD.cached_embeddings(spark, path, compute, {"pooling": "mean"}).count() == 3 and len(calls) == 2


def test_nan_rows_take_no_part_in_the_topk_scan(spark):
    pool = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0]] + [[float("nan"), 1.0]] * 3)], "pool_id long, vec array<double>").coalesce(1)
    targets = spark.createDataFrame([(0, [1.0, 0.0])], "target_id long, vec array<double>")
    for k in (1, 2, 10):
        assert [r["pool_id"] for r in SIM.cosine_scores(pool, targets, mode="topk", k=k).collect()] == [0]


def test_mean_over_several_target_blocks(spark):
    rng = np.random.default_rng(1)
    pool = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "pool_id long, vec array<double>")
    targets = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(6)], "target_id long, vec array<double>")
    pairs = SIM.cosine_scores(pool, targets, mode="pairs").groupBy("pool_id").agg(F.avg("score").alias("s"))
    expected = {r["pool_id"]: r["s"] for r in pairs.collect()}
    got = SIM.cosine_scores(pool, targets, mode="mean", max_broadcast_bytes=4 * 8 * 2).collect()
    assert {r["pool_id"]: pytest.approx(r["score"]) for r in got} == expected


def test_duplicate_predictions_need_an_order(spark):
    refs = spark.createDataFrame([("x", ["red fox"])], "id string, answers array<string>")
    preds = spark.createDataFrame([("x", "red fox", 1), ("x", "blue cow", 2), ("other", "red fox", 3)], "id string, prediction_text string, seq int")
    assert SC.squad_scores(refs, preds, order_col="seq").first()["em"] == 0
    with pytest.raises(PySparkException):
        SC.squad_scores(refs, preds).collect()


def test_rollup_has_one_overall_row(spark):
    rows = spark.createDataFrame([(True, None, "a", "c"), (False, "s", "a", "c")], "correct boolean, subject string, subcategory string, category string")
    got = {(r["level"], r["name"]): r["n"] for r in SC.accuracy_rollup(rows).collect()}
    assert got == {("subject", "s"): 1, ("subcategory", "a"): 2, ("category", "c"): 2, ("overall", "all"): 2}
