"""Edge rows and invariants for vectors, text, chat and scoring operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.functions import chat as C
from sieve.functions import text as T
from sieve.functions import vectors as V
from sieve.operators import pooling as P
from sieve.operators import projection as PR
from sieve.operators import scoring as SC
from sieve.operators import similarity as SIM
from sieve.operators import tiles as TL
from sieve.operators import whitening as W
from sieve.plans import fixtures as FX

SF = "/root/testdata/sf0.01"


# --------------------------------------------------------------------------- vectors

def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    out = [r[0] for r in df.select(V.l2_normalise(F.col("v"))).collect()]
    assert out[0] == [0.0, 0.0]
    assert out[1] == pytest.approx([0.6, 0.8])


def test_self_similarity_and_self_retrieval(spark):
    pool = FX.pool_vectors(spark, SF)
    targets = pool.filter(F.col("pool_id") < 70).select(F.col("pool_id").alias("target_id"), "vec")
    top = SIM.topk_per_target(SIM.cosine_scores(pool, targets, mode="topk", k=1), 1).collect()
    assert all(r["pool_id"] == r["target_id"] and r["score"] == pytest.approx(1.0) for r in top)


def test_tiles_hold_the_scores_of_the_definition(spark):
    pool, targets = FX.pool_vectors(spark, SF), FX.target_vectors(spark, SF)
    unit = lambda df, key: {r[key]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in df.collect()}          # noqa: E731
    p, t = unit(pool, "pool_id"), unit(targets, "target_id")
    for limit in (SIM.DEFAULT_MAX_BROADCAST_BYTES, 64 * 8 * 7):                 # one broadcast block, blocks of 7 targets
        found = TL.score_tiles(pool, targets, 5, max_broadcast_bytes=limit)
        got = {(r["target_id"], r["pool_id"]): r["score"] for r in found.unnest().collect()}
        assert got == pytest.approx({(i, j): float(t[i] @ p[j]) for i in t for j in p}, abs=1e-12)
        assert found.tiles.count() == len(p) * found.blocks.count()


def test_target_blocks_cover_all_targets(spark):
    pool = FX.pool_vectors(spark, SF)
    targets = FX.target_vectors(spark, SF)
    small = SIM.cosine_scores(pool, targets, max_broadcast_bytes=64 * 8 * 7)   # blocks of 7 targets
    full = SIM.cosine_scores(pool, targets)
    assert small.count() == full.count()
    assert small.exceptAll(full).count() == 0


def test_empty_target_set(spark):
    pool = FX.pool_vectors(spark, SF)
    none = FX.target_vectors(spark, SF).filter(F.lit(False))
    assert SIM.cosine_scores(pool, none).count() == 0


def test_oversized_target_set_is_refused(spark):
    targets = FX.target_vectors(spark, SF)
    with pytest.raises(SIM.TooLargeToBroadcast):
        SIM.collect_matrix(targets, max_bytes=64, max_driver_bytes=64)


def test_projection_signs_match_sql_rule(spark):
    m = PR.sign_matrix(42, 1, 6, 3)
    df = spark.range(6 * 3).select((F.col("id") / 3).cast("int").alias("i"), (F.col("id") % 3).cast("int").alias("j"))
    rows = df.select("i", "j", PR.sign_column(42, F.lit(1), F.col("i"), F.col("j")).alias("s")).collect()
    assert all(m[r["i"], r["j"]] == r["s"] for r in rows)


def test_projection_preserves_inner_products_in_expectation():
    d, m = 64, 4000
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=d), rng.normal(size=d)
    R = np.sign(rng.normal(size=(d, m)))
    assert (x @ R) @ (y @ R) / m == pytest.approx(x @ y, abs=0.35 * np.linalg.norm(x) * np.linalg.norm(y))


def test_single_layer_redcat_is_unchanged_and_bad_layer_count_raises(spark):
    states = FX.token_states(spark, SF)
    one = P.embed(states, "lastlayer", n_layer=1, sec_pooling="redcat").orderBy("sample_id").first()
    ref = P.pool_weighted_mean(P.layer_pick(states, -1)).orderBy("sample_id").first()
    assert one["vec"] == pytest.approx(ref["vec"])
    with pytest.raises(ValueError):
        P.embed(states, "multilayer", n_layer=3, sec_pooling="sum")   # 3 does not divide 4 layers
    with pytest.raises(ValueError):
        P.embed(states, "lastlayer", n_layer=2, sec_pooling="sum")


def test_whitened_fit_rows_have_identity_covariance(spark):
    pool = FX.pool_vectors(spark, SF)
    model = W.whiten_fit(pool, reddim=16)
    X = np.array([r["vec"] for r in W.whiten_apply(pool.select("pool_id", "vec"), model).collect()])
    assert np.cov(X, rowvar=False) == pytest.approx(np.eye(16), abs=1e-8)
    assert X.mean(axis=0) == pytest.approx(np.zeros(16), abs=1e-10)


def test_whitening_rejects_too_small_samples(spark):
    pool = FX.pool_vectors(spark, SF)
    with pytest.raises(ValueError):
        W.whiten_fit(pool, reddim=4, fit=1)     # single-row sample
    with pytest.raises(ValueError):
        W.whiten_fit(pool, reddim=4, fit=0)


# --------------------------------------------------------------------------- text

ANSWERS = [("1,234.50", "1234.50"), ("-5", "5"), ("7.", "7"), ("1,2,3", "3"), ("no number", "no number"),
           ("x -0.5 y", "-0.5"), ("0", "0")]


@pytest.mark.parametrize("text,expected", ANSWERS)
def test_last_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.last_number(T.strip_digit_commas("t"))).first()[0] == expected


def test_gold_zero_is_valid(spark):
    df = spark.createDataFrame([("so\n#### 0",), ("#### 1,000",)], "a string")
    assert [r[0] for r in df.select(T.gsm_gold("a")).collect()] == ["0", "1000"]


def test_norm_answer_edges(spark):
    df = spark.createDataFrame([("The  Cat, sat!",), ("a an the",), ("",), ("Élan vital",)], "t string")
    assert [r[0] for r in df.select(T.norm_answer("t")).collect()] == ["cat sat", "", "", "élan vital"]


def test_cut_at_stop(spark):
    df = spark.createDataFrame([("x = 1\nprint(x)\nclass A",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(T.cut_at_stop("t", ["\nclass", "\nprint"])).collect()] == ["x = 1", "nothing"]


# --------------------------------------------------------------------------- chat

MSG = "messages array<struct<role string, content string>>"


def test_render_edges(spark):
    rows = [([("system", " sys ")],), ([("user", "  hi  ")],), ([("user", "q"), ("assistant", " a ")],)]
    df = spark.createDataFrame(rows, MSG)
    out = [r[0] for r in df.select(C.render_default("messages")).collect()]
    assert out == ["<|system|>\nsys", "<|user|>\nhi", "<|user|>\nq\n<|assistant|>\na</s>"]
    chat = [r[0] for r in df.select(C.chat_prompt("messages")).collect()]
    assert chat[1] == "<|user|>\n  hi  \n<|assistant|>\n"


def test_unknown_role_raises(spark):
    df = spark.createDataFrame([([("robot", "x")],)], MSG)
    with pytest.raises(Exception, match="Invalid role"):
        df.select(C.render_default("messages")).collect()


def test_empty_messages_raise(spark):
    df = spark.createDataFrame([([],)], MSG)
    with pytest.raises(Exception, match="messages field is empty"):
        df.select(C.render_default("messages")).collect()


def test_mask_keeps_only_assistant_tokens(spark):
    df = spark.createDataFrame([([("user", "a b"), ("assistant", "c d"), ("user", "e")],)], MSG)
    labels = df.select(C.mask_non_assistant("messages", 100)).first()[0]
    assert labels == [None, None, None, None, "c", "d</s>", None, None]


# --------------------------------------------------------------------------- scoring

def test_squad_edges(spark):
    refs = spark.createDataFrame([("q1", ["The cat"]), ("q2", ["dog", "a dog"]), ("q3", ["x"]), ("q4", ["élan"])],
                                 "id string, answers array<string>")
    preds = spark.createDataFrame([("q1", "cat", 1), ("q2", "wrong", 1), ("q2", "the dog", 2), ("q4", "", 1)],
                                  "id string, prediction_text string, seq int")
    per = {r["id"]: r for r in SC.squad_scores(refs, preds, order_col="seq").collect()}
    assert per["q1"]["em"] == 1.0 and per["q1"]["f1"] == 1.0
    assert per["q2"]["em"] == 1.0                 # duplicated id: the last prediction wins
    assert per["q3"]["f1"] == 0.0                 # missing prediction counts as 0
    assert per["q4"]["f1"] == 0.0                 # empty prediction
    s = SC.squad_summary(SC.squad_scores(refs, preds, order_col="seq")).first()
    assert s["exact_match"] == pytest.approx(50.0)


def test_token_prf_array_form(spark):
    df = spark.createDataFrame([("a b b c", "b b d")], "p string, g string")
    r = df.select(SC.token_prf("p", "g").alias("x")).first()["x"]
    assert (r["precision"], r["recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))


def _pass_ref(n, c, k):
    if n - c < k:
        return 1.0
    return 1.0 - float(np.prod(1.0 - k / np.arange(n - c + 1, n + 1)))


def test_pass_at_k_edges(spark):
    rows = [("t0", False)] * 5 + [("t1", True)] * 5 + [("t2", True), ("t2", False), ("t2", False)]
    df = spark.createDataFrame(rows, "task_id string, passed boolean")
    got = {r["k"]: r["pass_at_k"] for r in SC.pass_at_k(df, ks=(1, 2, 4)).collect()}
    assert 4 not in got                          # t2 has n = 3 < 4
    for k in (1, 2):
        ref = np.mean([_pass_ref(5, 0, k), _pass_ref(5, 5, k), _pass_ref(3, 1, k)])
        assert got[k] == pytest.approx(ref)


def test_argmax_choice_first_best(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "s array<double>")
    r = df.select(SC.argmax_choice("s").alias("c")).first()["c"]
    assert r["choice"] == "B"
    assert r["prob"] == pytest.approx(math.exp(3) / (math.exp(1) + 2 * math.exp(3) + 1))


@pytest.mark.parametrize("normalised", [False, True])
def test_fused_means_match_long_form(spark, normalised):
    from sieve.operators import selection as S
    pool = FX.pool_vectors(spark, SF)
    targets = FX.target_vectors(spark, SF)
    long = SIM.cosine_scores(pool, targets)
    ref = S.mean_scores(S.minmax_normalised(long) if normalised else long)
    for limit in (SIM.DEFAULT_MAX_BROADCAST_BYTES, 64 * 8 * 9):     # one block, several blocks
        fused = SIM.mean_scores_fused(pool, targets, normalised=normalised, max_broadcast_bytes=limit)
        a = {r["pool_id"]: r["score"] for r in fused.collect()}
        b = {r["pool_id"]: r["score"] for r in ref.collect()}
        assert a.keys() == b.keys()
        assert max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_task_registry_scores_generations(spark):
    from pyspark.sql import functions as F

    from sieve.operators import scoring as SC
    from sieve.plans import tasks as TK
    sf = "/root/testdata/sf0.001"
    p = TK.prompts(spark, "mbpp", sf)
    assert p.columns == ["task_id", "prompt", "reference"] and p.count() > 0
    ids = [r.task_id for r in p.select("task_id").orderBy("task_id").limit(2).collect()]
    gens = spark.createDataFrame(
        [(ids[0], 0, "  return 1\nassert f() == 1", True), (ids[0], 1, "  return 2\nprint(1)", False),
         (ids[1], 0, "  return 3", True), (ids[1], 1, "  pass", True)],
        "task_id long, completion_id int, generation string, passed boolean")
    got = TK.run_task(spark, "mbpp", sf, gens).collect()
    assert [(r.k, round(r.pass_at_k, 6)) for r in got] == [(1, 0.75)]
    exp = SC.pass_at_k(gens, ks=(1, 10, 100)).collect()
    assert [(r.k, r.pass_at_k) for r in got] == [(r.k, r.pass_at_k) for r in exp]
    cleaned = TK.TASKS["mbpp"].postprocess(F.col("generation"), F.lit(""))
    assert [r[0] for r in gens.orderBy("task_id", "completion_id").select(cleaned).collect()][:2] == \
        ["  return 1", "  return 2"]


def test_running_topk_survives_restart_and_new_files(spark, tmp_path):
    """Stream part of the pool, restart from the same checkpoint with more
    files, and compare the published top-k with a batch top-k over all rows."""
    from pyspark.sql import functions as F

    from sieve.operators import similarity as SIM
    from sieve.plans import fixtures as FX
    from sieve.streaming import scoring as ST
    sf, k = "/root/testdata/sf0.001", 3
    pool = FX.pool_vectors(spark, sf).select("src", "pool_id", "vec")
    tm = SIM.target_matrix(FX.target_vectors(spark, sf))
    src, out, chk = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk")
    pool.filter(F.col("pool_id") % 2 == 0).write.parquet(f"{src}/part=0")
    ST.start_running_topk(spark, src, tm, out, chk, k, trigger_once=True).awaitTermination()
    first = ST.current_topk(spark, out).count()
    ST.start_running_topk(spark, src, tm, out, chk, k, trigger_once=True).awaitTermination()   # nothing new
    assert ST.current_topk(spark, out).count() == first
    pool.filter(F.col("pool_id") % 2 == 1).write.parquet(f"{src}/part=1")
    ST.start_running_topk(spark, src, tm, out, chk, k, trigger_once=True).awaitTermination()
    got = sorted((r.target_id, r.rank, r.pool_id) for r in ST.current_topk(spark, out).collect())
    exp_df = SIM.topk_per_target(SIM.cosine_scores(pool, tm, mode="topk", k=k), k)
    exp = sorted((r.target_id, r.rank, r.pool_id) for r in exp_df.collect())
    assert got == exp and max(r for _, r, _ in got) <= k
