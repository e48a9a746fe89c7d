"""Pooling, projection and whitening queries over derived token states."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import vectors as V
from sieve.operators import pooling as P
from sieve.operators import projection as PR
from sieve.operators import sampling as SA
from sieve.operators import similarity as SIM
from sieve.operators import whitening as W
from sieve.plans import fixtures as FX
from sieve.plans.catalog import r6, register

N_LAYERS = FX.N_LAYERS

# token states: sample vec_id // 8, position vec_id % 8 + 1, layer l = embedding rotated left by l
SQL_STATES = f"""
st AS (SELECT vec_id // {FX.POSITIONS} AS sample_id, l AS layer, vec_id % {FX.POSITIONS} + 1 AS pos,
              list_concat(embedding[l + 1:], embedding[1:l])::DOUBLE[] AS v
       FROM embeddings CROSS JOIN range(0, {N_LAYERS + 1}) AS r(l)),
u AS (SELECT sample_id, layer, pos, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM st),
wm AS (SELECT sample_id, layer, d, sum(pos * x) / sum(pos) AS x FROM u GROUP BY sample_id, layer, d)
"""


def _long(df, key="sample_id"):
    return P.explode_dims(df, key).select(key, F.col("d").cast("long").alias("d"), r6("x").alias("x"))


def states(spark, sf):
    return FX.token_states(spark, sf)


@register("pool_mean", f"WITH {SQL_STATES} SELECT sample_id, d, round(avg(x), 6) + 0.0 AS x FROM u "
                       f"WHERE layer = {N_LAYERS} GROUP BY sample_id, d")
def pool_mean(spark, sf):
    return _long(P.embed(states(spark, sf), "mean", n_layers=N_LAYERS))


@register("pool_weighted_mean", f"WITH {SQL_STATES} SELECT sample_id, d, round(x, 6) + 0.0 AS x FROM wm "
                                f"WHERE layer = {N_LAYERS}")
def pool_weighted_mean(spark, sf):
    return _long(P.embed(states(spark, sf), "weighted_mean", n_layers=N_LAYERS))


@register("pool_last_token", f"WITH {SQL_STATES} SELECT sample_id, d, round(arg_max(x, pos), 6) + 0.0 AS x "
                             f"FROM u WHERE layer = {N_LAYERS} GROUP BY sample_id, d")
def pool_last_token(spark, sf):
    return _long(P.embed(states(spark, sf), "none", n_layers=N_LAYERS))


@register("layer_pick", f"WITH {SQL_STATES} SELECT sample_id, pos, d, round(x, 6) + 0.0 AS x FROM u "
                        f"WHERE layer = {N_LAYERS - 1}")
def layer_pick(spark, sf):
    one = P.layer_pick(states(spark, sf), -2)
    return one.select("sample_id", F.col("pos").cast("long").alias("pos"),
                      F.posexplode("vec").alias("d", "x")).select(
        "sample_id", "pos", F.col("d").cast("long").alias("d"), r6("x").alias("x"))


@register("layers_strided", f"WITH {SQL_STATES} SELECT sample_id, pos, layer, layer // 2 - 1 AS li FROM st "
                            f"WHERE layer IN (2, 4)")
def layers_strided(spark, sf):
    s = P.layers_strided(states(spark, sf), 2)
    return s.select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("layer").cast("long").alias("layer"),
                    F.col("li").cast("long").alias("li"))


@register("layers_tail", f"WITH {SQL_STATES} SELECT sample_id, pos, layer, layer - 2 AS li FROM st "
                         f"WHERE layer IN (2, 3, 4)")
def layers_tail(spark, sf):
    s = P.layers_tail(states(spark, sf), 3)
    return s.select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("layer").cast("long").alias("layer"),
                    F.col("li").cast("long").alias("li"))


@register("combine_sum", f"WITH {SQL_STATES} SELECT sample_id, d, round(sum(x), 6) + 0.0 AS x FROM wm "
                         f"WHERE layer IN (2, 4) GROUP BY sample_id, d")
def combine_sum(spark, sf):
    return _long(P.embed(states(spark, sf), "multilayer", n_layer=2, sec_pooling="sum"))


@register("combine_avg", f"WITH {SQL_STATES} SELECT sample_id, d, round(avg(x), 6) + 0.0 AS x FROM wm "
                         f"WHERE layer IN (3, 4) GROUP BY sample_id, d")
def combine_avg(spark, sf):
    return _long(P.embed(states(spark, sf), "lastlayer", n_layer=2, sec_pooling="avg"))


@register("combine_segment_cat", f"WITH {SQL_STATES} SELECT sample_id, d, round(x, 6) + 0.0 AS x FROM wm "
                                 f"WHERE (layer = 2 AND d < 32) OR (layer = 4 AND d >= 32)")
def combine_segment_cat(spark, sf):
    return _long(P.embed(states(spark, sf), "multilayer", n_layer=2, sec_pooling="cat"))


def _signs_sql(n: int, d: int = 64) -> str:
    m = d // n
    return f"""
sg AS (SELECT li, i, j, CASE WHEN substr(md5(concat_ws('|', '42', li, i, j)), 1, 1) < '8' THEN 1 ELSE -1 END AS s
       FROM range(0, {n}) a(li) CROSS JOIN range(0, {d}) b(i) CROSS JOIN range(0, {m}) c(j))"""


def _redcat_sql(layers: tuple[int, ...], li_expr: str, n: int = 2, m: int = 32) -> str:
    return f"""WITH {SQL_STATES}, {_signs_sql(n)},
pl AS (SELECT sample_id, {li_expr} AS li, d, x FROM wm WHERE layer IN {layers}),
pj AS (SELECT pl.sample_id, pl.li, sg.j, sum(pl.x * sg.s) AS x FROM pl JOIN sg ON sg.li = pl.li AND sg.i = pl.d
       GROUP BY pl.sample_id, pl.li, sg.j)"""


@register("rademacher_project", _redcat_sql((3, 4), "layer - 3") +
          " SELECT sample_id, li, j, round(x, 6) + 0.0 AS x FROM pj")
def rademacher_project(spark, sf):
    per_layer = P.pooled_layers(states(spark, sf), "lastlayer", 2)
    pj = PR.project(per_layer, 2, 64)
    return pj.select("sample_id", F.col("li").cast("long").alias("li"), F.posexplode("proj").alias("j", "x")).select(
        "sample_id", "li", F.col("j").cast("long").alias("j"), r6("x").alias("x"))


@register("combine_redcat", _redcat_sql((2, 4), "layer // 2 - 1") +
          " SELECT sample_id, li * 32 + j AS d, round(x, 6) + 0.0 AS x FROM pj")
def combine_redcat(spark, sf):
    return _long(P.embed(states(spark, sf), "multilayer", n_layer=2, sec_pooling="redcat"))


@register("combine_redcat_lastlayer", _redcat_sql((3, 4), "layer - 3") +
          " SELECT sample_id, li * 32 + j AS d, round(x, 6) + 0.0 AS x FROM pj")
def combine_redcat_lastlayer(spark, sf):
    return _long(P.embed(states(spark, sf), "lastlayer", n_layer=2, sec_pooling="redcat"))


SQL_POOL_LONG = """
pv AS (SELECT vec_id AS pool_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)),
pu AS (SELECT pool_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM pv)"""


@register("l2_normalise", f"""WITH {SQL_STATES},
m AS (SELECT sample_id, d, avg(x) AS x FROM u WHERE layer = {N_LAYERS} GROUP BY sample_id, d),
nrm AS (SELECT sample_id, greatest(sqrt(sum(x * x)), 1e-12) AS nx FROM m GROUP BY sample_id)
SELECT sample_id, d, round(x / nx, 6) + 0.0 AS x FROM m JOIN nrm USING (sample_id)""")
def l2_normalise(spark, sf):
    pooled = P.embed(states(spark, sf), "mean", n_layers=N_LAYERS)
    return _long(pooled.select("sample_id", V.l2_normalise(F.col("vec")).alias("vec")))


@register("whiten_fit", f"""WITH {SQL_POOL_LONG}
SELECT a.d AS i, b.d AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov
FROM pu a JOIN pu b USING (pool_id) GROUP BY a.d, b.d""")
def whiten_fit(spark, sf):
    """Covariance of the fit sample (all pool rows here) as computed by the fit."""
    return _covariance_cells(W.covariance_blocks(FX.pool_vectors(spark, sf)))


def _covariance_cells(blocks):
    cells = blocks.select("first", F.size("mean").alias("d"), F.posexplode("cov").alias("p", "cov"))
    return cells.select((F.col("first") + F.floor(F.col("p") / F.col("d"))).cast("long").alias("i"), (F.col("p") % F.col("d")).cast("long").alias("j"), r6("cov").alias("cov"))


REDDIM = 16


@register("whiten_apply", f"SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS cov FROM range({REDDIM}) a(i), range({REDDIM}) b(j), (SELECT count(*) AS n FROM embeddings) WHERE n > {REDDIM}")
def whiten_apply(spark, sf):
    """The covariance of the whitened pool, which whitening makes the identity."""
    pool = FX.pool_vectors(spark, sf)
    return _covariance_cells(W.covariance_blocks(W.whiten_apply(pool.select("pool_id", "vec"), W.whiten_fit(pool, reddim=REDDIM))))


@register("whiten_apply_topk")
def whiten_apply_topk(spark, sf):
    """Whitened cosine top-5 per target (no SQL form: needs an eigendecomposition)."""
    pool = FX.pool_vectors(spark, sf)
    model = W.whiten_fit(pool, reddim=16)
    wp = W.whiten_apply(pool.select("src", "pool_id", "vec"), model)
    wt = W.whiten_apply(FX.target_vectors(spark, sf).select("target_id", "vec"), model)
    cand = SIM.cosine_scores(wp, wt, mode="topk", k=5)
    top = SIM.topk_per_target(cand, 5)
    return top.select("target_id", F.col("rank").cast("long").alias("rank"), "pool_id", r6("score").alias("score"))


@register("sample_fit", """
SELECT vec_id AS pool_id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)
ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id LIMIT 100""")
def sample_fit(spark, sf):
    return SA.sample_fit(FX.pool_vectors(spark, sf), 100, seed=42, id_col="pool_id").select("pool_id")
