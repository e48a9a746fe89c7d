"""Similarity and selection queries over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.operators import selection as S
from sieve.operators import similarity as SIM
from sieve.operators import tiles as TL
from sieve.plans import fixtures as FX
from sieve.plans.catalog import SQL_VECTORS, r6, register

K_SELECT = 50
K_TOPK = 10
TILE_WIDTH = 16             # targets of a tile; the given tables have 40 targets


def scores(spark, sf):
    return SIM.cosine_scores(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf))


def tiles(spark, sf):
    return TL.score_tiles(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), TILE_WIDTH)


def tiles_sql(scores: str = "scores", by: str = "pool_id", of: str = "target_id") -> str:
    """Score lists of blocks of targets, in millionths."""
    return f"""SELECT {by}, (place - 1) // {TILE_WIDTH} AS block, string_agg((round(score * 1e6))::BIGINT::VARCHAR, ',' ORDER BY {of}) AS scores
FROM (SELECT *, dense_rank() OVER (ORDER BY {of}) AS place FROM {scores}) GROUP BY ALL"""


def _tiles_out(t):
    return t.select("pool_id", F.col("block").cast("long").alias("block"), TL.listed("scores").alias("scores"))


@register("cosine_all_pairs", f"WITH {SQL_VECTORS} {tiles_sql()}")
def cosine_all_pairs(spark, sf):
    """The whole score matrix, a row per pool row and block of targets."""
    return _tiles_out(tiles(spark, sf).tiles)


@register("join_all_pairs", f"""
WITH {SQL_VECTORS}, t AS ({tiles_sql()}),
ids AS (SELECT block, count(*) AS n_targets, min(target_id) AS first_target, max(target_id) AS last_target
        FROM (SELECT target_id, (row_number() OVER (ORDER BY target_id) - 1) // {TILE_WIDTH} AS block FROM tn) GROUP BY block)
SELECT pool_id, label, n_targets, first_target, last_target, scores FROM t JOIN ids USING (block) JOIN pn USING (pool_id)
""")
def join_all_pairs(spark, sf):
    """Every pool row joined to every block of targets: the row's own columns, the
    block's targets and the scores between them."""
    found, pool = tiles(spark, sf), FX.pool_vectors(spark, sf).select("src", "pool_id", "label")
    t = found.tiles.join(found.blocks, "block").join(pool, ["src", "pool_id"])
    return t.select("pool_id", "label", F.size("target_ids").cast("long").alias("n_targets"), F.array_min("target_ids").alias("first_target"),
                    F.array_max("target_ids").alias("last_target"), TL.listed("scores").alias("scores"))


@register("topk_per_target", f"""
WITH {SQL_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, pool_id) AS rank FROM scores)
SELECT target_id, rank, pool_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {K_TOPK}
""")
def topk_per_target(spark, sf):
    cand = SIM.cosine_scores(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), mode="topk", k=K_TOPK)
    top = SIM.topk_per_target(cand, K_TOPK)
    return top.select("target_id", F.col("rank").cast("long").alias("rank"), "pool_id", r6("score").alias("score"))


@register("ip_topk_smallest", """
WITH tv AS (SELECT vec_id AS target_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
pv AS (SELECT vec_id AS pool_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)),
s AS (SELECT target_id, pool_id, list_dot_product(pv.v, tv.v) AS score FROM tv CROSS JOIN pv),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score, pool_id) AS rank FROM s)
SELECT target_id, rank, pool_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 5
""")
def ip_topk_smallest(spark, sf):
    cand = SIM.cosine_scores(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), mode="topk", k=5,
                             largest=False, normalise=False)
    top = SIM.ip_topk_smallest(cand, 5)
    return top.select("target_id", F.col("rank").cast("long").alias("rank"), "pool_id", r6("score").alias("score"))


def _rr_sql(order: str, k: int, allow: str = "", cut: bool = True, extra_filter: str = "") -> str:
    cut_sql = f"WHERE rank <= {k}" if cut else ""
    return f"""
WITH {SQL_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score {order}, pool_id) AS rank FROM scores),
c AS (SELECT * FROM r {cut_sql}),
a AS (SELECT * FROM c WHERE true {allow} {extra_filter}),
f AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY rank, target_id) AS first FROM a),
o AS (SELECT *, row_number() OVER (ORDER BY rank, target_id) AS sel_rank FROM f WHERE first = 1)
"""


RR_COLS = "sel_rank, pool_id, rank AS round, target_id, round(score, 6) + 0.0 AS score"


def _rr_out(df):
    return df.select(F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id",
                     F.col("round").cast("long").alias("round"), "target_id", r6("score").alias("score"))


@register("select_roundrobin_max", _rr_sql("DESC", K_SELECT) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K_SELECT}")
def select_roundrobin_max(spark, sf):
    return _rr_out(S.select_round_robin_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), K_SELECT))


@register("select_roundrobin_min", _rr_sql("ASC", K_SELECT, cut=False) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K_SELECT}")
def select_roundrobin_min(spark, sf):
    return _rr_out(S.select_round_robin_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), K_SELECT, largest=False))


ALLOW_SQL = "AND pool_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@register("select_allow_list", _rr_sql("DESC", K_SELECT, allow=ALLOW_SQL) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K_SELECT}")
def select_allow_list(spark, sf):
    allow = FX.pool_allow_list(spark, sf)
    return _rr_out(S.select_round_robin_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), K_SELECT, largest=True, allow=allow))


@register("select_allow_list_min", _rr_sql("ASC", K_SELECT, allow=ALLOW_SQL, cut=False) + f"SELECT {RR_COLS} FROM o WHERE sel_rank <= {K_SELECT}")
def select_allow_list_min(spark, sf):
    allow = FX.pool_allow_list(spark, sf)
    return _rr_out(S.select_round_robin_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), K_SELECT, largest=False, allow=allow))


@register("join_selected_back", _rr_sql("DESC", K_SELECT) + f"""
SELECT o.sel_rank, o.pool_id, e.label, round(o.score, 6) + 0.0 AS influence_score,
       list_sum(list_transform(e.embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT))::BIGINT AS dims_sum, len(e.embedding) AS dims
FROM o JOIN embeddings e ON e.vec_id = o.pool_id WHERE o.sel_rank <= {K_SELECT}
""")
def join_selected_back(spark, sf):
    """Selected rows joined back to the full pool rows (the selected-rows sink)."""
    pool = FX.pool_vectors(spark, sf)
    sel = S.select_round_robin_from_pool(pool, FX.target_vectors(spark, sf), K_SELECT)
    back = sel.join(pool, ["src", "pool_id"])
    return back.select(F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id", "label",
                       r6("score").alias("influence_score"),
                       F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 1e6).cast("long")).alias("dims_sum"),
                       F.size("vec").cast("long").alias("dims"))


@register("dedup_first", _rr_sql("DESC", K_SELECT) + """
SELECT pool_id, rank AS round, target_id FROM f WHERE first = 1
""")
def dedup_first(spark, sf):
    cand = SIM.cosine_scores(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), mode="topk", k=K_SELECT)
    ranked = SIM.topk_per_target(cand, K_SELECT)
    f = S.first_picks(ranked)
    return f.select("pool_id", F.col("round").cast("long").alias("round"), "target_id")


MEAN_SQL = f"WITH {SQL_VECTORS}, m AS (SELECT 0 AS src, pool_id, avg(score) AS score FROM scores GROUP BY pool_id)"
NORM_SQL = f"""WITH {SQL_VECTORS},
b AS (SELECT target_id, min(score) AS lo, max(score) AS hi FROM scores GROUP BY target_id),
n AS (SELECT s.target_id, s.pool_id, coalesce((s.score - b.lo) / nullif(b.hi - b.lo, 0), 0.0) AS score
      FROM scores s JOIN b USING (target_id)),
m AS (SELECT 0 AS src, pool_id, avg(score) AS score FROM n GROUP BY pool_id)"""


def _mean_sql(base: str, largest: bool, k: int) -> str:
    if largest:
        pick = f"(SELECT * FROM m ORDER BY score DESC, src DESC, pool_id DESC LIMIT {k})"
    else:
        pick = f"(SELECT * FROM m ORDER BY score, src, pool_id LIMIT {k})"
    return base + f"""
SELECT row_number() OVER (ORDER BY score, src, pool_id) AS sel_rank, pool_id, round(score, 6) + 0.0 AS score
FROM {pick} t"""


def _mean_out(df):
    return df.select(F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id", r6("score").alias("score"))


@register("select_mean_min", _mean_sql(MEAN_SQL, False, K_SELECT))
def select_mean_min(spark, sf):
    means = SIM.mean_scores_fused(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), normalised=False)
    return _mean_out(S.select_from_means(means, K_SELECT, largest=False))


@register("select_mean_max", _mean_sql(MEAN_SQL, True, K_SELECT))
def select_mean_max(spark, sf):
    means = SIM.mean_scores_fused(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), normalised=False)
    return _mean_out(S.select_from_means(means, K_SELECT, largest=True))


@register("select_norm_mean_min", _mean_sql(NORM_SQL, False, K_SELECT))
def select_norm_mean_min(spark, sf):
    means = SIM.mean_scores_fused(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), normalised=True)
    return _mean_out(S.select_from_means(means, K_SELECT, largest=False))


@register("select_norm_mean_max", _mean_sql(NORM_SQL, True, K_SELECT))
def select_norm_mean_max(spark, sf):
    means = SIM.mean_scores_fused(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), normalised=True)
    return _mean_out(S.select_from_means(means, K_SELECT, largest=True))


@register("agg_mean_score", MEAN_SQL + " SELECT pool_id, round(score, 6) + 0.0 AS mean_score FROM m")
def agg_mean_score(spark, sf):
    m = SIM.cosine_scores(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), mode="mean")
    return m.select("pool_id", r6("score").alias("mean_score"))


@register("agg_minmax_norm", f"{NORM_SQL} {tiles_sql('n')}")
def agg_minmax_norm(spark, sf):
    """Scores scaled to [0, 1] per target, as tiles (the selection queries use the
    fused scan that keeps only means)."""
    return _tiles_out(tiles(spark, sf).scaled().tiles)


MULTI_SQL = f"""
WITH {SQL_VECTORS},
ms AS (SELECT s.target_id, CASE WHEN p.label >= 5 THEN 1 ELSE 0 END AS src, s.pool_id, s.score
       FROM scores s JOIN pv p USING (pool_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, src, pool_id) AS rank FROM ms),
c AS (SELECT * FROM r WHERE rank <= {K_SELECT}),
f AS (SELECT *, row_number() OVER (PARTITION BY src, pool_id ORDER BY rank, target_id) AS first FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY rank, target_id) AS sel_rank FROM f WHERE first = 1)
SELECT sel_rank, src, pool_id, rank AS round, target_id, round(score, 6) + 0.0 AS score FROM o WHERE sel_rank <= {K_SELECT}
"""


@register("select_multi_pool", MULTI_SQL)
def select_multi_pool(spark, sf):
    """Two pools (labels 0-4 and 5-9), told apart by ``src`` and merged by target."""
    pool = FX.pool_vectors(spark, sf)
    targets = FX.target_vectors(spark, sf)
    parts = [pool.filter(cond).withColumn("src", F.lit(src)) for src, cond in ((0, F.col("label") < 5), (1, F.col("label") >= 5))]
    sel = S.select_round_robin_from_pool(parts[0].unionByName(parts[1]), targets, K_SELECT)
    return sel.select(F.col("sel_rank").cast("long").alias("sel_rank"), "src", "pool_id",
                      F.col("round").cast("long").alias("round"), "target_id", r6("score").alias("score"))


WEIGHTS_SQL = """
w AS (SELECT CAST(label AS VARCHAR) AS domain, count(*) AS weight FROM embeddings
      WHERE vec_id NOT IN (SELECT item_id FROM benchmark) GROUP BY label)"""


def domain_weights(spark, sf):
    """Domain weights derived from the pool: share of pool rows per label."""
    return FX.pool_vectors(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@register("src_domain_weights", f"""
WITH {WEIGHTS_SQL}
SELECT domain, round(weight / sum(weight) OVER (), 6) + 0.0 AS weight,
       round(weight / sum(weight) OVER () * {K_SELECT}, 6) + 0.0 AS quota FROM w
""")
def src_domain_weights(spark, sf):
    q = S.domain_quotas(domain_weights(spark, sf), K_SELECT)
    return q.select("domain", r6("weight").alias("weight"), r6("quota").alias("quota"))


@register("agg_domain_count", _rr_sql("DESC", K_SELECT) + f""",
{WEIGHTS_SQL},
sel AS (SELECT CAST(p.label AS VARCHAR) AS domain FROM o JOIN pv p USING (pool_id) WHERE o.sel_rank <= {K_SELECT})
SELECT w.domain, count(sel.domain) AS n_selected,
       round(w.weight / sum(w.weight) OVER () * {K_SELECT}, 6) + 0.0 AS quota
FROM w LEFT JOIN sel USING (domain) GROUP BY w.domain, w.weight
""")
def agg_domain_count(spark, sf):
    """Selected rows per domain next to the domain's quota."""
    pool = FX.pool_vectors(spark, sf)
    sel = (S.select_round_robin_from_pool(pool, FX.target_vectors(spark, sf), K_SELECT)
           .join(pool.select("src", "pool_id", "domain"), ["src", "pool_id"]))
    counts = sel.groupBy("domain").agg(F.count(F.lit(1)).alias("n_selected"))
    q = S.domain_quotas(domain_weights(spark, sf), K_SELECT)
    return (q.join(counts, "domain", "left")
            .select("domain", F.coalesce("n_selected", F.lit(0)).cast("long").alias("n_selected"),
                    r6("quota").alias("quota")))


# One row of state a turn: whose turn it is, how far each list was read, how often each domain was picked, what was picked.
QUOTA_SQL = f"""
WITH RECURSIVE {SQL_VECTORS}, {WEIGHTS_SQL},
q AS (SELECT map(list(domain ORDER BY domain), list(quota ORDER BY domain)) AS quota FROM (SELECT domain, weight / sum(weight) OVER () * {K_SELECT} AS quota FROM w)),
lists AS (SELECT list(l ORDER BY target_id) AS ls, count(*)::INT AS n FROM (
  SELECT target_id, list({{'p': pool_id, 'd': label::VARCHAR, 's': score}} ORDER BY score, pool_id) AS l FROM scores JOIN (SELECT pool_id, label FROM pn) USING (pool_id) GROUP BY target_id)),
walk AS (
  SELECT 0 AS step, 0 AS idle, list_transform(range(n), lambda x: 0) AS pos, MAP(list_transform(map_keys(quota), lambda d: d), list_transform(map_keys(quota), lambda d: 0)) AS used,
    []::STRUCT(p BIGINT, d VARCHAR, s DOUBLE)[] AS picked FROM lists, q
  UNION ALL
  SELECT step + 1, CASE WHEN i IS NULL THEN idle + 1 ELSE 0 END,
    list_transform(pos, lambda v, k: CASE WHEN k = t AND i IS NOT NULL THEN i ELSE v END),
    CASE WHEN fresh THEN MAP(map_keys(used), list_transform(map_entries(used), lambda e: e.value + CASE WHEN e.key = x.d THEN 1 ELSE 0 END)) ELSE used END,
    CASE WHEN fresh THEN list_append(picked, x) ELSE picked END
  FROM (SELECT *, i IS NOT NULL AND NOT list_contains(list_transform(picked, lambda y: y.p), x.p) AS fresh FROM (SELECT *, ls[t][i] AS x FROM (
    SELECT step, idle, pos, used, picked, ls, n, step % n + 1 AS t,
      list_filter(range(pos[step % n + 1] + 1, len(ls[step % n + 1]) + 1), lambda j: used[ls[step % n + 1][j].d] < quota[ls[step % n + 1][j].d])[1] AS i
    FROM walk, lists, q WHERE len(picked) < {K_SELECT} AND idle < n))))
SELECT generate_subscripts(picked, 1)::BIGINT AS sel_rank, unnest(picked).p AS pool_id, unnest(picked).d AS domain, round(unnest(picked).s, 6) + 0.0 AS score
FROM (SELECT picked FROM walk ORDER BY step DESC LIMIT 1)"""


@register("select_roundrobin_quota", QUOTA_SQL)
def select_roundrobin_quota(spark, sf):
    """Ascending round robin with domain quotas, from one scan of the pool."""
    sel = S.select_round_robin_quota_from_pool(FX.pool_vectors(spark, sf), FX.target_vectors(spark, sf), domain_weights(spark, sf), K_SELECT)
    return sel.select(F.col("sel_rank").cast("long").alias("sel_rank"), "pool_id", "domain", r6("score").alias("score"))


@register("leak_check", f"""
WITH {SQL_VECTORS},
allp AS (SELECT pool_id, 0 AS origin, v FROM pn UNION ALL SELECT target_id AS pool_id, 1 AS origin, v FROM tn),
s AS (SELECT tn.target_id, allp.pool_id, allp.origin, list_dot_product(allp.v, tn.v) AS score FROM tn CROSS JOIN allp),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, origin DESC, pool_id) AS rank FROM s)
SELECT target_id, pool_id AS best_id, origin AS best_origin, round(score, 6) + 0.0 AS score FROM r WHERE rank = 1
""")
def leak_check(spark, sf):
    """Sanity mode: the targets are appended to the pool (origin 1); every
    target should retrieve itself first."""
    # src 0 holds the targets, so the scan's own tie-break (src, pool_id) puts a target's own copy first
    pool = FX.pool_vectors(spark, sf).select(F.lit(1).alias("src"), "pool_id", "vec")
    targets = FX.target_vectors(spark, sf)
    both = pool.unionByName(targets.select(F.lit(0).alias("src"), F.col("target_id").alias("pool_id"), "vec"))
    best = SIM.topk_per_target(SIM.cosine_scores(both, targets, mode="topk", k=1), 1)
    return best.select("target_id", F.col("pool_id").alias("best_id"), (1 - F.col("src")).alias("best_origin"),
                       r6("score").alias("score"))
