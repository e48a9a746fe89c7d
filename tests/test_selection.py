"""Selection against the order of turns written down from its definition,
plus the edge rows listed in FIXTURES.md."""

import math
import random

import pytest

from sieve.operators import selection as S
from sieve.operators import similarity as SIM

SCHEMA = "target_id bigint, src int, pool_id bigint, score double"


# --------------------------------------------------------------------------- simulations

def by_steps(rows, k, largest, allow=None):
    """Round robin by definition: the element ranked r in target t's list is
    turn (r, t); an instance is picked at its first turn that counts, and the
    picks are the first k by turn."""
    ranked = {}
    for t in {r[0] for r in rows}:
        own = [(-s if largest else s, src, pid) for u, src, pid, s in rows if u == t and pid != -1]
        ranked[t] = sorted(own)[:k] if largest else sorted(own)
    turns = [((r, t), (src, pid), -s if largest else s) for t, own in ranked.items() for r, (s, src, pid) in enumerate(own)]
    turns = [x for x in turns if (allow is None or x[1] in allow) and (largest or not math.isinf(x[2]))]
    first = {}
    for turn, inst, score in sorted(turns):
        first.setdefault(inst, (turn, score))
    return [(inst, score) for inst, (_, score) in sorted(first.items(), key=lambda x: x[1][0])[:k]]


def picks(df):
    return [((r["src"], r["pool_id"]), r["score"]) for r in df.orderBy("sel_rank").collect()]


def random_rows(rng, n_t, n_p, ties=False, infs=False, n_src=1):
    rows = []
    for t in range(n_t):
        for src in range(n_src):
            for p in range(n_p):
                s = rng.choice([0.1, 0.2, 0.3]) if ties else round(rng.random(), 6)
                if infs and rng.random() < 0.1:
                    s = rng.choice([float("inf"), float("-inf")])
                rows.append((t, src, p, s))
    return rows


# --------------------------------------------------------------------------- round robin

@pytest.mark.parametrize("seed", range(6))
def test_round_robin_max_matches_queue(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, n_t=rng.randint(1, 5), n_p=rng.randint(3, 25), ties=seed % 2 == 0, n_src=1 + seed % 2)
    k = rng.randint(1, 30)
    got = picks(S.select_round_robin(spark.createDataFrame(rows, SCHEMA), k, largest=True, salt_buckets=3))
    assert got == by_steps(rows, k, True)


@pytest.mark.parametrize("seed", range(6))
def test_round_robin_min_matches_queue(spark, seed):
    rng = random.Random(100 + seed)
    rows = random_rows(rng, n_t=rng.randint(1, 5), n_p=rng.randint(3, 25), ties=seed % 2 == 1, infs=True)
    allow = {(0, p) for p in range(0, 40, 3)} if seed % 3 == 0 else None
    k = rng.randint(1, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    allow_df = spark.createDataFrame(sorted(allow), "src int, pool_id bigint") if allow else None
    got = picks(S.select_round_robin(df, k, largest=False, allow=allow_df))
    assert got == by_steps(rows, k, False, allow)


def test_allow_list_after_ranking_can_return_fewer(spark):
    rows = [(0, 0, p, 1.0 - p / 10) for p in range(10)] + [(1, 0, p, 1.0 - p / 10) for p in range(10)]
    allow = {(0, 5), (0, 6)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = picks(S.select_round_robin(df, 3, allow=spark.createDataFrame(sorted(allow), "src int, pool_id bigint")))
    assert got == by_steps(rows, 3, True, allow) == []


def test_k_zero_and_k_larger_than_pool(spark):
    rows = [(0, 0, 0, 0.5), (0, 0, 1, 0.7), (1, 0, 1, 0.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert S.select_round_robin(df, 0).count() == 0
    assert picks(S.select_round_robin(df, 10)) == by_steps(rows, 10, True)
    assert S.select(df, "mean_max", 0).count() == 0


def test_row_first_for_several_targets_and_ties_at_cut(spark):
    rows = [(t, 0, 7, 0.99) for t in range(3)] + [(t, 0, p, 0.5) for t in range(3) for p in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert picks(S.select_round_robin(df, 4)) == by_steps(rows, 4, True)


def test_invalid_index_dropped(spark):
    rows = [(0, 0, -1, 0.99), (0, 0, 1, 0.5), (0, 0, 2, 0.4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = picks(S.select_round_robin(df, 2))
    assert [i for i, _ in got] == [(0, 1), (0, 2)]


def test_partition_count_does_not_change_result(spark):
    rng = random.Random(7)
    rows = random_rows(rng, 4, 40, ties=True)
    df = spark.createDataFrame(rows, SCHEMA)
    a = picks(S.select_round_robin(df.repartition(1), 15))
    b = picks(S.select_round_robin(df.repartition(7), 15))
    assert a == b == by_steps(rows, 15, True)


# --------------------------------------------------------------------------- mean modes

def test_mean_max_keeps_later_row_at_tie_and_outputs_ascending(spark):
    rows = [(0, 0, p, s) for p, s in enumerate([0.1, 0.5, 0.5, 0.5, 0.9])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["pool_id"], r["score"]) for r in S.select(df, "mean_max", 3).orderBy("sel_rank").collect()]
    ref = sorted([((0, p), s) for _, _, p, s in rows], key=lambda x: x[1])[-3:]
    assert got == [(i[1], s) for i, s in ref]


def test_mean_min_and_constant_target(spark):
    rows = [(0, 0, p, 0.3) for p in range(4)] + [(1, 0, p, p / 10) for p in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["pool_id"], round(r["score"], 9)) for r in S.select(df, "normalized_mean_min", 2).orderBy("sel_rank").collect()]
    # constant target 0 normalises to 0; target 1 to p/3
    assert got == [(0, 0.0), (1, round((1 / 3) / 2, 9))]
    m = [(r["pool_id"], round(r["score"], 9)) for r in S.select(df, "mean_min", 2).orderBy("sel_rank").collect()]
    assert m == [(0, 0.15), (1, 0.2)]


def test_unknown_methods_rejected(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.1)], SCHEMA)
    for m in ("tradeoff", "diff"):
        with pytest.raises(ValueError):
            S.select(df, m, 1)


# --------------------------------------------------------------------------- quotas

def quota_picks(spark, rows, domain_of, weights, k, allow=None):
    df = spark.createDataFrame(rows, SCHEMA)
    dom = spark.createDataFrame([(0, p, d) for p, d in domain_of.items()], "src int, pool_id bigint, domain string")
    w = spark.createDataFrame(list(weights.items()), "domain string, weight double")
    allow_df = spark.createDataFrame([(0, p) for p in allow], "src int, pool_id bigint") if allow else None
    return [inst[1] for inst, _ in picks(S.select_round_robin_quota(df, dom, w, k, allow=allow_df))]


def test_quota_turns_written_out(spark):
    rows = [(0, 0, 0, .1), (0, 0, 1, .2), (0, 0, 2, .3), (0, 0, 3, .4), (1, 0, 1, .1), (1, 0, 4, .2), (1, 0, 5, .3)]
    domain_of = {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "b"}
    # two of each: target 0 takes 0, target 1 takes 1, and with "a" full 3 and 4 are next
    assert quota_picks(spark, rows, domain_of, {"a": 1.0, "b": 1.0}, 4) == [0, 1, 3, 4]
    # a domain without a weight has no quota
    assert quota_picks(spark, rows, domain_of, {"a": 1.0}, 4) == [0, 1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_quota_of_one_target_is_a_prefix_per_domain(spark, seed):
    rng = random.Random(200 + seed)
    rows = random_rows(rng, 1, 30)
    domain_of = {p: rng.choice(["math", "code", "bio_science", "chem_science", "chat"]) for p in range(30)}
    got = quota_picks(spark, rows, domain_of, {"math": 1.0, "code": 2.0, "science": 1.5, "other": 0.5}, 10)
    quota = {"math": 2, "code": 4, "science": 3}     # of 10, by weight
    order = [r[2] for r in sorted(rows, key=lambda r: (r[3], r[2]))]
    fold = {p: "science" if "science" in d else d for p, d in domain_of.items()}
    expected = {p for d, n in quota.items() for p in [x for x in order if fold[x] == d][:n]}
    assert got == [p for p in order if p in expected]


def turn_by_turn(rows, domains, weights, k, allow=None):
    """The queue as defined: targets take turns, a domain that is full is passed over,
    a row that is not allowed uses up its domain's quota, one picked before doesn't."""
    quota = {d: w / sum(weights.values()) * k for d, w in weights.items()}
    lists = {t: sorted((s, p) for x, p, s in rows if x == t) for t in sorted({r[0] for r in rows})}
    used, seen, out, moved = dict.fromkeys(quota, 0), set(), [], True
    while moved and len(out) < k:
        moved = False
        for t, own in lists.items():
            while own and used.get(domains[own[0][1]], 0) >= quota.get(domains[own[0][1]], 0):
                own.pop(0)
            if not own or len(out) >= k:
                continue
            moved, (s, p) = True, own.pop(0)
            if p in seen:
                continue
            used[domains[p]] += 1
            if allow is None or p in allow:
                seen.add(p)
                out.append((len(out) + 1, p, domains[p]))
    return out


@pytest.mark.parametrize("k", [1, 7, 40, 90])
@pytest.mark.parametrize("allowed", [False, True])
def test_quota_from_the_pool_turn_by_turn(spark, k, allowed):
    rng = random.Random(k)
    n = 120
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(n)}
    domains = {i: rng.choice(["math", "computer science", "life science", "code", "none"]) for i in range(n)}
    weights = {"math": 5.0, "science": 3.0, "code": 1.0, "empty": 1.0}
    pool = spark.createDataFrame([(0, i, v, domains[i]) for i, v in vectors.items()], "src int, pool_id long, vec array<double>, domain string").repartition(3)
    targets = spark.createDataFrame([(t, [rng.gauss(0, 1) for _ in range(4)]) for t in range(5)], "target_id long, vec array<double>")
    allow = pool.where("pool_id % 3 > 0").select("src", "pool_id") if allowed else None
    scores = [(r["target_id"], r["pool_id"], r["score"]) for r in SIM.cosine_scores(pool, targets).collect()]
    folded = {i: "science" if "science" in d else d for i, d in domains.items()}
    got = S.select_round_robin_quota_from_pool(pool, targets, spark.createDataFrame(list(weights.items()), "domain string, weight double"), k, allow)
    want = turn_by_turn(scores, folded, weights, k, {i for i in range(n) if i % 3} if allowed else None)
    assert [tuple(r) for r in got.select("sel_rank", "pool_id", "domain").orderBy("sel_rank").collect()] == want and want


def test_grouped_lists(spark):
    pool = spark.createDataFrame([(0, i, [1.0, float(i % 7)], "ab"[i % 2]) for i in range(30)] + [(0, 99, [1.0, 0.0], "c")], "src int, pool_id long, vec array<double>, g string").repartition(4)
    targets = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "target_id long, vec array<double>")
    flat = {(r["target_id"], r["pool_id"]): r["score"] for r in SIM.cosine_scores(pool, targets).collect()}
    got = [(r["target_id"], r["grp"], r["rank"], r["pool_id"], r["more"]) for r in SIM.grouped_topk(pool, targets, {"a": 4, "b": 50}, group="g").collect()]
    want = []
    for t in (0, 1):
        for g, n in (("a", 4), ("b", 50)):
            own = sorted((i for i in range(30) if "ab"[i % 2] == g), key=lambda i: (-flat[t, i], i))
            want += [(t, g, k + 1, i, g == "a" and k == 3) for k, i in enumerate(own[:n])]
    assert sorted(got) == sorted(want)
    assert SIM.grouped_topk(pool, targets, {}, group="g").count() == 0
