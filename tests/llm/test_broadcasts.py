"""Tables that Spark sizes too low, since rows come out of them many times over, stay off the driver."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sieve.llm import decontaminate, simhash


def plan(df):
    """The rows, and the plan as adaptive execution left it."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return spark.createDataFrame([(i, f"{base} {i % 7} {base}", "en", "s", 1) for i in range(14)], "doc_id long, text string, lang string, source string, n_chars long")


def query(spark, docs):
    return simhash.near_duplicates(docs)


def stage(spark, docs):
    return P.near_duplicates_stage(spark, docs, "")


@pytest.mark.parametrize("run", [query, stage])
def test_visitors_of_anchors_are_not_broadcast(spark, docs, run, monkeypatch):
    seen, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (seen.append(edges), real(edges))[1])
    run(spark, docs).count()
    _, text = plan(seen[0])
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_links_without_a_broadcast_are_those_of_all_pairs(spark):
    fps = [x << 29 for x in range(60)] + [-1, -2, 1 << 62, (1 << 62) + 6]
    rows, _ = plan(simhash.linked(spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")))
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert len(near) > 50 and sorted((r["a"], r["b"]) for r in rows) == sorted(near)


def test_an_exploded_table_beyond_the_limit_is_not_broadcast(spark):
    index = spark.range(20).select(F.col("id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("value"))
    asked = spark.range(500).select(F.col("id").cast("int").alias("value"))
    for rows, kind in ((decontaminate.BROADCAST_ROWS, "BroadcastHashJoin"), (decontaminate.BROADCAST_ROWS + 1, "SortMergeJoin")):
        got, text = plan(asked.join(decontaminate._small(index, rows), "value"))
        assert len(got) == 2000 and kind in text


def test_decontamination_by_shuffle_gives_the_same_rows(spark, docs, monkeypatch):
    leak = "nine ten eleven twelve thirteen fourteen fifteen 3 one two three"
    items = spark.createDataFrame([(1, leak), (2, "not in any text of these at all")], "item_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(None, leak, "en", "s", 1)], docs.schema))
    held, _ = plan(decontaminate.without_leaks(docs, items))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    shuffled, text = plan(decontaminate.without_leaks(docs, items))
    assert sorted(r["doc_id"] for r in held) == sorted(r["doc_id"] for r in shuffled)
    assert 0 < len(held) < 15 and "BroadcastExchange" not in text
