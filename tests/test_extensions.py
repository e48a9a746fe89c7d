"""Functions by name, pools with a renderer of their own, one-pass moments, one join for stored outputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import joins as J
from sieve.operators import pooling as P
from sieve.operators import projection as PR
from sieve.operators import whitening as W
from sieve.plans import extensions as X
from sieve.plans import tasks as TK
from sieve.functions import text as T
from sieve.sources import readers as RD

SOURCE = '''
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PREFIX = "ask: "

def shout(c):
    return F.concat(F.lit(PREFIX), F.upper(c))

@F.pandas_udf(StringType())
def _slow(s: pd.Series) -> pd.Series:
    import formatter_for_test as own
    return own.PREFIX + s.str[::-1]

def backwards(c):
    return _slow(c)

def plain(text):
    return text.strip() + "!"

def constant(c):
    return "no column"

def rows(df):
    return F.concat_ws("|", "id", F.get("messages.content", 0))

NOT_CALLABLE = 5
'''


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = tmp_path_factory.mktemp("ext") / "formatter_for_test.py"
    at.write_text(SOURCE)
    return str(at)


def test_formatters_from_a_file(spark, path):
    df = spark.createDataFrame([("ab",), (None,)], "t string").repartition(2)
    for name, want in (("shout", "ask: AB"), ("backwards", "ask: ba")):
        f = X.load_formatter(spark, f"{path}:{name}")
        assert {r[0] for r in df.select(f(F.col("t"))).collect()} == {want, None}
    assert X.load_function(spark, f"{path}:shout") is X.load_function(spark, f"{path}:shout")


def test_formatters_by_dotted_path(spark):
    df = spark.createDataFrame([("  a ",)], "t string")
    assert df.select(X.load_formatter(spark, "sieve.functions.text.strip")(F.col("t"))).first()[0] == "a"


@pytest.mark.parametrize("name,error,says", [
    (":plain", TypeError, "plain"), (":constant", TypeError, "gives str"), (":NOT_CALLABLE", ValueError, "no function"), (":missing", ValueError, "no function"),
    ("no_such_module_here.f", ValueError, "no module"), ("sieve.functions.text.nothing", ValueError, "no function"), ("strip", ValueError, "module.function"), ("/no/such.py:f", ValueError, "no file")])
def test_names_that_cannot_be_used(spark, path, name, error, says):
    with pytest.raises(error, match=says):
        X.load_formatter(spark, path + name if name.startswith(":") else name)


def test_a_module_that_fails_itself_is_not_called_missing(spark, tmp_path, monkeypatch):
    (tmp_path / "broken_for_test.py").write_text("import not_installed_anywhere\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError, match="not_installed_anywhere"):
        X.load_function(spark, "broken_for_test.f")


def test_pools_render_by_their_entry(spark, path, tmp_path, monkeypatch):
    monkeypatch.setattr(RD, "NAMED_POOLS", {})
    (tmp_path / "pool.jsonl").write_text('{"id": "a", "messages": [{"role": "user", "content": " hello "}]}\n{"id": "b", "mid": "7", "system_message": "s", "messages": [{"role": "HUMAN", "content": "x"}, {"role": "ASSISTANT", "content": "y"}]}\n')
    RD.register_pool("own", str(tmp_path / "pool.jsonl"), X.load_function(spark, f"{path}:rows"))
    RD.register_pool("other", str(tmp_path / "pool.jsonl"))
    text = lambda name: {r["id"]: r["text"] for r in RD.render_pool(RD.read_named_pool(spark, name), name).collect()}                    # noqa: E731
    assert text("own") == {"a": "a| hello ", "b": "b|x"}
    assert text("other") == {"a": "<|user|>\nhello", "b": "<|system|>\ns\n<|user|>\nx\n<|assistant|>\ny</s>"}


@pytest.mark.parametrize("partitions,block", [(1, 1 << 17), (7, 40), (70, 16)])
def test_moments_in_one_pass(spark, monkeypatch, partitions, block):
    """Against NumPy, where the mean is large beside the deviations; more than 32 tasks, blocks of some rows."""
    monkeypatch.setattr(W, "BLOCK_VALUES", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) @ rng.normal(size=(8, 8)) + 1e6
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "pool_id long, vec array<double>").repartition(partitions)
    mean, cov, n = W.covariance(df)
    assert n == 500 and mean == pytest.approx(x.mean(axis=0), rel=1e-12) and cov == pytest.approx(np.cov(x.T), rel=1e-6)
    assert W.moments(df).count() == -(-8 // max(1, block // 8))


def test_moments_of_few_and_unequal_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "pool_id long, vec array<double>")
    mean, cov, n = W.covariance(one)
    assert n == 1 and mean.tolist() == [1.0, 2.0] and not cov.any()
    with pytest.raises(ValueError, match="empty fit sample"):
        W.covariance(one.limit(0))
    with pytest.raises(Exception):
        W.covariance(one.unionByName(spark.createDataFrame([(1, [1.0])], one.schema)))


def test_merge_of_empty_sides():
    m = (3, np.array([1.0]), np.array([[2.0]]))
    assert W.merge_moments(0, None, None, *m) == m and W.merge_moments(*m, 0, None, None) == m


def test_segments_that_do_not_divide_raise_without_a_second_pass(spark):
    layers = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0]), (0, 1, [4.0, 5.0, 6.0])], "sample_id long, li int, vec array<double>")
    assert P.combine_segment_cat(layers.withColumn("vec", F.slice("vec", 1, 2)), 2).first()["vec"] == [1.0, 5.0]
    with pytest.raises(Exception, match="must divide"):
        P.combine_segment_cat(layers, 2).collect()


def test_redcat_learns_the_size_from_one_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(PR, "combine_redcat", lambda per_layer, n, seed, d: seen.append(d) or per_layer)
    states = spark.createDataFrame([(0, layer, 1, [1.0] * 6) for layer in range(5)], "sample_id long, layer int, pos int, vec array<double>")
    P.embed(states, "multilayer", n_layer=2, sec_pooling="redcat")
    assert seen == [6]


def test_stored_outputs_are_marked_in_one_join(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    got = sorted(((r["id"], r["done"]) for r in J.mark_done(rows, spark.createDataFrame([(2,), (2,), (5,)], "id long"), "id").collect()), key=str)
    assert got == [(1, False), (2, True), (2, True), (None, False)]


def test_there_is_one_list_of_stops():
    assert "\n<|/" in T.CODE_STOPS and not hasattr(TK, "CODE_STOPS")
