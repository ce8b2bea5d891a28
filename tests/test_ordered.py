"""The prefix scan must equal the plain window whatever the key frequencies and ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from cohortlens.operators import ordered, quantiles
from cohortlens.operators.ordered import mid_ranks, ordered_scan
from cohortlens.session import materialize

SCAN = dict(position="pos", size="sz", running={"run": "v", "run_x": "x"}, totals={"tot": "v", "tot_x": "x"},
            lag={"prev": "v", "prev_id": "id", "prev_name": "name"}, lead={"nxt": "v", "next_day": "day"})


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{rng.randrange(200)}")
        rows.append((key, rng.randrange(40) if i % 11 else None, i, None if rng.random() < 0.1 else rng.randrange(100), rng.choice([0.5, 1.25, None]), f"n{i}"))
    df = spark.createDataFrame(rows, "key string, t int, id long, v long, x double, name string").repartition(5)
    return df.withColumns({"day": F.timestamp_seconds("id"), "both": F.struct("id", "name")})


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def windowed(df, keys):
    whole = Window.partitionBy(*keys)
    by = whole.orderBy("t", "id")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.row_number().over(by).cast("bigint").alias("pos"), F.count(F.lit(1)).over(whole).alias("sz"),
                     *[F.sum(c).over(upto).alias(o) for o, c in SCAN["running"].items()], *[F.sum(c).over(whole).alias(o) for o, c in SCAN["totals"].items()],
                     *[F.lag(c).over(by).alias(o) for o, c in SCAN["lag"].items()], *[F.lead(c).over(by).alias(o) for o, c in SCAN["lead"].items()])


@pytest.mark.parametrize("ranges", [None, 1, 2, 13, 400])
@pytest.mark.parametrize("keys", [["key"], [], ["key", "v"]])
def test_scan_equals_the_window(skewed, keys, ranges):
    assert same(windowed(skewed, keys), ordered_scan(skewed, keys, ["t", "id"], ranges=ranges, **SCAN))


def test_scan_in_small_batches(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert same(windowed(skewed, ["key"]), ordered_scan(skewed, ["key"], ["t", "id"], ranges=3, **SCAN))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_key_spans_partitions_and_each_has_few_edges(skewed, monkeypatch):
    seen = []
    plain = ordered._scan_partitions
    monkeypatch.setattr(ordered, "_scan_partitions", lambda *a: seen.append(materialize(plain(*a))) or seen[-1])
    got = ordered_scan(skewed, ["key"], ["t", "id"], position="pos", ranges=16).where("key = 'hot'").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(got) == (1, 1000, 1000)
    local = seen[0]
    assert local.where("key = 'hot'").select("_scan_part").distinct().count() >= 5
    assert local.groupBy("_scan_part").agg(F.count_if("_scan_edge").alias("e")).agg(F.max("e")).first()[0] <= 4
    assert local.groupBy("_scan_part").count().agg(F.max("count")).first()[0] < 600


def test_odd_numbers_stay_in_their_key(spark):
    rows = [("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 2.0), ("b", 1, 5.0), ("b", 2, 6.0), ("c", 1, float("inf")), ("d", 1, None), ("d", 2, 3.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = [(r.k, r.t, str(r.run), str(r.tot)) for r in ordered_scan(df, ["k"], ["t"], running={"run": "x"}, totals={"tot": "x"}, ranges=1).orderBy("k", "t").collect()]
    assert got == [("a", 1, "1.0", "nan"), ("a", 2, "nan", "nan"), ("a", 3, "nan", "nan"), ("b", 1, "5.0", "11.0"), ("b", 2, "11.0", "11.0"),
                   ("c", 1, "inf", "inf"), ("d", 1, "None", "3.0"), ("d", 2, "3.0", "3.0")]
    assert ordered_scan(df.limit(0), ["k"], ["t"], position="p", lag={"q": "x"}).count() == 0


@pytest.mark.parametrize("limit, accuracy, grid", [(2000, 10000, 200), (5, 50, 10)])
def test_quantiles(spark, monkeypatch, limit, accuracy, grid):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "GRID", grid)
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, 6, 500).astype(float), rng.lognormal(size=500), np.where(np.arange(500) % 50, 3.0, rng.normal(size=500))
    df = spark.createDataFrame([(float(x), float(y), float(z), None, None if i else 7.0) for i, (x, y, z) in enumerate(zip(a, b, c))],
                               "a double, b double, c double, none double, one double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {r["variable"]: r["q"] for r in quantiles.exact_quantiles(df.where("true").distinct() if limit == 5 else df, df.columns, probs, limit).collect()}
    assert set(got) == {"a", "b", "c", "one"} and got["one"] == [7.0] * 6
    for name, values in {"a": a, "b": b, "c": c}.items():
        assert np.allclose(got[name], np.quantile(values, probs))


def test_quantiles_rank_missing_numbers_last(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (float("inf"),), (None,)], "x double")
    q = quantiles.exact_quantiles(df, ["x"], [0.0, 1 / 3, 2 / 3, 1.0], limit=1).first()["q"]
    assert q[:3] == [float("-inf"), 1.0, float("inf")] and np.isnan(q[3])


def test_ranks(spark):
    a = np.random.default_rng(0).integers(0, 6, 500).astype(float)
    df = spark.createDataFrame([(float(x),) for x in a], "a double")
    for kw in ({}, {"ranges": 9}):
        ranks = {r["value"]: r["mid_rank"] for r in mid_ranks(df, ["a"], **kw).collect()}
        assert ranks[a.min()] == ((a == a.min()).sum() + 1) / 2
