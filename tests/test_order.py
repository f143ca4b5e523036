"""Distributed order statistics against numpy, with ties, skew and one-row groups."""

import numpy as np
import pytest

from assaylake.functions import order
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in np.round(rng.normal(0, 3, 900), 1)] + [("small", float(x)) for x in rng.normal(1e5, 1, 40)] + [("one", 7.0)]
    rows += [("hot", 0.0)] * 300 + [("ties", -2.5)] * 25
    return spark.createDataFrame(rows, "g string, x double"), rows


def by_group(rows):
    out = {}
    for g, x in rows:
        out.setdefault(g, []).append(x)
    return out


def test_quantiles(values):
    df, rows = values
    got = {r["g"]: r for r in order.quantiles(df, ["g"], "x", {"a": 0.05, "m": 0.5, "b": 0.9}, count="n").collect()}
    for g, xs in by_group(rows).items():
        assert got[g]["n"] == len(xs)
        assert [got[g][k] for k in "amb"] == pytest.approx(np.quantile(xs, [0.05, 0.5, 0.9]))


def test_average_ranks_and_partitioning(values):
    df, rows = values
    one = sorted(map(tuple, order.with_average_rank(df, ["g"], "x").collect()))
    many = sorted(map(tuple, order.with_average_rank(df.repartition(13), ["g"], "x").collect()))
    assert one == many
    xs = np.array(by_group(rows)["hot"])
    expected = {x: (xs < x).sum() + ((xs == x).sum() + 1) / 2 for x in set(xs)}
    assert all(r[2] == expected[r[1]] for r in one if r[0] == "hot")


def test_benjamini_hochberg(spark):
    p = [0.01, 0.02, 0.02, 0.3, 0.9, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "g string, i int, p double")
    got = {r["i"]: r["q"] for r in order.benjamini_hochberg(df, ["g"]).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.02 * 5 / 3, 0.02 * 5 / 3, 0.02 * 5 / 3, 0.375, 0.9])
    assert got[5] is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True), ("g", 2.0, False), ("g", 0.0, False)], "g string, x double, a boolean")
    assert order.auc(df, ["g"], "x", F.col("a")).first()["auc"] == pytest.approx((0 + 1 + 0.5 + 1) / 4)


def test_equal_bins_split_ties(spark):
    df = spark.createDataFrame([("g", 1.0)] * 7 + [("g", 2.0)] * 3, "g string, x double")
    got = order.equal_bins(df, ["g"], "x", F.lit(2)).groupBy("bin").agg(F.sum("weight").alias("n")).collect()
    assert {r["bin"]: r["n"] for r in got} == {0: 5, 1: 5}
