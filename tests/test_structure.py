"""The cluster test against expectations that can be computed."""

import numpy as np
import pytest

from assaylake.operators import structure as st

SCHEMA = "dataset_id string, position int, x double, y double, z double, rsa double, value double"


def protein(name, n, seed, clustered):
    rng = np.random.default_rng(seed)
    xyz = rng.random((n, 3))
    value = rng.normal(0, 1, n)
    if clustered:
        value -= 10 * (np.linalg.norm(xyz - 0.5, axis=1) < 0.35)
    return [(name, i + 1, *map(float, xyz[i]), float(rng.random()), float(value[i])) for i in range(n)]


def test_clusters_stand_out_and_scattered_positions_do_not(spark):
    rows = protein("tight", 200, 1, True) + protein("loose", 120, 2, False) + protein("few", 9, 3, False) + [("tight", 500, None, None, None, 0.1, 0.2)]
    got = {r.dataset_id: r for r in st.cluster_test(spark.createDataFrame(rows, SCHEMA), 0.2).collect()}
    assert set(got) == {"tight", "loose"}
    assert (got["tight"].n, got["tight"].k, got["tight"].strata, got["loose"].strata) == (200, 40, 16, 10)
    assert got["tight"].p < 0.01 and got["tight"].any_p < 0.01 and got["loose"].p > 0.02
    for name, n in (("tight", 200), ("loose", 120)):
        points = np.array([r[2:5] for r in rows if r[0] == name and r[2] is not None])
        near = np.triu(np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.2, 1)
        k = round(0.2 * n)
        chosen = np.argsort([r[6] for r in rows if r[0] == name and r[2] is not None])[:k]
        assert got[name].observed == near[np.ix_(chosen, chosen)].sum()
        # Over all positions a pair is drawn with probability k (k - 1) / (n (n - 1)).
        assert got[name].any_expected == pytest.approx(near.sum() * k * (k - 1) / (n * (n - 1)), rel=0.08)
    again = {r.dataset_id: r for r in st.cluster_test(spark.createDataFrame(rows[::-1], SCHEMA), 0.2).collect()}
    assert again == got


def test_strata_follow_the_number_of_positions():
    assert [st.cluster_strata(n) for n in (10, 79, 100, 200, 5000)] == [4, 7, 8, 16, 16]
