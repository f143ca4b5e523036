"""Edge cases of scoring: missing against zero, one replicate, zero variance, hot variants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import barcodes as bc
from assaylake.operators import combine as cb
from assaylake.operators import dimsum as dm
from assaylake.operators import filters as fl
from assaylake.operators import moderate as md
from assaylake.operators import ratio as rt


def test_pooling_keeps_missing(spark):
    lanes = spark.createDataFrame([("d", "v1", "a", 3.0), ("d", "v1", "b", 0.0), ("d", "v2", "a", 5.0), ("d", "v2", "z", 2.0)], "dataset_id string, variant string, source_column string, cnt double")
    design = spark.createDataFrame([("d", "s", "a", False), ("d", "s", "b", False), ("d", "t", "z", True)], "dataset_id string, sample_id string, source_column string, missing_means_zero boolean")
    got = {(r["variant"], r["sample_id"]): r["cnt"] for r in rt.pool_technical(lanes, design).collect()}
    assert got == {("v1", "s"): 3.0, ("v2", "s"): None, ("v2", "t"): 2.0, ("v1", "t"): 0.0}


def test_fixed_effects_exact_score_takes_all(spark):
    df = spark.createDataFrame([("v", 1.0, 0.0), ("v", 5.0, 1.0), ("w", 2.0, 1.0), ("w", 4.0, 1.0)], "variant string, score double, se double")
    got = {r["variant"]: (r["score"], r["se"]) for r in cb.combine_fixed(df, ["variant"]).collect()}
    assert got["v"] == (1.0, 0.0)
    assert got["w"] == pytest.approx((3.0, np.sqrt(0.5)))


def _reml(y, v):
    grid = np.concatenate([[0], np.geomspace(1e-6, 50, 40001)])
    w = 1 / (v[:, None] + grid)
    b = (w * y[:, None]).sum(0) / w.sum(0)
    ll = -0.5 * np.log(v[:, None] + grid).sum(0) - 0.5 * np.log(w.sum(0)) - 0.5 * (w * (y[:, None] - b) ** 2).sum(0)
    return grid[ll.argmax()]


def test_reml_batch_matches_likelihood_search():
    rng = np.random.default_rng(0)
    y, v = rng.normal(0, 2, (20, 4)), rng.uniform(0.1, 1, (20, 4))
    y[0, 2:] = np.nan
    v[0, 2:] = np.nan
    got = cb.reml_batch(y, v)["tau2"].to_numpy()
    want = [_reml(a[~np.isnan(a)], b[~np.isnan(b)]) for a, b in zip(y, v)]
    assert got == pytest.approx(want, rel=1e-2, abs=1e-3)


def test_reml_one_replicate_and_zero_variance():
    out = cb.reml_batch(np.array([[2.0, np.nan], [1.0, 3.0]]), np.array([[0.25, np.nan], [0.0, 1.0]]))
    assert out["estimate"].tolist() == [2.0, 1.0]
    assert out["se"].tolist() == [0.5, 0.0]


def test_reml_large_groups_equal_arrays(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"b{i}", float(y), float(s)) for g, n in (("hot", 300), ("small", 5)) for i, (y, s) in enumerate(zip(rng.normal(0, 1, n), rng.uniform(0.2, 0.8, n)))]
    df = spark.createDataFrame(rows, "variant string, barcode string, score double, se double")
    get = lambda bound: {r["variant"]: (r["score"], r["se"], r["tau2"]) for r in cb.combine_reml_large(df, ["variant"], bound=bound).collect()}
    a, b = get(1000), get(10)
    assert a["hot"] == pytest.approx(b["hot"], rel=1e-6)
    assert a["small"] == pytest.approx(b["small"])


def brute_outliers(y, se, scale, limit):
    alive, z, out = list(range(len(y))), {}, set()
    w = 1 / np.square(se)
    while len(alive) >= 3:
        i = np.array(alive)
        others = w[i].sum() - w[i]
        now = (y[i] - ((w[i] * y[i]).sum() - w[i] * y[i]) / others) / np.sqrt(1 / w[i] + 1 / others) / scale
        z.update(zip(alive, now))
        worst = int(np.argmax(np.abs(now)))
        if not abs(now[worst]) > limit:
            break
        out.add(alive.pop(worst))
        if len(alive) < 3:
            z.update({j: None for j in alive})
    return {j: (j in out, z.get(j)) for j in range(len(y))}


@pytest.mark.parametrize("held", [4096, 40])
def test_outliers_equal_removal_one_at_a_time(spark, held):
    rng = np.random.default_rng(2)
    # Many outliers on one side drag the mean: barcodes far from the limit at first pass it later.
    groups = {"hot": (np.concatenate([rng.normal(0, 0.3, 400), rng.normal(6, 1.0, 60), [-8.0]]), rng.uniform(0.1, 0.6, 461)), "two": (np.array([0.0, 5.0]), np.array([0.3, 0.3])), "three": (np.array([0.0, 0.1, 9.0]), np.array([0.3] * 3)), "plain": (rng.normal(0, 0.3, 30), np.full(30, 0.3))}
    rows = [("d", "r", g, f"b{i:03d}", float(a), float(b)) for g, (y, se) in groups.items() for i, (a, b) in enumerate(zip(y, se))]
    df = spark.createDataFrame(rows, "dataset_id string, replicate_id string, variant string, barcode string, score double, se double")
    phi = bc.barcode_disagreement(df).first().phi
    got = {(r["variant"], r["barcode"]): (r["outlier"], r["z"]) for r in bc.barcode_outliers(df, 4.0, held=held).collect()}
    assert len(got) == len(rows) and sum(o for o, _ in got.values()) > 40
    for g, (y, se) in groups.items():
        for i, (out, z) in brute_outliers(y, se, np.sqrt(phi), 4.0).items():
            assert got[g, f"b{i:03d}"] == (out, None if z is None else pytest.approx(z, rel=1e-6)), (g, i)


def test_filter_reasons_keep_every_variant(spark):
    rows = [("d", "a", "missense", "used", 5.0, 0.0), ("d", "a", "missense", "not counted", None, 1.0), ("d", "b", "missense", "not counted", None, None), ("d", "c", "nonsense", "used", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "dataset_id string, variant string, kind string, state string, c0 double, ct double")
    got = {r["variant"]: (r["reason"], r["flags"]) for r in fl.filter_reasons(df, ["dataset_id", "variant", "kind"], exclude_kinds=["nonsense"]).collect()}
    assert got == {"a": (None, 1 | 4), "b": ("measured", 0), "c": ("class", 0)}


def test_rescale_refuses_without_anchor(spark):
    rows = [("d", "p.=", "wild type", 0.0, 0.1), ("d", "x", "nonsense", -2.0, 0.1), ("e", "p.=", "wild type", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "dataset_id string, variant string, kind string, score double, se double")
    got = {(r["dataset_id"], r["variant"]): r["score"] for r in fl.rescale(df, "nonsense-wt").collect()}
    assert got == {("d", "p.="): 1.0, ("d", "x"): 0.0}
    assert [r["dataset_id"] for r in fl.rescale_problems(df, "nonsense-wt").collect()] == ["e"]


def _replicates(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        truth = rng.normal(0, 1)
        for r, shift in (("r1", 0.0), ("r2", 0.3), ("r3", -0.2)):
            v = rng.uniform(0.01, 0.05)
            rows.append(("d", f"v{i}", r, truth + shift + rng.normal(0, np.sqrt(2 * v + 0.02)), v))
    return spark.createDataFrame(rows, "dataset_id string, variant string, replicate_id string, y double, v double")


def test_error_model_recovers_and_large_path_agrees(spark):
    arrays = md.measurement_arrays(_replicates(spark), ["dataset_id"])
    small = md.fit_error_model(arrays, ["dataset_id"]).first()
    large = md.fit_error_model(arrays, ["dataset_id"], bound=10).first()
    assert (small["a"], small["b"]) == pytest.approx((large["a"], large["b"]), rel=1e-6)
    assert 2 * small["a"] * 0.03 + 2 * small["b"] == pytest.approx(2 * (2 * 0.03 + 0.02), rel=0.25)


def test_moderated_combination_has_every_variant(spark):
    out = md.moderated_combination(_replicates(spark, 100), ["dataset_id"]).toPandas()
    assert len(out) == 100 and (out["se"] > 0).all() and (out["k"] == 3).all()
    assert out["shift_variance"].iloc[0] == pytest.approx(np.var([0.0, 0.3, -0.2], ddof=1), rel=0.5)


def test_normalise_reaches_a_minimum_for_every_dataset(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(0, 1, (120, 1)) * np.array([1.0, 1.3, 0.8]) + np.array([0, 0.2, -0.1]) + rng.normal(0, 0.02, (120, 3))
    rows = [(d, [float(x) for x in r]) for d in ("d", "it's") for r in f]
    found = dm.normalise(spark.createDataFrame(rows, "dataset_id string, f array<double>"), 3).collect()
    assert sorted(r["dataset_id"] for r in found) == ["d", "it's"]

    def distance(a, b):
        return np.sqrt(np.square((f + b) * a - (f + b).mean(1, keepdims=True)).sum(1)).sum()

    for r in found:
        assert r["scale"] == pytest.approx([1.0, 1 / 1.3, 1 / 0.8], rel=0.1)
        shift = np.array(r["shift"])
        size = min((distance(np.array(r["scale"]) * k, shift), k) for k in np.linspace(0.9, 1.1, 401))[1]
        best = distance(np.array(r["scale"]) * size, shift)
        for i in range(3):
            for step in (-0.02, 0.02):
                assert distance(np.array(r["scale"]) * size + step * np.eye(3)[i], shift) > best - 1e-6
                assert distance(np.array(r["scale"]) * size, shift + step * np.eye(3)[i]) > best - 1e-6


def test_own_variance_absent_uses_the_model(spark):
    rows = [(f"v{i}", r, float(i % 5) + shift, 0.04) for i in range(12) for r, shift in (("1", 0.0), ("2", 1.0))]
    df = spark.createDataFrame([("d", *r) for r in rows], "dataset_id string, variant string, replicate_id string, y double, v double")
    with_own, without = (md.moderated_combination(df, ["dataset_id"], own_is_v=x).toPandas() for x in (True, False))
    assert not without["fitted"].any()
    assert (without["phi"] < with_own["phi"]).all()


def test_weights_by_substitutions(spark):
    names = [f"p.Ala{i}Val" for i in range(1, 31)] + [f"p.[Ala{i}Val;Gly{i + 1}Cys]" for i in range(1, 5)]
    df = spark.createDataFrame([("d", n, 5.0, 5.0) for n in names], "dataset_id string, variant string, c0 double, ct double")
    got = {r.variant: r.weight for r in dm.substitution_weights(df).collect()}
    assert got[names[0]] == pytest.approx(np.sqrt(30)) and got[names[-1]] == pytest.approx(np.sqrt(np.sqrt(34)))


def test_halves_alternate_in_ranges_that_follow_the_data(spark):
    from assaylake.operators import qc

    rng = np.random.default_rng(6)
    codes = sorted({"ACGTACGT" + "".join(rng.choice(list("ACGT"), 14)) for _ in range(20_000)})
    rows = [("d", "r", "hot", c) for c in codes] + [("d", "r", f"v{i % 40}", c) for i, c in enumerate(codes[:400])]
    df = spark.createDataFrame(rows, "dataset_id string, replicate_id string, variant string, barcode string")
    keys = ["dataset_id", "replicate_id", "variant"]
    sizes = [r["count"] for r in qc._ranged(df, keys).groupBy("__p").count().collect()]
    assert max(sizes) < 0.02 * len(rows)
    got = [r.half for r in qc._alternating(df, keys).where("variant = 'hot'").orderBy("barcode").collect()]
    assert got == [i % 2 for i in range(len(codes))]
