"""Resampled calibration measures against the distributed ones and against plain resampling."""

import numpy as np
import pytest

from assaylake.operators import calibration as cal

draw = np.random.default_rng(4)
P, B = np.round(draw.normal(-1.0, 1.0, 120), 1), np.round(draw.normal(0.6, 0.9, 90), 1)
ROWS = [("s", "P", float(x)) for x in P] + [("s", "B", float(x)) for x in B] + [("s", "P", None), ("t", "P", 1.0), ("s", "other", 2.0)]


def controls(spark):
    return spark.createDataFrame(ROWS, "set_id string, side string, score double")


def counts(p, b):
    u = np.unique(np.concatenate([p, b]))[:: -1]
    return u, (p[:, None] == u).sum(0), (b[:, None] == u).sum(0)


def measures(p, b, rule="error"):
    return dict(zip(cal.MEASURES, cal._curve_measures(*counts(p, b), rule, 0.05)))


@pytest.mark.parametrize("rule", ["error", "youden"])
def test_one_resample_measures_as_the_distributed_curves_do(spark, rule):
    got = measures(-P, -B, rule)
    steps = cal.control_steps(controls(spark))
    areas = cal.areas(steps).first()
    assert (got["auc", None], got["pr_auc", None]) == pytest.approx((areas.auc, areas.pr_auc))
    points = cal.roc(steps)
    limits = cal.thresholds(points, rule).first()
    assert (-got["abnormal", None], -got["normal", None]) == pytest.approx((limits.abnormal, limits.normal))
    for r in cal.sensitivity_at(points, cal.SPECIFICITIES).collect():
        assert got["sensitivity", r.specificity] == pytest.approx(r.sensitivity, nan_ok=True)
    for r in cal.precision_at(steps, cal.RECALLS).collect():
        assert got["precision", r.recall] == pytest.approx(r.precision)


def test_bootstrap_agrees_with_plain_resampling(spark):
    got = {(r.metric, r.at): r for r in cal.bootstrap(controls(spark), samples=2000).collect()}
    again = {(r.metric, r.at): r for r in cal.bootstrap(controls(spark).repartition(3), samples=2000).collect()}
    assert got == again and {r.set_id for r in got.values()} == {"s"} and len(got) == len(cal.MEASURES)
    rng = np.random.default_rng(9)
    plain = [measures(rng.choice(-P, len(P)), rng.choice(-B, len(B))) for _ in range(1500)]
    for key in [("auc", None), ("pr_auc", None), ("sensitivity", cal.SPECIFICITIES[16]), ("precision", cal.RECALLS[9])]:
        want = np.quantile([m[key] for m in plain], [0.025, 0.5, 0.975])
        assert (got[key].low, got[key].median, got[key].high) == pytest.approx(tuple(want), abs=0.02) and got[key].samples == 2000
    for key in [("abnormal", None), ("normal", None)]:
        values = [-m[key] for m in plain if np.isfinite(m[key])]
        assert got[key].median == pytest.approx(np.median(values), abs=0.11)
    share = np.mean([m["without_zone", None] for m in plain])
    assert got["without_zone", None].median == pytest.approx(share, abs=0.03)


def test_given_thresholds_are_checked(spark):
    sets = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 2.0), ("c", None, 2.0), ("d", 2.0, float("nan"))], "set_id string, abnormal double, normal double")
    assert {r.set_id: r.problem for r in cal.given_thresholds(sets).collect()} == {"a": None, "b": "abnormal beyond normal", "c": "not two numbers", "d": "not two numbers"}
    assert {r.set_id: r.problem for r in cal.given_thresholds(sets, "above").collect()}["a"] == "abnormal beyond normal"


@pytest.mark.parametrize("threshold", ["20k", "10m"])
def test_classes_of_controls_are_counted_once(spark, tmp_path, threshold):
    rows = [(f"s{i % 4}", "P" if (i * 7) % 5 < 2 else "B", float((i * 37) % 101)) for i in range(400)]
    spark.createDataFrame(rows, "set_id string, side string, score double").write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = cal.class_counts(read, cal.thresholds(cal.roc(cal.control_steps(read)))).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len({(r.set_id, r["class"]) for r in got}) and sum(r.p + r.b for r in got) == len(rows)
    assert {(r.n_p, r.n_b) for r in got} == {(40, 60)}


def test_ends_of_the_curve(spark):
    got = sorted((r.tp, r.fp, r.top, r.threshold) for r in cal.roc(cal.control_steps(controls(spark).where("score > 1.5 OR score < -1.5"))).collect())
    assert got[0] == (0, 0, True, None) and [r[2] for r in got].count(True) == 1 and [r[3] for r in got].count(None) == 2
