"""Refusals, the default analysis, the multiverse on arrays and conservation by blocks against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import analysis as an
from assaylake.operators import conservation as cons
from assaylake.operators import robustness as rb
from assaylake.operators.combine import reml_batch
from assaylake.operators.moderate import moderated_combination

PAIRS = "dataset_id string, replicate_id string, variant string, kind string, position int, c0 double, ct double"


def experiment(name, n=120, reps=("r1", "r2", "r3"), wt=500.0, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for r in reps:
        rows.append((name, r, "p.=", "wild type", None, wt, None if wt is None else wt * 0.9))
        for i in range(n):
            kind = "synonymous" if i % 11 == 0 else "nonsense" if i % 13 == 0 else "missense"
            effect = {"synonymous": 0.0, "nonsense": -2.0, "missense": -(i % 7) / 3}[kind]
            c0 = float(draw.poisson(60 + 3 * (i % 50)))
            ct = None if i == 5 and r == "r2" else float(draw.poisson(max(0.1, c0 * math.exp(effect))))
            rows.append((name, r, f"v{i:03d}", kind, i // 4, c0, ct))
    return rows


def test_refusals_name_every_dataset_left_out(spark):
    rows = experiment("good") + [r for r in experiment("bare") if r[3] != "wild type"] + experiment("dead", wt=0.0) + experiment("lost", wt=None)
    rows += experiment("twice") + [("twice", "r1", "wt again", "wild type", None, 5.0, 5.0)]
    scores, refused = an.analyse(spark.createDataFrame(rows, PAIRS))
    got = {(r.dataset_id, r.place, r.code) for r in refused.collect()}
    want = {("bare", None, "wild-type-absent"), ("twice", None, "wild-type-rows")}
    want |= {("dead", r, "wild-type-no-reads") for r in ("r1", "r2", "r3")} | {("lost", r, "wild-type-uncounted") for r in ("r1", "r2", "r3")}
    assert got == want and {c for *_, c in got} <= set(an.REFUSALS)
    rows = scores.collect()
    assert {r.dataset_id for r in rows if r.reason == "refused"} == {"bare", "dead", "lost", "twice"}
    assert {r.dataset_id for r in rows if r.score is not None} == {"good"} and len([r for r in rows if r.dataset_id == "good"]) == 121


def test_count_and_design_refusals(spark):
    counts = spark.createDataFrame([("a", "s", "v", 1.0), ("a", "s", "v", 2.0), ("a", "t", "v", None), ("b", "s", "v", -1.0), ("b", "t", "w", -3.0), ("c", "s", "v", 0.0)], "dataset_id string, sample_id string, variant string, cnt double")
    assert sorted((r.dataset_id, r.code, r.n) for r in an.count_refusals(counts).collect()) == [("a", "duplicate-variant", 1), ("b", "negative-count", 2)]
    codes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", ""), ("b", "y"), ("c", None)], "dataset_id string, barcode string")
    assert sorted((r.dataset_id, r.code, r.n) for r in an.barcode_refusals(codes).collect()) == [("a", "barcode-blank", 1), ("a", "barcode-repeated", 1), ("c", "barcode-blank", 1)]
    times = spark.createDataFrame([("a", "r1", t) for t in (0.0, 1.0, 2.0)] + [("a", "r2", 0.0), ("a", "r2", 1.0)] + [("b", "r1", t) for t in (-2.0, -1.0, 0.0)], "dataset_id string, replicate_id string, time double")
    assert sorted((r.dataset_id, r.place, r.code) for r in an.regression_refusals(times).collect()) == [("a", "r2", "few-time-points"), ("b", "r1", "no-later-time")]
    states = spark.createDataFrame([("a", "r1", "synonymous", "input count"), ("a", "r2", "synonymous", "used")], "dataset_id string, replicate_id string, kind string, state string")
    assert [(r.dataset_id, r.place, r.code) for r in an.synonymous_refusals(states).collect()] == [("a", "r1", "no-synonymous")]
    bins = spark.createDataFrame([("a", "r1", "wild type", "used", 1.0), ("a", "r1", "nonsense", "used", 1.0), ("b", "r1", "wild type", "used", 1.0), ("c", "r1", "wild type", "used", 1.0), ("c", "r1", "nonsense", "used", 0.0)], "dataset_id string, replicate_id string, kind string, state string, score double")
    assert sorted((r.dataset_id, r.code) for r in an.bin_refusals(bins).collect()) == [("a", "bin-flat"), ("b", "bin-unscaled")]


def test_default_analysis_is_the_moderated_combination(spark):
    pairs = spark.createDataFrame(experiment("e", 200), PAIRS)
    scores, refused = an.analyse(pairs)
    assert refused.count() == 0
    wt = {r.replicate_id: (r.c0, r.ct) for r in pairs.where("kind = 'wild type'").collect()}
    rows = []
    for r in pairs.where("c0 >= 1 and ct is not null").collect():
        a, b = (x + 0.5 for x in wt[r.replicate_id])
        c0, ct = r.c0 + 0.5, r.ct + 0.5
        rows.append(("e", r.variant, r.replicate_id, math.log(ct / b) - math.log(c0 / a), 1 / c0 + 1 / ct + 1 / a + 1 / b, min(r.c0, r.ct) >= 5))
    direct = moderated_combination(spark.createDataFrame(rows, "dataset_id string, variant string, replicate_id string, y double, v double, informative boolean"), ["dataset_id"])
    want = {r.variant: (r.score, r.se) for r in direct.collect()}
    got = {r.variant: (r.score, r.se) for r in scores.collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)


def test_rescaling_lists_datasets_without_anchors(spark):
    rows = experiment("e") + [r for r in experiment("f") if r[3] != "nonsense"]
    scores, refused = an.analyse(spark.createDataFrame(rows, PAIRS), an.Settings("complete", combination="fixed", rescale="synonymous-nonsense"))
    assert [(r.dataset_id, r.code) for r in refused.collect()] == [("f", "anchor-absent")]
    assert [r.reason for r in scores.where("dataset_id = 'f'").collect()] == ["refused"]
    middle = scores.where("dataset_id = 'e'").join(spark.createDataFrame(rows, PAIRS).select("variant", "kind").distinct(), "variant").groupBy("kind").agg(F.median("score").alias("m"))
    at = {r.kind: r.m for r in middle.collect()}
    assert at["synonymous"] == pytest.approx(0.0, abs=1e-12) and at["nonsense"] == pytest.approx(-1.0)


def test_specifications_on_arrays_equal_plain_scores(spark):
    rows = experiment("e", 60) + experiment("f", 60, reps=("r1", "r4"), seed=1)
    pairs = spark.createDataFrame(rows, PAIRS)
    choices = {"pseudocount": [0.5, 1.0], "normalization": ["complete", "synonymous", "wt", "full"], "combination": ["reml", "mean", "fixed", "moderated"], "min_input": [1.0, 90.0], "leave_out": [None, "r1"], "min_replicates": [1, 2]}
    specs = rb.specifications(choices, limit=24)
    got = {(r.dataset_id, r.variant, r.spec_id): (r.k, r.score, r.se) for r in rb.run_specs(pairs, specs).collect()}
    assert {s["combination"] for s in specs} == {"reml", "mean", "fixed", "moderated"}
    for spec in specs:
        for name in ("e", "f"):
            own = [r for r in rows if r[0] == name]
            p, how = spec["pseudocount"], spec["normalization"]
            measured = collections.defaultdict(list)
            for rep in {r[1] for r in own} - {spec["leave_out"]}:
                of = [r for r in own if r[1] == rep]
                both = [r for r in of if r[5] is not None and r[6] is not None]
                a, b = {
                    "complete": lambda: (sum(r[5] for r in both) + p, sum(r[6] for r in both) + p), "full": lambda: (sum(r[5] for r in of) + p, sum(r[6] or 0 for r in of) + p),
                    "wt": lambda: next((r[5] + p, r[6] + p) for r in of if r[3] == "wild type"), "synonymous": lambda: (1.0, 1.0),
                }[how]()
                used = [r for r in both if r[5] >= spec["min_input"]]
                y = {r[2]: math.log((r[6] + p) / b) - math.log((r[5] + p) / a) for r in used}
                if how == "synonymous":
                    centre = np.median([y[r[2]] for r in used if r[3] == "synonymous"])
                    y = {v: x - centre for v, x in y.items()}
                for r in used:
                    measured[r[2]].append((y[r[2]], 1 / (r[5] + p) + 1 / (r[6] + p) + (0 if how == "synonymous" else 1 / a + 1 / b)))
            assert {v for d, v, s in got if d == name and s == spec["spec_id"]} == set(measured)
            for variant, m in measured.items():
                k, score, se = got[name, variant, spec["spec_id"]]
                ys, vs = np.array([x for x, _ in m]), np.array([v for _, v in m])
                assert k == len(m)
                if k < spec["min_replicates"]:
                    assert score is None and se is None
                elif spec["combination"] == "fixed":
                    assert (score, se) == pytest.approx(((ys / vs).sum() / (1 / vs).sum(), (1 / vs).sum() ** -0.5))
                elif spec["combination"] == "mean":
                    assert (score, se) == pytest.approx((ys.mean(), math.sqrt(vs[0]) if k == 1 else ys.std(ddof=1) / math.sqrt(k)))
                elif spec["combination"] == "reml":
                    fit = reml_batch(ys[None], vs[None]).iloc[0]
                    assert (score, se) == pytest.approx((fit.estimate, fit.se), rel=1e-6)
                else:
                    assert min(ys) - 1e-9 <= score <= max(ys) + 1e-9 and se > 0


def test_conservation_by_blocks_equals_a_plain_count(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("MOST_SEQUENCES", 3), ("TALLY_LETTERS", 20)):
        monkeypatch.setattr(cons, name, value)
    draw = np.random.default_rng(2)
    texts = {i: "".join(draw.choice(list("ARND-X"), int(draw.integers(0, 15)))) for i in range(25)}
    texts[25], texts[26] = None, "----"
    rows = [("x" if i % 3 else None, i, t) for i, t in texts.items()]
    rows = [("x", i, t) for _, i, t in rows] + [("y", 99, "AR")]
    frame = spark.createDataFrame(rows, "aln_id string, seq_no long, residues string")
    counts = cons.column_counts(frame).cache()
    weights = {(r.aln_id, r.seq_no): r.weight for r in cons.henikoff(frame, counts).collect()}
    letters = {(a, i, c): x for a, i, t in rows for c, x in enumerate(t or "") if x in cons.BACKGROUND}
    n = collections.Counter((a, c, x) for (a, _, c), x in letters.items())
    types = collections.Counter((a, c) for a, c, _ in n)
    width = {a: max(c for b, _, c in letters if b == a) + 1 for a in ("x", "y")}
    want = collections.Counter()
    for (a, i, c), x in letters.items():
        want[a, i] += 1 / (n[a, c, x] * types[a, c]) / width[a]
    assert weights.keys() == want.keys() and all(weights[k] == pytest.approx(want[k]) for k in want)
    f = collections.Counter()
    for (a, i, c), x in letters.items():
        f[a, c + 1, x] += want[a, i]
    got = cons.column_freq(frame, counts, cons.henikoff(frame, counts)).collect()
    assert {(r.aln_id, r.col) for r in got} == {k[:2] for k in f}
    for r in got:
        assert list(r.freq) == pytest.approx([f[r.aln_id, r.col, x] for x in cons.BACKGROUND])
        assert r.gap_share == pytest.approx(1 - sum(n[r.aln_id, r.col - 1, x] for x in cons.BACKGROUND) / len({i for b, i, _ in letters if b == r.aln_id}))


def test_conservation_of_an_empty_alignment(spark):
    frame = spark.createDataFrame([], "aln_id string, seq_no long, residues string")
    counts = cons.column_counts(frame)
    assert cons.column_freq(frame, counts, cons.henikoff(frame, counts)).count() == 0
