"""Work that must not grow faster than its input, and counts read as the SQL reads them."""

import random

import duckdb
import pytest

from assaylake.functions import order
from assaylake.operators import qc, slope
from assaylake.plans.catalog import QUERIES
from tests.compare import difference


def test_unmapped_barcodes_without_reads_are_not_counted(spark):
    rows = [("A", "b1", "v", 5.0), ("A", "b2", None, 3.0), ("A", "b3", None, 0.0), ("A", "b4", None, None), ("B", "b5", None, 0.0)]
    got = qc.unmapped_share(spark.createDataFrame(rows, "dataset_id string, barcode string, variant string, cnt double")).collect()
    assert [(r.dataset_id, r.reads, r.unmapped, r.unmapped_share) for r in got] == [("A", 8.0, 1, 0.375)]


def test_a_filter_on_the_fit_does_not_repeat_its_sums(spark):
    rows = spark.createDataFrame([("A", "r1", "v", "missense", float(t), 10.0 + t * t) for t in range(5)] + [("A", "r1", "w", "missense", 0.0, 4.0)], "dataset_id string, replicate_id string, variant string, kind string, time double, cnt double")
    fits = slope.slope_scores(rows, slope.time_normalizers(rows, "full"))
    judged = fits.where("state = 'used' AND points >= 3 AND fit IS NOT NULL AND fit / 2 < 1e9")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") < 20
    assert [(r.variant, r.points) for r in judged.collect()] == [("v", 5)]
    fitted = qc.time_fit(fits).collect()
    assert [(r.fits, r.assessed) for r in fitted] == [(1, 1)]


def test_groups_of_any_size_give_the_same_steps(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.randrange(60) / 7, rng.random()) for k, n in (("a", 400), ("b", 30), ("c", 1)) for _ in range(n)] + [("a", None, 1.0), ("d", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    steps = lambda: sorted(map(tuple, order.value_steps(df, ["k"], "x", {"s": order.F.round(order.F.col("y") * 100).cast("long")}).collect()))
    one = order.value_steps(df, ["k"], "x")
    assert "percentile_approx" not in one._jdf.queryExecution().optimizedPlan().toString()
    small = steps()
    monkeypatch.setattr(order, "HELD", 40)
    assert steps() == small
    monkeypatch.setattr(order, "HELD", 0)
    assert steps() == small


def test_observed_pairs_of_short_proteins(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 0 if i < 4 else 1, [float(round(rng.random() / 8, 6)) for _ in range(5)]) for i in range(40)] + [(600, 2, [0.1, 0.2, 0.3, 0.4, 0.5])]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    query = QUERIES["t3_observed_pairs"]
    got = query.run(spark, str(tmp_path))
    assert difference(got, con, query.oracle()) is None
    assert {r.dataset_id for r in got.collect()} == {"P0-0", "P1-0", "P2-1"}


def test_single_alternatives_run_no_combinations(monkeypatch):
    from types import SimpleNamespace

    from assaylake.plans import comparisons

    class Ran(Exception):
        pass

    def ran(pairs, specs):
        raise Ran([s["kind"] for s in specs])

    monkeypatch.setattr(comparisons, "cut", lambda df: df)
    monkeypatch.setattr(comparisons.rb, "run_specs", ran)
    for name in ("r5_by_choice", "r5_choice_correlation"):
        with pytest.raises(Ran) as e:
            QUERIES[name].build(SimpleNamespace(pairs=None))
        assert e.value.args[0] == ["declared"] + ["single"] * 10


def test_consequences_are_worked_out_once_per_target(spark, monkeypatch):
    from assaylake.operators import names as nm

    sizes = []
    spread = nm.spread
    monkeypatch.setattr(nm, "spread", lambda df: sizes.append(df.count()) or spread(df))
    targets = spark.createDataFrame([("A", "ATGGCTGGTTAA"), ("B", "atggctggttaa"), ("C", "ATGTGGGGTTAA"), ("D", None)], "dataset_id string, sequence string")
    asked = [(d, v) for d in "ABCD" for v in ("c.4_6del", "c.-3A>G", None)] * 2
    got = nm.consequence_indels(spark.createDataFrame(asked, "dataset_id string, variant string"), targets).collect()
    assert sizes == [9]
    said = {(r.dataset_id, r.variant): (r["class"], r.pro_key, r.position) for r in got}
    assert len(got) == len(said) == 12
    assert said["A", "c.4_6del"] == said["B", "c.4_6del"] == ("deletion", "p.Ala2del", 2) and said["C", "c.4_6del"] == ("deletion", "p.Trp2del", 2)
    assert {said[d, "c.-3A>G"] for d in "ABCD"} == {("5' UTR", None, None)}
    assert {said["D", "c.4_6del"], *(said[d, None] for d in "ABCD")} == {(None, None, None)}


def test_small_and_large_datasets_fit_the_same_error_model(spark, monkeypatch):
    from assaylake.operators import dimsum as dm

    rng = random.Random(11)
    rows = []
    for d, size in (("A", 90), ("B", 40)):
        for v in range(size):
            effect, n_in = rng.gauss(0, 1), [float(rng.randrange(20, 400)) for _ in range(3)]
            n_out = [float(max(1, int(n * 2.7**effect * rng.uniform(0.6, 1.6)))) for n in n_in]
            rows.append((d, f"p.v{v}", "missense", [effect * (1 + i / 4) + i / 3 + rng.gauss(0, 0.2) for i in range(3)], n_in, n_out, [500.0] * 3, [900.0] * 3))
    arrays = spark.createDataFrame(rows, "dataset_id string, variant string, kind string, f array<double>, n_in array<double>, n_out array<double>, wt_in array<double>, wt_out array<double>")

    def fitted():
        scales = dm.cut(dm.normalise(arrays, 3))
        model = dm.error_model(arrays, scales, 3, bootstrap=10)
        rounded = lambda r: {k: [round(x, 7) for x in v] if isinstance(v, list) else v for k, v in r.asDict().items()}
        return [sorted((rounded(r) for r in df.collect()), key=lambda r: r["dataset_id"]) for df in (scales, model)]

    passes = []
    written = dm.cut
    monkeypatch.setattr(dm, "cut", lambda df: passes.append(1) or written(df))
    small = fitted()
    assert len(passes) < dm.PASSES
    for held in (60, 10):
        monkeypatch.setattr(dm, "HELD", held)
        assert fitted() == small


def test_stretches_order_runs_of_words_not_positions(spark):
    rng = random.Random(2)
    places = {"A": [0, 1, 5, 63, 64, 81, 97, 98, 200], "B": [-70, -64, -1, 0, None], "C": sorted(rng.sample(range(-3000, 3000), 900))}
    rows = spark.createDataFrame([(d, p) for d, ps in places.items() for p in ps * 2], "dataset_id string, position int")
    for gap in (1, 16, 70):
        want = []
        for d, ps in places.items():
            runs = [[p] for p in ps if p is None]
            last = None
            for p in sorted(p for p in ps if p is not None):
                if last is None or p - last > gap:
                    runs.append([])
                runs[-1].append(p)
                last = p
            want += [(d, r[0], r[-1], len(r)) for r in runs]
        got = qc.stretches(rows, gap)
        assert dict(got.dtypes)["start"] == "int"
        assert sorted(map(str, want)) == sorted(str((r.dataset_id, r.start, r.end, r.n)) for r in got.collect())
    plan = qc.stretches(rows)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "lag(position" not in plan


def test_pairs_of_small_and_large_groups_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(d, f"v{i}", f"r{r}", round(rng.gauss(0, 1), 1), rng.randrange(1, 9) / 16, True) for d, n in (("A", 130), ("B", 25), ("C", 2)) for i in range(n) for r in (1, 2, 3)]
    raw = spark.createDataFrame(rows, "dataset_id string, variant string, replicate_id string, y double, v double, usable boolean")
    design = spark.createDataFrame([(d, 3) for d in "ABC"], "dataset_id string, n_replicates int")
    summed = []
    steps = order.value_steps
    monkeypatch.setattr(order, "value_steps", lambda *a, **k: summed.append(1) or steps(*a, **k))
    rounded = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    found = lambda: (rounded(qc.pair_metrics(raw)), rounded(qc.leave_one_replicate_out(raw, design)))
    small = found()
    assert not summed and len(small[0]) == 9
    monkeypatch.setattr(order, "HELD", 30)
    assert found() == small and summed


def test_findings_read_the_reads_once(spark):
    found = QUERIES["q21_findings"].run(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if f.endswith("lineitem.parquet")]


def test_medians_of_small_groups_by_windows(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(20) / 7 if rng.random() < 0.9 else None, rng.choice([1.0, 2.5, float("nan")])) for k, n in (("a", 41), ("b", 30), ("c", 1)) for _ in range(n)] + [("d", None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double").cache()
    got = {r.k: (r.n, r.x, r.y) for r in order.medians(df, ["k"], {"x": "x", "y": "y"}, "n").collect()}
    for c, i in (("x", 1), ("y", 2)):
        want = {r.k: r.m for r in order.median(df, ["k"], c, "m").collect()}
        assert {k: v[i] for k, v in got.items() if v[i] is not None} == want
    assert got["d"] == (0, None, None) and got["a"][0] == sum(1 for k, x, _ in rows if k == "a" and x is not None)
    ranked = order.with_average_rank(df, ["k"], "x").select("k", "x", "rank").distinct()
    mine = df.select("k", "x", order.row_ranks(order.F.col("x"), ["k"]).alias("rank")).where("x IS NOT NULL").distinct()
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, mine.collect()))


def test_position_ranks_write_no_row_per_variant_and_analysis(spark, monkeypatch):
    from assaylake.operators import robustness
    from assaylake.plans import comparisons

    written, cut = [], comparisons.cut
    for module in (comparisons, robustness):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or cut(df))
    assert QUERIES["r6_position_ranks"].run(spark, "/root/testdata/sf0.001").count() > 0
    assert written and not [c for c in written if "variant" in c and "spec_id" in c]


@pytest.mark.parametrize("name", ["a37_diff_p_values", "analysis_default"])
def test_reads_are_scanned_once(spark, monkeypatch, name):
    from pyspark.sql.readwriter import DataFrameWriter

    scans, write = [], DataFrameWriter.parquet
    scanned = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: scans.append(scanned(self._df)) or write(self, path, *a, **k))
    scans.append(scanned(QUERIES[name].run(spark, "/root/testdata/sf0.001")))
    assert sum(scans) == 1


def test_refusals_of_counts_shuffle_no_names(spark):
    from assaylake.operators import analysis
    from assaylake.plans import analyses
    from assaylake.plans.facts import Facts

    plan = analysis.count_refusals(analyses.lab_counts(Facts(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan and "p.=" not in plan


def test_verdicts_of_small_and_large_datasets_agree(spark, monkeypatch):
    from assaylake.operators import robustness
    from assaylake.plans import comparisons

    written, cut = [], comparisons.cut
    for module in (comparisons, robustness):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or cut(df))
    rng = random.Random(6)
    rows = []
    for d, n in (("A", 60), ("B", 25), ("C", 3), ("D", 0)):
        for v, kind in [("p.=", "wild type")] + [(f"p.v{i}", "synonymous" if i % 6 == 0 else "missense") for i in range(n)]:
            for r in ("r1", "r2", "r3"):
                c0, ct = float(rng.choice([0, 1, 3, 12, 40, 90])), float(rng.choice([0, 2, 15, 60]))
                rows.append((d, r, v, kind, 1, None if rng.random() < 0.1 or (d, v, r) == ("B", "p.=", "r2") else c0, None if d == "D" or rng.random() < 0.1 else ct))
    pairs = spark.createDataFrame(rows, "dataset_id string, replicate_id string, variant string, kind string, position int, c0 double, ct double").cache()

    def judged():
        found = robustness.spec_verdicts(pairs, comparisons.SPECS, comparisons.LIMIT, comparisons.calls)
        return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in found.collect())

    small = judged()
    assert len(small) > 60 and not [c for c in written if "variant" in c and "spec_id" in c]
    for held in (100, 0):
        monkeypatch.setattr(robustness, "HELD", held)
        assert judged() == small


def test_verdicts_write_no_row_per_variant_and_analysis(spark, monkeypatch):
    from assaylake.operators import robustness
    from assaylake.plans import comparisons

    written, cut = [], comparisons.cut
    for module in (comparisons, robustness):
        monkeypatch.setattr(module, "cut", lambda df: written.append(df.columns) or cut(df))
    QUERIES["r4_verdicts"].run(spark, "/root/testdata/sf0.001")
    assert written and not [c for c in written if "variant" in c and "spec_id" in c]
