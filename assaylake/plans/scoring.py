"""Queries for pooling, scoring and combining (counts to scores)."""

from pyspark.sql import functions as F

from assaylake.operators import barcodes as bc
from assaylake.operators import bins as bn
from assaylake.operators import combine as cb
from assaylake.operators import filters as fl
from assaylake.operators import ratio as rt
from assaylake.operators import slope as sl
from assaylake.plans.facts import SHARED_SQL, Facts
from assaylake.plans.registry import query

VARIANT_KEYS = ["dataset_id", "variant", "kind", "position", "alt"]

SHARED_SQL.update(
    {
        "lane_counts": "SELECT dataset_id, v, replicate_id, role, lane, sum(cnt) AS cnt FROM reads GROUP BY ALL",
        "synonymous_centre": "SELECT dataset_id, replicate_id, median(ln(ct + 0.5) - ln(c0 + 0.5)) AS centre FROM used WHERE kind = 'synonymous' GROUP BY ALL",
        "time_counts": "SELECT dataset_id, replicate_id, variant, kind, time, sum(cnt) AS cnt FROM reads JOIN names USING (v) GROUP BY ALL",
        "time_library": "SELECT dataset_id, replicate_id, time, sum(cnt) + 0.5 AS r FROM time_counts GROUP BY ALL",
        "time_points": """SELECT t.*, max(t.time) OVER (PARTITION BY t.dataset_id, t.replicate_id) AS tmax, ln(t.cnt + 0.5) - ln(r) AS y,
            1 / (t.cnt + 0.5) + 1 / r AS vv, r FROM time_counts t JOIN time_library USING (dataset_id, replicate_id, time)""",
        "time_ends": "SELECT dataset_id, replicate_id, min(time) AS tfirst, max(time) AS tmax, count(*) AS nt FROM time_library GROUP BY ALL",
        "slope_means": """SELECT dataset_id, replicate_id, variant, kind, count(*) AS n, sum(time / tmax / vv) / sum(1 / vv) AS mx, sum(y / vv) / sum(1 / vv) AS my,
            max(CASE WHEN time = tfirst THEN cnt END) AS first_cnt, max(nt) AS nt
            FROM time_points JOIN (SELECT dataset_id, replicate_id, tfirst, nt FROM time_ends) USING (dataset_id, replicate_id) GROUP BY ALL""",
        "slope_sums": """SELECT dataset_id, replicate_id, m.variant, m.kind, n, mx, my, first_cnt, nt, sum((time / tmax - mx) * (time / tmax - mx) / vv) AS sxx,
            sum((time / tmax - mx) * (y - my) / vv) AS sxy FROM slope_means m JOIN time_points p USING (dataset_id, replicate_id, variant) GROUP BY ALL""",
        "slopes": """SELECT dataset_id, replicate_id, s.variant, s.kind, n, first_cnt, sxy / sxx AS score, my - sxy / sxx * mx AS intercept, sxx, mx,
            CASE WHEN first_cnt IS NOT NULL AND n > 1 AND n < least(3, nt) THEN 'few points' WHEN first_cnt IS NULL OR n < least(3, nt) THEN 'not counted'
            WHEN first_cnt < 1 THEN 'input count' ELSE 'used' END AS state,
            sum((y - (my - sxy / sxx * mx) - sxy / sxx * time / tmax) * (y - (my - sxy / sxx * mx) - sxy / sxx * time / tmax) / vv) AS rss,
            sum((time / tmax - mx) * (time / tmax - mx) / vv) AS counting
            FROM slope_sums s JOIN time_points p USING (dataset_id, replicate_id, variant) WHERE sxx > 0 AND first_cnt IS NOT NULL AND n >= least(3, nt)
            GROUP BY ALL""",
        "bin_counts": "SELECT dataset_id, replicate_id, variant, kind, bin_order, 0.25 * (bin_order + 1) AS value, sum(cnt) AS cnt FROM reads JOIN names USING (v) GROUP BY ALL",
        "bin_sums": "SELECT dataset_id, replicate_id, bin_order, sum(cnt) AS total FROM bin_counts GROUP BY ALL",
        "bin_full": """SELECT c.*, total FROM bin_counts c JOIN bin_sums USING (dataset_id, replicate_id, bin_order)
            JOIN (SELECT dataset_id, replicate_id, variant FROM bin_counts GROUP BY ALL HAVING count(*) = 4) USING (dataset_id, replicate_id, variant)""",
        "bin_means": """SELECT dataset_id, replicate_id, variant, kind, sum(cnt) AS reads, sum(cnt / total) AS frequency,
            CASE WHEN sum(cnt) > 0 THEN sum(value * cnt / total) / sum(cnt / total) END AS score,
            sum((cnt + 0.5) / total) AS f, sum(value * (cnt + 0.5) / total) / sum((cnt + 0.5) / total) AS w FROM bin_full GROUP BY ALL""",
        "bin_scores": """SELECT dataset_id, replicate_id, m.variant, m.kind, reads, frequency, score,
            CASE WHEN score IS NOT NULL THEN sqrt(sum((value - w) * (value - w) * (cnt + 0.5) / (total * total))) / f END AS se,
            CASE WHEN reads < 1 THEN 'input count' WHEN score IS NULL THEN 'not estimable' ELSE 'used' END AS state
            FROM bin_means m JOIN bin_full b USING (dataset_id, replicate_id, variant) GROUP BY dataset_id, replicate_id, m.variant, m.kind, reads, frequency, score, f""",
        "barcode_pairs": """SELECT dataset_id, variant, kind, barcode, replicate_id, sum(CASE WHEN role = 'input' THEN cnt END) AS c0,
            sum(CASE WHEN role = 'output' THEN cnt END) AS ct FROM reads JOIN names USING (v) GROUP BY ALL""",
        "barcode_scores": """SELECT b.*, (ln(ct + 0.5) - ln(rt)) - (ln(c0 + 0.5) - ln(r0)) AS score, sqrt(1 / (c0 + 0.5) + 1 / (ct + 0.5) + 1 / r0 + 1 / rt) AS se
            FROM barcode_pairs b JOIN library USING (dataset_id, replicate_id) WHERE c0 >= 1 AND ct IS NOT NULL""",
        "barcode_sums": "SELECT dataset_id, replicate_id, variant, count(*) AS k, sum(1 / (se * se)) AS sw, sum(score / (se * se)) AS swy FROM barcode_scores GROUP BY ALL",
        "barcode_dev": """SELECT b.dataset_id, b.replicate_id, b.variant, b.barcode, k, CASE WHEN k >= 2 THEN
            (score - (swy - score / (se * se)) / (sw - 1 / (se * se))) / sqrt(se * se + 1 / (sw - 1 / (se * se))) END AS dev
            FROM barcode_scores b JOIN barcode_sums USING (dataset_id, replicate_id, variant)""",
        "anchor_parts": """SELECT dataset_id, median(score) FILTER (kind = 'nonsense') AS m_non, median(score) FILTER (kind = 'synonymous') AS m_syn,
            max(score) FILTER (kind = 'wild type') AS wt, max(se) FILTER (kind = 'wild type') AS se_wt,
            sqrt(pi() / 2 * sum(se * se) FILTER (kind = 'nonsense') / count(*) FILTER (kind = 'nonsense') / count(*) FILTER (kind = 'nonsense')) AS se_non
            FROM cond_score GROUP BY ALL""",
    }
)


def time_rows(t: Facts):
    return Facts.named(t.reads.groupBy("dataset_id", "replicate_id", "v", "time").agg(F.sum("cnt").alias("cnt"))).drop("v", "position", "ref", "alt")


def bin_rows(t: Facts):
    return Facts.named(t.reads.groupBy("dataset_id", "replicate_id", "v", "bin_order").agg(F.sum("cnt").alias("cnt"))).drop("v", "position", "ref", "alt")


def bin_design(t: Facts):
    # Four gates, 0.25 to 1 in value, open at both ends.
    gates = "0, 0.25D, 0D, 100D, 1, 0.5D, 100D, 200D, 2, 0.75D, 200D, 400D, 3, 1D, 400D, CAST(NULL AS DOUBLE)"
    return t.datasets.selectExpr("dataset_id", "explode(array('r1', 'r2', 'r3')) AS replicate_id").selectExpr("*", f"stack(4, {gates}) AS (bin_order, value, gate_lower, gate_upper)")


def barcode_rows(t: Facts):
    sums = t.reads.groupBy("dataset_id", "barcode", "v", "replicate_id").agg(
        F.sum(F.when(F.col("role") == "input", F.col("cnt"))).alias("c0"), F.sum(F.when(F.col("role") == "output", F.col("cnt"))).alias("ct")
    )
    return Facts.named(sums).drop("v", "position", "ref", "alt")


def barcode_scores(t: Facts):
    norms = rt.normalizers(t.pairs, "complete")
    return rt.log_ratio(rt.replicate_state(barcode_rows(t)), norms, "complete")


def used_barcodes(t: Facts):
    return barcode_scores(t).where("state = 'used'")


@query(
    "slice0_scores",
    "dataset_id:s variant:s k:i expected:i score:d se:d reason:s flags:i",
    """SELECT dataset_id, variant, k, expected, score, se, reason, CASE WHEN reason IS NULL THEN f1 + f2 + CASE WHEN k < expected THEN 4 ELSE 0 END ELSE 0 END AS flags FROM (
        SELECT dataset_id, variant, count(*) FILTER (state = 'used') AS k, count(*) AS expected, CASE WHEN count(*) FILTER (state <> 'not counted') = 0 THEN 'measured'
            WHEN count(*) FILTER (state = 'used') = 0 THEN 'input-count' WHEN count(*) FILTER (state = 'used') < 2 THEN 'replicates' END AS reason,
            max(CASE WHEN state = 'used' AND ct = 0 THEN 1 ELSE 0 END) AS f1, max(CASE WHEN state = 'used' AND c0 = 0 THEN 2 ELSE 0 END) AS f2
        FROM rep_score GROUP BY ALL) LEFT JOIN (SELECT dataset_id, variant, CASE WHEN k >= 2 THEN score END AS score, CASE WHEN k >= 2 THEN se END AS se FROM cond_score) USING (dataset_id, variant)""",
)
def slice0_scores(t: Facts):
    return fl.filter_reasons(t.rep_score, ["dataset_id", "variant"], min_replicates=2, combine=True)


@query(
    "a1_pool_technical",
    "dataset_id:s variant:s sample_id:s cnt:d",
    """SELECT dataset_id, variant, concat(replicate_id, '_', role) AS sample_id,
        CASE WHEN replicate_id = 'r3' THEN coalesce(CASE WHEN count(lane) = 3 THEN sum(cnt) END, 0) ELSE CASE WHEN count(lane) = 3 THEN sum(cnt) END END AS cnt
        FROM lane_counts JOIN names USING (v) GROUP BY dataset_id, variant, replicate_id, role
        UNION ALL SELECT dataset_id, variant, concat('r3_', role), 0 FROM (SELECT DISTINCT dataset_id, v FROM lane_counts) q CROSS JOIN (VALUES ('input'), ('output')) x(role) JOIN names USING (v)
        WHERE NOT EXISTS (SELECT 1 FROM lane_counts l WHERE l.dataset_id = q.dataset_id AND l.v = q.v AND l.replicate_id = 'r3' AND l.role = x.role)""",
)
def a1(t: Facts):
    lanes = Facts.named(t.reads.groupBy("dataset_id", "v", "replicate_id", "role", "lane").agg(F.sum("cnt").alias("cnt")))
    lanes = lanes.withColumn("source_column", F.concat_ws("_", "replicate_id", "role", "lane"))
    design = t.datasets.selectExpr(
        "dataset_id", "explode(array('r1', 'r2', 'r3')) AS r").selectExpr("*", "explode(array('input', 'output')) AS role").selectExpr(
        "*", "explode(array('A', 'N', 'R')) AS lane"
    ).selectExpr("dataset_id", "concat(r, '_', role) AS sample_id", "concat(r, '_', role, '_', lane) AS source_column", "r = 'r3' AS missing_means_zero")
    return rt.pool_technical(lanes, design)


@query(
    "a2_replicate_state",
    "dataset_id:s replicate_id:s variant:s c0:d ct:d state:s",
    """SELECT dataset_id, replicate_id, variant, c0, ct, CASE WHEN position BETWEEN 20 AND 24 AND replicate_id = 'r3' THEN 'outside tile' WHEN c0 IS NULL OR ct IS NULL THEN 'not counted'
       WHEN c0 < 20 THEN 'input count' WHEN c0 + ct < 60 THEN 'total count' ELSE 'used' END AS state FROM pairs""",
)
def a2(t: Facts):
    outside = F.col("position").between(20, 24) & (F.col("replicate_id") == "r3")
    return rt.replicate_state(t.pairs, 20, 60, outside_tile=F.coalesce(outside, F.lit(False)))


_NORMS = {
    "wt": "sum(CASE WHEN kind = 'wild type' AND c0 > 0 AND ct > 0 THEN {c} END)",
    "complete": "sum(CASE WHEN c0 IS NOT NULL AND ct IS NOT NULL THEN {c} END)",
    "full": "sum({c})",
}


@query(
    "a3_normalizers",
    "dataset_id:s replicate_id:s method:s r0:d rt:d",
    " UNION ALL ".join(
        f"SELECT dataset_id, replicate_id, '{m}' AS method, {s.format(c='c0')} + 0.5 AS r0, {s.format(c='ct')} + 0.5 AS rt FROM pairs GROUP BY ALL" for m, s in _NORMS.items()
    )
    + " UNION ALL SELECT DISTINCT dataset_id, replicate_id, 'synonymous', 1, 1 FROM pairs",
)
def a3(t: Facts):
    parts = [rt.normalizers(t.pairs, m).withColumn("method", F.lit(m)) for m in ("wt", "complete", "full", "synonymous")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a4_log_ratio", "dataset_id:s replicate_id:s variant:s state:s score:d se:d", "SELECT * FROM rep_score")
def a4(t: Facts):
    return t.rep_score


@query(
    "a4_log_ratio_wild_type",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    """WITH w AS (SELECT dataset_id, replicate_id, c0 + 0.5 AS r0, ct + 0.5 AS rt FROM pairs WHERE kind = 'wild type' AND c0 > 0 AND ct > 0)
       SELECT dataset_id, replicate_id, variant, (ln(ct + 0.5) - ln(rt)) - (ln(c0 + 0.5) - ln(r0)) AS score, sqrt(1 / (c0 + 0.5) + 1 / (ct + 0.5) + 1 / r0 + 1 / rt) AS se
       FROM pairs JOIN w USING (dataset_id, replicate_id) WHERE c0 >= 1 AND ct IS NOT NULL""",
)
def a4_wt(t: Facts):
    norms = rt.normalizers(t.pairs, "wt").where("r0 IS NOT NULL")
    return rt.log_ratio(rt.replicate_state(t.pairs), norms, "wt").where("state = 'used'")


@query(
    "a5_center_synonymous",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    """SELECT dataset_id, replicate_id, variant, ln(ct + 0.5) - ln(c0 + 0.5) - centre AS score, sqrt(1 / (c0 + 0.5) + 1 / (ct + 0.5)) AS se
       FROM used JOIN synonymous_centre USING (dataset_id, replicate_id)""",
)
def a5(t: Facts):
    raw = rt.log_ratio(rt.replicate_state(t.pairs), rt.normalizers(t.pairs, "synonymous"), "synonymous")
    return rt.center_synonymous(raw).where("state = 'used'")


@query(
    "a6_ratio_per_unit",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    "SELECT dataset_id, replicate_id, variant, score / (tmax - tfirst) AS score, se / (tmax - tfirst) AS se FROM used JOIN time_ends USING (dataset_id, replicate_id)",
)
def a6(t: Facts):
    return rt.ratio_per_unit(t.used, t.reads.select("dataset_id", "replicate_id", "time"))


def slopes(t: Facts, **options):
    rows = time_rows(t)
    return sl.slope_scores(rows, sl.time_normalizers(rows, "full"), **options)


_SLOPE_SE = "CASE WHEN n > 2 THEN greatest(sqrt(rss / (n - 2) / sxx), sqrt(counting) / sxx) END"


@query(
    "a7_slopes",
    "dataset_id:s replicate_id:s variant:s state:s points:i score:d intercept:d se:d fit:d",
    f"SELECT dataset_id, replicate_id, variant, state, n AS points, score, intercept, {_SLOPE_SE} AS se, CASE WHEN n > 2 THEN rss / (n - 2) END AS fit FROM slopes",
)
def a7(t: Facts):
    return slopes(t).where("score IS NOT NULL")


@query(
    "a7_slopes_ordinary_per_unit",
    "dataset_id:s replicate_id:s variant:s points:i score:d se:d",
    """SELECT dataset_id, replicate_id, variant, n AS points, regr_slope(y, time) AS score, sqrt(regr_syy(y, time) * (1 - regr_r2(y, time)) / (n - 2) / regr_sxx(y, time)) AS se
       FROM time_points JOIN (SELECT dataset_id, replicate_id, variant, n FROM slopes) USING (dataset_id, replicate_id, variant) GROUP BY dataset_id, replicate_id, variant, n""",
)
def a7_ordinary(t: Facts):
    return slopes(t, weighted=False, per_unit=True, se_method="residual").where("score IS NOT NULL")


@query(
    "a8_time_course",
    "dataset_id:s replicate_id:s variant:s time:d observed:d fitted:d",
    """SELECT dataset_id, replicate_id, variant, time, y AS observed, intercept + score * time / tmax AS fitted
       FROM time_points JOIN (SELECT dataset_id, replicate_id, variant, score, intercept FROM slopes) USING (dataset_id, replicate_id, variant)""",
)
def a8(t: Facts):
    rows = time_rows(t)
    norms = sl.time_normalizers(rows, "full")
    fits = sl.slope_scores(rows, norms).where("score IS NOT NULL")
    return sl.time_course(rows, norms, fits)


def bins(t: Facts):
    return bn.bin_arrays(bin_rows(t), bin_design(t))


@query("a9_bin_average", "dataset_id:s replicate_id:s variant:s state:s reads:d frequency:d score:d se:d", "SELECT * FROM bin_scores")
def a9(t: Facts):
    return bn.bin_average(bins(t))


@query("a10_bin_bootstrap", "dataset_id:s replicate_id:s variant:s score:d se:d se_bootstrap:d")
def a10(t: Facts):
    return bn.bin_bootstrap(bn.bin_average(bins(t)), samples=200)


@query("a11_bin_mle", "dataset_id:s replicate_id:s variant:s score:d se:d sigma:d state:s why:s")
def a11(t: Facts):
    return bn.bin_mle(bins(t))


@query("a11_bin_mle_own_spread", "dataset_id:s replicate_id:s variant:s score:d se:d sigma:d state:s why:s")
def a11_own(t: Facts):
    return bn.bin_mle(bins(t), sigma="per-variant")


@query(
    "a11_effective_counts",
    "dataset_id:s replicate_id:s variant:s bin_order:i eff:d",
    """SELECT dataset_id, replicate_id, variant, bin_order, CASE WHEN p > 0 THEN cnt / total / p * reads ELSE 0 END AS eff FROM bin_full
       JOIN (SELECT dataset_id, replicate_id, variant, sum(cnt / total) AS p, sum(cnt) AS reads FROM bin_full GROUP BY ALL) USING (dataset_id, replicate_id, variant)""",
)
def a11_eff(t: Facts):
    return bn.effective_counts(bins(t)).selectExpr("dataset_id", "replicate_id", "variant", "posexplode(eff) AS (bin_order, eff)")


@query(
    "a12_scale_bins_nonsense",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    """WITH a AS (SELECT dataset_id, replicate_id, median(score) FILTER (kind = 'nonsense') AS zero, max(score) FILTER (kind = 'wild type') AS one FROM bin_scores WHERE state = 'used' GROUP BY ALL)
       SELECT dataset_id, replicate_id, variant, (score - zero) / (one - zero) AS score, se / abs(one - zero) AS se FROM bin_scores JOIN a USING (dataset_id, replicate_id) WHERE one <> zero""",
)
def a12(t: Facts):
    return bn.scale_bins(bn.bin_average(bins(t)), "nonsense-wt")


@query(
    "a12_scale_bins_low5",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, replicate_id ORDER BY score, variant) AS rn, count(*) OVER (PARTITION BY dataset_id, replicate_id) AS n FROM bin_scores WHERE state = 'used'),
       a AS (SELECT dataset_id, replicate_id, median(score) FILTER (rn <= greatest(1, ceil(n * 0.05))) AS zero, max(score) FILTER (kind = 'wild type') AS one FROM o GROUP BY ALL)
       SELECT dataset_id, replicate_id, variant, (score - zero) / (one - zero) AS score, se / abs(one - zero) AS se FROM bin_scores JOIN a USING (dataset_id, replicate_id) WHERE one <> zero""",
)
def a12_low(t: Facts):
    return bn.scale_bins(bn.bin_average(bins(t)), "low5-wt")


@query(
    "a13_sum_barcodes",
    "dataset_id:s variant:s sample_id:s cnt:d n_barcodes:i",
    """SELECT dataset_id, variant, concat(replicate_id, '_', role) AS sample_id, sum(cnt) AS cnt, count(*) AS n_barcodes
       FROM (SELECT dataset_id, variant, barcode, replicate_id, role, sum(cnt) AS cnt FROM reads JOIN names USING (v) GROUP BY ALL) GROUP BY ALL""",
)
def a13(t: Facts):
    rows = Facts.named(t.reads.groupBy("dataset_id", "barcode", "v", "replicate_id", "role").agg(F.sum("cnt").alias("cnt")))
    return bc.sum_barcodes(rows.withColumn("sample_id", F.concat_ws("_", "replicate_id", "role")))


@query(
    "a14_barcode_disagreement",
    "dataset_id:s replicate_id:s variant:s barcode:s k:i dev:d phi:d z:d",
    """WITH p AS (SELECT dataset_id, replicate_id, greatest(1, median(dev * dev) / 0.454936423119572) AS phi FROM barcode_dev WHERE dev IS NOT NULL GROUP BY ALL)
       SELECT dataset_id, replicate_id, variant, barcode, k, dev, phi, CASE WHEN k >= 3 THEN dev / sqrt(phi) END AS z FROM barcode_dev LEFT JOIN p USING (dataset_id, replicate_id)""",
)
def a14(t: Facts):
    return bc.barcode_disagreement(used_barcodes(t))


# One barcode less a step: the state is the list of those left, its totals and the one just taken out.
A15_SQL = """WITH RECURSIVE p AS (SELECT dataset_id, replicate_id, greatest(1, median(dev * dev) / 0.454936423119572) AS phi FROM barcode_dev WHERE dev IS NOT NULL GROUP BY ALL),
    g AS (SELECT b.dataset_id, b.replicate_id, b.variant, list({'b': b.barcode, 'y': score, 'w': 1 / (se * se)} ORDER BY b.barcode) AS m, sqrt(any_value(coalesce(phi, 1))) AS f FROM barcode_scores b LEFT JOIN p USING (dataset_id, replicate_id) GROUP BY ALL),
    s AS (SELECT dataset_id, replicate_id, variant, f, m, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS DOUBLE) AS gone_z FROM g
      UNION ALL SELECT dataset_id, replicate_id, variant, f, list_filter(m, lambda x: x.b <> t.b), t.b, t.z FROM (
        SELECT *, list_sort(list_transform(m, lambda x: {'a': -abs((x.y - (swy - x.w * x.y) / (sw - x.w)) / sqrt(1 / x.w + 1 / (sw - x.w)) / f), 'b': x.b, 'z': (x.y - (swy - x.w * x.y) / (sw - x.w)) / sqrt(1 / x.w + 1 / (sw - x.w)) / f}))[1] AS t
        FROM (SELECT *, list_sum(list_transform(m, lambda x: x.w)) AS sw, list_sum(list_transform(m, lambda x: x.w * x.y)) AS swy FROM s WHERE len(m) >= 3)) WHERE -t.a > 2.0),
    e AS (SELECT dataset_id, replicate_id, variant, f, arg_min(m, len(m)) AS m FROM s GROUP BY ALL),
    t AS (SELECT *, list_sum(list_transform(m, lambda x: x.w)) AS sw, list_sum(list_transform(m, lambda x: x.w * x.y)) AS swy FROM e)
    SELECT dataset_id, replicate_id, variant, gone AS barcode, gone_z AS z, true AS outlier FROM s WHERE gone IS NOT NULL
    UNION ALL SELECT dataset_id, replicate_id, variant, x.b, CASE WHEN n >= 3 THEN (x.y - (swy - x.w * x.y) / (sw - x.w)) / sqrt(1 / x.w + 1 / (sw - x.w)) / f END, false FROM (SELECT dataset_id, replicate_id, variant, f, sw, swy, len(m) AS n, unnest(m) AS x FROM t)"""


@query("a15_barcode_outliers", "dataset_id:s replicate_id:s variant:s barcode:s z:d outlier:b", A15_SQL)
def a15(t: Facts):
    return bc.barcode_outliers(used_barcodes(t), limit=2.0)


@query(
    "a16_combine_barcodes_fixed",
    "dataset_id:s replicate_id:s variant:s k:i score:d se:d",
    "SELECT dataset_id, replicate_id, variant, k, swy / sw AS score, sqrt(1 / sw) AS se FROM barcode_sums",
)
def a16_fixed(t: Facts):
    return bc.combine_barcodes(used_barcodes(t), "fixed")


@query("a16_combine_barcodes_reml", "dataset_id:s replicate_id:s variant:s k:i score:d se:d tau2:d converged:b")
def a16_reml(t: Facts):
    return bc.combine_barcodes(used_barcodes(t), "reml")


@query(
    "a16_barcode_variant_states",
    "dataset_id:s replicate_id:s variant:s measured:i state:s",
    """SELECT dataset_id, replicate_id, variant, m AS measured, CASE WHEN m >= 2 THEN 'used' WHEN m >= 1 THEN 'few barcodes' WHEN i >= 1 THEN 'input count' ELSE 'not counted' END AS state FROM (
       SELECT dataset_id, replicate_id, variant, count(*) FILTER (c0 >= 1 AND ct IS NOT NULL) AS m, count(*) FILTER (c0 < 1 AND ct IS NOT NULL) AS i FROM barcode_pairs GROUP BY ALL)""",
)
def a16_states(t: Facts):
    return bc.variant_states(barcode_scores(t), min_barcodes=2)


@query("a23_combine_fixed", "dataset_id:s variant:s k:i score:d se:d", "SELECT * FROM cond_score")
def a23(t: Facts):
    return t.cond_score


@query(
    "a24_combine_mean",
    "dataset_id:s variant:s k:i score:d se:d",
    "SELECT dataset_id, variant, count(*) AS k, avg(score) AS score, CASE WHEN count(*) = 1 THEN max(se) ELSE stddev_samp(score) / sqrt(count(*)) END AS se FROM used GROUP BY ALL",
)
def a24(t: Facts):
    return cb.combine_mean(t.used, ["dataset_id", "variant"])


@query("a25_combine_reml", "dataset_id:s variant:s k:i score:d se:d tau2:d iterations:i converged:b")
def a25(t: Facts):
    return cb.combine_reml(cb.replicate_arrays(t.used, ["dataset_id", "variant"]))


@query("a26_combine_fifty_updates", "dataset_id:s variant:s k:i score:d se:d tau2:d epsilon:d n_variants:i")
def a26(t: Facts):
    return cb.combine_enrich2(cb.replicate_arrays(t.used, ["dataset_id", "variant"]), ["dataset_id"], F.lit(3))


@query(
    "a26_fifty_updates_start",
    "dataset_id:s n_variants:i",
    "SELECT dataset_id, count(*) AS n_variants FROM cond_score WHERE k = 3 GROUP BY ALL",
)
def a26_start(t: Facts):
    arrays = cb.replicate_arrays(t.used, ["dataset_id", "variant"])
    return arrays.where(F.size("reps") == 3).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_variants"))


@query(
    "a27_heterogeneity",
    "dataset_id:s variant:s q:d i2:d",
    """SELECT dataset_id, variant, CASE WHEN k >= 2 THEN qq END AS q, CASE WHEN k >= 2 THEN CASE WHEN qq > 0 THEN greatest(0, (qq - (k - 1)) / qq) ELSE 0 END END AS i2 FROM (
       SELECT u.dataset_id, u.variant, c.k, sum((u.score - c.score) * (u.score - c.score) / (u.se * u.se)) AS qq FROM used u JOIN cond_score c USING (dataset_id, variant) GROUP BY ALL)""",
)
def a27(t: Facts):
    return cb.heterogeneity(cb.replicate_arrays(t.used, ["dataset_id", "variant"]))


@query(
    "a27_leave_one_out",
    "dataset_id:s variant:s loo:d",
    """SELECT dataset_id, variant, max(CASE WHEN k >= 2 THEN abs((sw * score - sy) / (sw - w) - score) END) AS loo FROM (
       SELECT u.dataset_id, u.variant, c.k, c.score, 1 / (c.se * c.se) AS sw, 1 / (u.se * u.se) AS w, u.score / (u.se * u.se) AS sy FROM used u JOIN cond_score c USING (dataset_id, variant)) GROUP BY ALL""",
)
def a27_loo(t: Facts):
    return cb.leave_one_out(cb.replicate_arrays(t.used, ["dataset_id", "variant"]))


@query("a27_leave_one_out_reml", "dataset_id:s variant:s score:d loo:d loo_replicate:s")
def a27_loo_reml(t: Facts):
    return cb.leave_one_out_reml(cb.combine_reml(cb.replicate_arrays(t.used, ["dataset_id", "variant"])))


_REASONS = """SELECT dataset_id, variant, CASE WHEN count(*) FILTER (state <> 'not counted') = 0 THEN 'measured' WHEN max(kind) = 'nonsense' THEN 'class'
    WHEN max(variant) IN ('p.Arg1Ala', 'p.=') THEN 'excluded' WHEN count(*) FILTER (state = 'used') = 0 THEN 'input-count'
    WHEN count(*) FILTER (state = 'used') < count(*) THEN 'replicates' END AS reason FROM rep_score GROUP BY ALL"""


def reasons(t: Facts):
    rep = t.rep_score
    return fl.filter_reasons(rep, ["dataset_id", "variant", "kind"], exclude_kinds=["nonsense"], exclude=["p.Arg1Ala", "p.="], min_replicates="all")


@query("a32_filter_reasons", "dataset_id:s variant:s reason:s", _REASONS)
def a32(t: Facts):
    return reasons(t)


@query(
    "a32_filter_flow",
    "dataset_id:s stage:s removed:i remaining:i",
    f"""WITH r AS ({_REASONS}), s(stage, no) AS (VALUES ('measured', 0), ('identifier', 1), ('class', 2), ('excluded', 3), ('input-count', 4), ('total-count', 5), ('barcodes', 6), ('replicates', 7), ('se', 8)),
       n AS (SELECT dataset_id, stage, no, (SELECT count(*) FROM r WHERE r.dataset_id = d.dataset_id AND r.reason = s.stage) AS removed FROM (SELECT DISTINCT dataset_id FROM r) d CROSS JOIN s),
       total AS (SELECT dataset_id, count(*) AS m FROM r GROUP BY ALL)
       SELECT dataset_id, stage, removed, m - sum(removed) OVER (PARTITION BY dataset_id ORDER BY no) AS remaining FROM n JOIN total USING (dataset_id)""",
)
def a32_flow(t: Facts):
    return fl.filter_flow(reasons(t))


@query(
    "a33_rescale",
    "dataset_id:s variant:s score:d se:d",
    """SELECT dataset_id, variant, (score - m_non) / (wt - m_non) AS score, se / abs(wt - m_non) AS se FROM cond_score JOIN anchor_parts USING (dataset_id) WHERE wt <> m_non""",
)
def a33(t: Facts):
    return fl.rescale(t.cond_score, "nonsense-wt")


@query(
    "a33_rescale_synonymous",
    "dataset_id:s variant:s score:d se:d",
    """SELECT dataset_id, variant, -(score - m_syn) / (m_non - m_syn) AS score, se / abs(m_non - m_syn) AS se FROM cond_score JOIN anchor_parts USING (dataset_id) WHERE m_syn <> m_non""",
)
def a33_syn(t: Facts):
    return fl.rescale(t.cond_score, "synonymous-nonsense")


@query(
    "a34_anchor_uncertainty",
    "dataset_id:s variant:s se_scale:d",
    """SELECT dataset_id, variant, sqrt(pow((1 - (score - m_non) / (wt - m_non)) * se_non / abs(wt - m_non), 2) + pow((score - m_non) / (wt - m_non) * se_wt / abs(wt - m_non), 2)) AS se_scale
       FROM cond_score JOIN anchor_parts USING (dataset_id) WHERE wt <> m_non""",
)
def a34(t: Facts):
    return fl.rescale(t.cond_score, "nonsense-wt")
