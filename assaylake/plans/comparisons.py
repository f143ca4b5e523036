"""Queries for agreement, comparisons, robustness and run differences."""

from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.operators import agreement as ag
from assaylake.operators import assemble as asm
from assaylake.operators import calibration as cal
from assaylake.operators import combine as cb
from assaylake.operators import compare as cm
from assaylake.operators import robustness as rb
from assaylake.plans.calibrate import controls
from assaylake.plans.facts import SHARED_SQL, Facts
from assaylake.plans.maps import entries, scored
from assaylake.plans.quality import design_grid
from assaylake.plans.registry import query
from assaylake.plans.tables import design, second_scores

SHARED_SQL["matched"] = "SELECT dataset_id, variant, c.kind, c.position, round(c.score, 9) AS a, round(s.score, 9) AS b, c.se AS se_a, s.se AS se_b, c.input FROM cond_score c JOIN second_scores s USING (dataset_id, variant) WHERE c.kind <> 'wild type' AND s.se IS NOT NULL"


def matched(t: Facts):
    b = second_scores(t).where("se IS NOT NULL").select("dataset_id", "variant", F.round("score", 9).alias("b"), F.col("se").alias("se_b"))
    return t.cond_score.where("kind <> 'wild type'").withColumn("a", F.round("score", 9)).withColumnRenamed("se", "se_a").join(b, ["dataset_id", "variant"])


@query(
    "c1_pearson_ci",
    "dataset_id:s n:i r:d r_low:d r_high:d",
    "SELECT dataset_id, n, r, tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS r_low, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS r_high FROM (SELECT dataset_id, count(*) AS n, corr(a, b) AS r FROM matched GROUP BY ALL)",
)
def c1(t: Facts):
    return ag.pearson_ci(matched(t), ["dataset_id"])


@query(
    "c2_spearman_ci",
    "dataset_id:s n:i r:d r_low:d r_high:d",
    """SELECT dataset_id, n, r, tanh(atanh(r) - 1.959963984540054 * sqrt((1 + r * r / 2) / (n - 3))) AS r_low, tanh(atanh(r) + 1.959963984540054 * sqrt((1 + r * r / 2) / (n - 3))) AS r_high FROM (SELECT dataset_id, count(*) AS n, corr(ra, rb) AS r FROM (
       SELECT dataset_id, rank() OVER (PARTITION BY dataset_id ORDER BY a) + (count(*) OVER (PARTITION BY dataset_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY dataset_id ORDER BY b) + (count(*) OVER (PARTITION BY dataset_id, b) - 1) / 2 AS rb FROM matched) GROUP BY ALL)""",
)
def c2(t: Facts):
    return ag.spearman_ci(cut(matched(t).select("dataset_id", "a", "b")), ["dataset_id"])


@query(
    "c3_concordance",
    "dataset_id:s n:i ccc:d accuracy:d scale_shift:d location_shift:d",
    """SELECT dataset_id, n, ccc, ccc / r AS accuracy, sqrt(vb / va) AS scale_shift, (mb - ma) / sqrt(sqrt(va * vb)) AS location_shift FROM (SELECT *, 2 * cab / (va + vb + (ma - mb) * (ma - mb)) AS ccc, cab / sqrt(va * vb) AS r FROM (
       SELECT dataset_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab FROM matched GROUP BY ALL))""",
)
def c3(t: Facts):
    return ag.lin_ccc(matched(t), ["dataset_id"])


@query(
    "c4_bland_altman",
    "dataset_id:s n:i bias:d sd:d lower:d upper:d limit_se:d slope:d intercept:d slope_se:d",
    """SELECT *, bias - 1.96 * sd AS lower, bias + 1.96 * sd AS upper, sqrt(3 * sd * sd / n) AS limit_se, sqrt(greatest(0, syy - slope * slope * sxx) / (n - 2) / sxx) AS slope_se FROM (SELECT dataset_id, count(*) AS n, avg(a - b) AS bias, stddev_samp(a - b) AS sd,
       regr_slope(a - b, (a + b) / 2) AS slope, regr_intercept(a - b, (a + b) / 2) AS intercept, regr_sxx(a - b, (a + b) / 2) AS sxx, regr_syy(a - b, (a + b) / 2) AS syy FROM matched GROUP BY ALL)""",
)
def c4(t: Facts):
    return ag.bland_altman(matched(t), ["dataset_id"])


@query("c4_bland_altman_intervals", "dataset_id:s bias_low:d bias_high:d lower_low:d upper_high:d slope_low:d slope_high:d slope_p:d")
def c4_intervals(t: Facts):
    return ag.bland_altman_intervals(ag.bland_altman(matched(t), ["dataset_id"]))


@query(
    "c5_auc_delong",
    "dataset_id:s n1:i n2:i auc:d auc_se:d",
    """WITH x AS (SELECT dataset_id, b AS s, kind = 'missense' AS f FROM matched WHERE kind IN ('missense', 'nonsense')), t AS (SELECT dataset_id, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM x GROUP BY ALL),
       p AS (SELECT p.dataset_id, p.f, p.s, avg(CASE WHEN (CASE WHEN p.f THEN p.s > q.s ELSE p.s < q.s END) THEN 1 WHEN p.s = q.s THEN 0.5 ELSE 0 END) AS w, row_number() OVER () AS i FROM (SELECT *, row_number() OVER () AS id FROM x) p JOIN x q ON p.dataset_id = q.dataset_id AND p.f <> q.f GROUP BY p.dataset_id, p.f, p.s, p.id)
       SELECT dataset_id, n1, n2, avg(w) FILTER (f) AS auc, sqrt(var_samp(w) FILTER (f) / n1 + var_samp(w) FILTER (NOT f) / n2) AS auc_se FROM p JOIN t USING (dataset_id) GROUP BY dataset_id, n1, n2""",
)
def c5(t: Facts):
    return ag.auc_delong(matched(t).where("kind IN ('missense', 'nonsense')"), ["dataset_id"], "b", F.col("kind") == "missense")


@query("c7_compare_filter", "dataset_id:s variant:s keep:b", "SELECT dataset_id, variant, coalesce(se <= 0.4 AND input >= 60, false) AS keep FROM cond_score")
def c7(t: Facts):
    return cm.compare_filter(t.cond_score, max_se=0.4, min_input=60)


@query(
    "c8_anchor_scale",
    "dataset_id:s variant:s score:d se:d anchor_var:d",
    """SELECT dataset_id, variant, (score - m_non) / (wt - m_non) AS score, se / abs(wt - m_non) AS se, pow((1 - (score - m_non) / (wt - m_non)) * se_non / abs(wt - m_non), 2) + pow((score - m_non) / (wt - m_non) * se_wt / abs(wt - m_non), 2) AS anchor_var
       FROM cond_score JOIN anchor_parts USING (dataset_id) WHERE wt <> m_non""",
)
def c8(t: Facts):
    return cm.anchor_scale(t.cond_score, "nonsense-wt")


def discordances(t: Facts):
    return cm.discordance(matched(t).withColumnsRenamed({"a": "score_a", "b": "score_b"}).drop("score"))


SHARED_SQL["discord"] = "SELECT dataset_id, variant, position, a - b AS diff, se_a * se_a + se_b * se_b AS var, CASE WHEN se_a * se_a + se_b * se_b > 0 THEN (a - b) / sqrt(se_a * se_a + se_b * se_b) END AS z FROM matched"


@query("c9_discordance", "dataset_id:s tested:i dispersion:d", "SELECT dataset_id, count(z) AS tested, median(z * z) / 0.454936423119572 AS dispersion FROM discord GROUP BY ALL")
def c9(t: Facts):
    return cm.dispersion(discordances(t))


@query("c9_discordant_variants", "dataset_id:s variant:s z:d p:d q:d discordant:b")
def c9_variants(t: Facts):
    return cm.discordant(discordances(t))


@query(
    "c10_position_disagreement",
    "dataset_id:s position:i n:i mean:d rms:d z:d",
    "SELECT dataset_id, position, count(*) AS n, avg(diff) AS mean, sqrt(avg(diff * diff)) AS rms, CASE WHEN count(*) >= 3 AND sum(var) > 0 THEN sum(diff) / sqrt(sum(var)) END AS z FROM discord WHERE position IS NOT NULL GROUP BY ALL",
)
def c10(t: Facts):
    return cm.position_disagreement(discordances(t))


@query(
    "c11_by_predictor_class",
    "dataset_id:s cls:s n:i low:d median:d high:d",
    "SELECT dataset_id, cls, count(*) AS n, quantile_cont(score, 0.25) AS low, median(score) AS median, quantile_cont(score, 0.75) AS high FROM cond_score JOIN (SELECT dataset_id, key AS variant, cls FROM entries) USING (dataset_id, variant) WHERE cls IS NOT NULL GROUP BY ALL",
)
def c11(t: Facts):
    cls = entries(t).select("dataset_id", F.col("key").alias("variant"), "cls")
    return cm.by_predictor_class(cut(t.cond_score.join(cls, ["dataset_id", "variant"])))


@query(
    "c12_difference_map",
    "dataset_id:s position:i alt:s state:s value:d",
    """SELECT g.dataset_id, g.position, g.alt, CASE WHEN g.alt = g.ref_aa THEN 'reference' WHEN a.score IS NULL THEN 'missing' WHEN b.score IS NULL THEN 'filtered' ELSE 'scored' END AS state, a.score - b.score AS value FROM grid g
       LEFT JOIN cond_score a ON a.dataset_id = g.dataset_id AND a.position = g.position AND a.alt = g.alt LEFT JOIN second_scores b ON b.dataset_id = g.dataset_id AND b.position = g.position AND b.alt = g.alt""",
)
def c12(t: Facts):
    return cm.difference_map(design_grid(t), t.cond_score, second_scores(t))


# --- Robustness ----------------------------------------------------------------------------------------

CHOICES = {"pseudocount": [0.5, 0.1, 1.0], "normalization": ["complete", "full", "wt", "synonymous"], "combination": ["fixed", "mean"], "min_input": [1.0, 10.0], "leave_out": [None, "r1", "r2", "r3"]}
SPECS = rb.specifications(CHOICES)
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
SHARED_SQL["specs"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_lit(s.get(c)) for c in rb.SPEC_TYPES) + ")" for s in SPECS) + ") x(" + ", ".join("spec_kind" if c == "kind" else c for c in rb.SPEC_TYPES) + ")"
SHARED_SQL["spec_library"] = """SELECT dataset_id, replicate_id, sum(CASE WHEN ct IS NOT NULL THEN c0 END) AS lc0, sum(CASE WHEN c0 IS NOT NULL THEN ct END) AS lct, sum(c0) AS f0, sum(ct) AS ft, max(CASE WHEN kind = 'wild type' THEN c0 END) AS w0, max(CASE WHEN kind = 'wild type' THEN ct END) AS wt FROM pairs GROUP BY ALL"""
SHARED_SQL["spec_rows"] = """SELECT *, (ln(ct + pseudocount) - ln(rr)) - (ln(c0 + pseudocount) - ln(r)) AS y0, 1 / (c0 + pseudocount) + 1 / (ct + pseudocount) + CASE WHEN normalization = 'synonymous' THEN 0 ELSE 1 / r + 1 / rr END AS vv FROM (
    SELECT *, CASE normalization WHEN 'complete' THEN lc0 + pseudocount WHEN 'full' THEN f0 + pseudocount WHEN 'wt' THEN w0 + pseudocount ELSE 1 END AS r, CASE normalization WHEN 'complete' THEN lct + pseudocount WHEN 'full' THEN ft + pseudocount WHEN 'wt' THEN wt + pseudocount ELSE 1 END AS rr
    FROM pairs JOIN spec_library USING (dataset_id, replicate_id) CROSS JOIN specs WHERE c0 >= min_input AND ct IS NOT NULL AND (leave_out IS NULL OR leave_out <> replicate_id))"""
SHARED_SQL["spec_centred"] = "SELECT s.*, y0 - coalesce(m, 0) AS y FROM spec_rows s LEFT JOIN (SELECT dataset_id, replicate_id, spec_id, median(y0) AS m FROM spec_rows WHERE normalization = 'synonymous' AND kind = 'synonymous' GROUP BY ALL) USING (dataset_id, replicate_id, spec_id)"
SHARED_SQL["spec_scores"] = """SELECT dataset_id, variant, kind, position, spec_id, spec_kind, choice, count(*) AS k, CASE WHEN max(combination) = 'fixed' THEN sum(y / vv) / sum(1 / vv) ELSE avg(y) END AS score,
    CASE WHEN max(combination) = 'fixed' THEN sqrt(1 / sum(1 / vv)) WHEN count(*) = 1 THEN sqrt(max(vv)) ELSE stddev_samp(y) / sqrt(count(*)) END AS se FROM spec_centred GROUP BY ALL"""
SHARED_SQL["calls"] = """SELECT s.*, score - coalesce(w, 0) AS effect, CASE WHEN se > 0 AND round((score - coalesce(w, 0)) / se, 6) < -2.5 THEN 'lower' WHEN se > 0 AND round((score - coalesce(w, 0)) / se, 6) > 2.5 THEN 'higher' ELSE 'like' END AS call FROM spec_scores s LEFT JOIN (SELECT dataset_id, spec_id, score AS w FROM spec_scores WHERE kind = 'wild type') USING (dataset_id, spec_id)"""
SHARED_SQL["moves"] = """SELECT d.dataset_id, d.variant, d.call AS call_0, d.effect AS effect_0, d.se AS se_0, p.spec_id, p.spec_kind, p.choice, c.call, c.effect, c.se, CASE WHEN d.se > 0 THEN round((c.effect - d.effect) / d.se, 9) END AS z
    FROM (SELECT * FROM calls WHERE spec_kind = 'declared') d JOIN (SELECT DISTINCT dataset_id, spec_id, spec_kind, choice FROM calls) p ON p.dataset_id = d.dataset_id LEFT JOIN calls c ON c.dataset_id = d.dataset_id AND c.variant = d.variant AND c.spec_id = p.spec_id"""
SHARED_SQL["moved_rows"] = """SELECT m.*, coalesce(abs(z) > 1.959963984540054 AND abs(z - center) > 5 * 1.482602218505602 * spread, false) AS moved FROM moves m LEFT JOIN (SELECT dataset_id, spec_id, center, median(abs(z - center)) AS spread FROM moves JOIN (SELECT dataset_id, spec_id, median(z) AS center FROM moves GROUP BY ALL) USING (dataset_id, spec_id) GROUP BY ALL) USING (dataset_id, spec_id)"""


#: Standard errors from the wild type beyond which a call is not "like".
LIMIT = 2.5


def calls(pairs, specs=SPECS):
    scores = cut(rb.run_specs(pairs, specs))
    wt = scores.where("kind = 'wild type'").select("dataset_id", "spec_id", F.col("score").alias("__w"))
    out = scores.join(wt, ["dataset_id", "spec_id"], "left").withColumn("effect", F.col("score") - F.coalesce("__w", F.lit(0.0)))
    z = F.when(F.col("se") > 0, F.round(F.col("effect") / F.col("se"), 6))
    return out.withColumn("call", F.when(z < -LIMIT, "lower").when(z > LIMIT, "higher").otherwise("like"))


def moved(t: Facts, specs=SPECS):
    return cut(rb.moves(cut(calls(cut(t.pairs), specs))))


# An analysis is judged against the declared one and its own moves alone: what reads single alternatives needs no combinations.
SINGLE = [s for s in SPECS if s["kind"] != "combined"]


@query("r2_run_specs", "dataset_id:s variant:s spec_id:i spec_kind:s k:i score:d se:d", "SELECT * FROM spec_scores")
def r2(t: Facts):
    return rb.run_specs(t.pairs, SPECS)


# REML and the least number of replicates, each replicate left out in turn: two replicates have a closed form.
MORE_CHOICES = {"pseudocount": [0.5], "normalization": ["complete", "synonymous"], "combination": ["reml"], "min_input": [1.0], "leave_out": ["r1", "r2", "r3"], "min_replicates": [1, 2]}
MORE_SPECS = rb.specifications(MORE_CHOICES)
MORE_SQL = "(VALUES " + ", ".join("(" + ", ".join(_lit(s.get(c)) for c in rb.SPEC_TYPES) + ")" for s in MORE_SPECS) + ") x(" + ", ".join("spec_kind" if c == "kind" else c for c in rb.SPEC_TYPES) + ")"
SHARED_SQL["more_rows"] = f"""SELECT *, ln(ct + pseudocount) - ln(c0 + pseudocount) - CASE normalization WHEN 'complete' THEN ln(lct + pseudocount) - ln(lc0 + pseudocount) ELSE 0 END AS y0,
    1 / (c0 + pseudocount) + 1 / (ct + pseudocount) + CASE normalization WHEN 'complete' THEN 1 / (lc0 + pseudocount) + 1 / (lct + pseudocount) ELSE 0 END AS v
    FROM pairs JOIN spec_library USING (dataset_id, replicate_id) CROSS JOIN (SELECT * FROM {MORE_SQL}) WHERE c0 >= min_input AND ct IS NOT NULL AND leave_out <> replicate_id"""
SHARED_SQL["more_centred"] = """SELECT m.*, y0 - coalesce(c, 0) AS y FROM more_rows m LEFT JOIN (SELECT dataset_id, replicate_id, spec_id, median(y0) AS c FROM more_rows WHERE normalization = 'synonymous' AND kind = 'synonymous' GROUP BY ALL) USING (dataset_id, replicate_id, spec_id)"""


@query(
    "r2_run_specs_reml",
    "dataset_id:s variant:s spec_id:i spec_kind:s k:i score:d se:d",
    """SELECT dataset_id, variant, spec_id, spec_kind, k, CASE WHEN k >= min_replicates THEN score END AS score, CASE WHEN k >= min_replicates THEN se END AS se FROM (
       SELECT dataset_id, variant, spec_id, spec_kind, min_replicates, any_value(k) AS k, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS score, sqrt(1 / sum(1 / (v + tau2))) AS se
       FROM more_centred JOIN (SELECT dataset_id, variant, spec_id, count(*) AS k, CASE WHEN count(*) = 2 THEN greatest(0, (pow(max(y) - min(y), 2) - sum(v)) / 2) ELSE 0 END AS tau2 FROM more_centred GROUP BY ALL) USING (dataset_id, variant, spec_id) GROUP BY ALL)""",
)
def r2_reml(t: Facts):
    return rb.run_specs(t.pairs, MORE_SPECS)


@query(
    "r3_replicate_dispersion",
    "dataset_id:s n:i dispersion:d",
    "SELECT dataset_id, count(*) AS n, median(q / ((k - 1) * pow(1 - 2 / (9 * (k - 1)), 3))) AS dispersion FROM (SELECT u.dataset_id, u.variant, c.k, sum((u.score - c.score) * (u.score - c.score) / (u.se * u.se)) AS q FROM used u JOIN cond_score c USING (dataset_id, variant) WHERE c.k >= 2 GROUP BY ALL) GROUP BY ALL",
)
def r3(t: Facts):
    return rb.replicate_dispersion(cb.heterogeneity(cb.replicate_arrays(t.used, ["dataset_id", "variant"])).withColumn("k", F.size("reps")))


@query(
    "r4_verdicts",
    "dataset_id:s variant:s call_0:s verdict:s scored_in:i agree:i effect_min:d effect_max:d",
    """SELECT dataset_id, variant, call_0, ['fragile', 'uncertain', 'borderline', 'size', 'inclusion', 'robust'][min(r)] AS verdict, count(call) AS scored_in, count(*) FILTER (call = call_0) AS agree, min(effect) AS effect_min, max(effect) AS effect_max FROM (
       SELECT *, CASE WHEN call <> call_0 THEN CASE WHEN moved THEN 1 WHEN se / se_0 > 1.5 OR se / se_0 < 1 / 1.5 THEN 2 ELSE 3 END WHEN call IS NULL THEN 5 WHEN spec_kind = 'single' AND moved THEN 4 ELSE 6 END AS r FROM moved_rows) GROUP BY ALL""",
)
def r4(t: Facts):
    return rb.spec_verdicts(cut(t.pairs), SPECS, LIMIT, calls)


@query(
    "r5_by_choice",
    "dataset_id:s spec_id:i choice:s compared:i changed:i lowered:i raised:i dropped:i moved:i",
    """SELECT dataset_id, spec_id, choice, count(call) AS compared, count(*) FILTER (call <> call_0) AS changed, count(*) FILTER (call <> call_0 AND call = 'lower') AS lowered, count(*) FILTER (call <> call_0 AND call = 'higher') AS raised, count(*) FILTER (call IS NULL) AS dropped,
       count(*) FILTER (moved) AS moved FROM moved_rows WHERE spec_kind = 'single' GROUP BY ALL""",
)
def r5(t: Facts):
    return rb.by_choice(moved(t, SINGLE))


_RANK = "rank() OVER (PARTITION BY dataset_id, spec_id ORDER BY {c}) + (count(*) OVER (PARTITION BY dataset_id, spec_id, {c}) - 1) / 2"


@query(
    "r5_choice_correlation",
    "dataset_id:s spec_id:i n:i r:d",
    f"""SELECT dataset_id, spec_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS r FROM (SELECT dataset_id, spec_id, {_RANK.format(c="effect_0")} AS a, {_RANK.format(c="effect")} AS b FROM moved_rows WHERE spec_kind = 'single' AND call IS NOT NULL) GROUP BY ALL""",
)
def r5_rho(t: Facts):
    return rb.choice_correlation(moved(t, SINGLE))


@query(
    "r6_position_ranks",
    "dataset_id:s position:i effect:d rank:d rank_min:d rank_max:d least_in:i analyses:i least_declared:b",
    """WITH m AS (SELECT dataset_id, spec_id, spec_kind, position, round(median(effect), 9) AS m FROM calls WHERE position IS NOT NULL AND kind NOT IN ('wild type', 'synonymous') GROUP BY ALL),
       r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dataset_id, spec_id) AS n FROM m WINDOW w AS (PARTITION BY dataset_id, spec_id ORDER BY m, position)), p AS (SELECT *, i / (n - 1) AS rk, i < greatest(1, round(0.1 * n)) AS least FROM r)
       SELECT dataset_id, position, max(m) FILTER (spec_kind = 'declared') AS effect, max(rk) FILTER (spec_kind = 'declared') AS rank, min(rk) AS rank_min, max(rk) AS rank_max, count(*) FILTER (least) AS least_in, count(*) AS analyses, bool_or(least) FILTER (spec_kind = 'declared') AS least_declared FROM p GROUP BY ALL""",
)
def r6(t: Facts):
    return rb.position_ranks(rb.position_effects(rb.run_specs(cut(t.pairs), SPECS)))


# --- Two runs: the declared analysis against wild-type normalisation with more input ------------------

OTHER = next(s["spec_id"] for s in SPECS if s["kind"] == "combined")
SHARED_SQL["run_pairs"] = f"""SELECT *, coalesce(abs(z) > 1.959963984540054, false) AS moved, coalesce(call_a <> call_b, false) AS crossed FROM (SELECT dataset_id, variant, a.call AS call_a, b.call AS call_b, a.effect AS effect_a, b.effect AS effect_b, CASE WHEN a.se > 0 THEN (b.effect - a.effect) / a.se END AS z
    FROM (SELECT * FROM calls WHERE spec_id = 0) a FULL JOIN (SELECT * FROM calls WHERE spec_id = {OTHER}) b USING (dataset_id, variant))"""


def runs(t: Facts):
    two = [SPECS[0], SPECS[OTHER]]
    scores = cut(rb.run_specs(t.pairs, two))
    wt = scores.where("kind = 'wild type'").select("dataset_id", "spec_id", F.col("score").alias("__w"))
    out = scores.join(wt, ["dataset_id", "spec_id"], "left").withColumn("effect", F.col("score") - F.coalesce("__w", F.lit(0.0)))
    z = F.when(F.col("se") > 0, F.round(F.col("effect") / F.col("se"), 6))
    out = cut(out.withColumn("call", F.when(z < -2.5, "lower").when(z > 2.5, "higher").otherwise("like")))
    return cm.join_runs(out.where("spec_id = 0"), out.where(f"spec_id = {OTHER}"))


@query(
    "d1_diff_runs",
    "dataset_id:s in_both:i moved:i crossed:i filtered:i scored:i",
    "SELECT dataset_id, count(*) FILTER (call_a IS NOT NULL AND call_b IS NOT NULL) AS in_both, count(*) FILTER (moved) AS moved, count(*) FILTER (crossed) AS crossed, count(*) FILTER (call_b IS NULL) AS filtered, count(*) FILTER (call_a IS NULL) AS scored FROM run_pairs GROUP BY ALL",
)
def d1(t: Facts):
    return cm.diff_runs(runs(t)).withColumnRenamed("both", "in_both")


@query(
    "d1_largest_changes",
    "dataset_id:s variant:s place:i z:d",
    "SELECT * FROM (SELECT dataset_id, variant, z, row_number() OVER (PARTITION BY dataset_id ORDER BY round(abs(coalesce(z, 0)), 9) DESC, variant) AS place FROM run_pairs WHERE moved OR crossed) WHERE place <= 25",
)
def d1_top(t: Facts):
    return cm.largest_changes(runs(t))


@query("d2_crossings", "dataset_id:s from_call:s to_call:s n:i", "SELECT dataset_id, call_a AS from_call, call_b AS to_call, count(*) AS n FROM run_pairs WHERE crossed GROUP BY ALL")
def d2(t: Facts):
    return cm.crossings(runs(t))


@query(
    "d3_change_map",
    "dataset_id:s variant:s position:i change:d",
    "SELECT dataset_id, variant, position, effect_b - effect_a AS change FROM (SELECT dataset_id, variant, position FROM cond_score) LEFT JOIN run_pairs USING (dataset_id, variant)",
)
def d3(t: Facts):
    return cm.change_map(runs(t), t.cond_score.select("dataset_id", "variant", "position"))


@query(
    "d4_finding_changes",
    "dataset_id:s finding:s before:s after:s",
    """SELECT * FROM (SELECT dataset_id, replicate_id AS finding, CASE WHEN m < 36.2 THEN 'fail' WHEN m < 36.6 THEN 'review' ELSE 'pass' END AS before, CASE WHEN m < 36.4 THEN 'fail' ELSE 'pass' END AS after FROM (SELECT dataset_id, replicate_id, avg(c0) AS m FROM pairs GROUP BY ALL)) WHERE before <> after""",
)
def d4(t: Facts):
    m = t.pairs.groupBy("dataset_id", F.col("replicate_id").alias("finding")).agg(F.avg("c0").alias("m"))
    a = m.withColumn("status", F.when(F.col("m") < 36.2, "fail").when(F.col("m") < 36.6, "review").otherwise("pass"))
    b = m.withColumn("status", F.when(F.col("m") < 36.4, "fail").otherwise("pass"))
    return cm.finding_changes(a, b)


@query(
    "d5_row_changes",
    "dataset_id:s replicate_id:s change:s columns:s",
    """SELECT dataset_id, replicate_id, CASE WHEN replicate_id LIKE 'base-r1' THEN 'added' WHEN replicate_id = 'drug-r3' THEN 'removed' ELSE 'changed' END AS change, CASE WHEN replicate_id = 'base-r2' THEN 'tile' END AS columns FROM (SELECT DISTINCT dataset_id, replicate_id FROM design) WHERE replicate_id IN ('base-r1', 'base-r2', 'drug-r3')""",
)
def d5(t: Facts):
    rows = design(t).where("role = 'input'").select("dataset_id", "replicate_id", "tile", "biological")
    before = rows.where("replicate_id <> 'base-r1'")
    after = rows.where("replicate_id <> 'drug-r3'").withColumn("tile", F.when(F.col("replicate_id") == "base-r2", "Z").otherwise(F.col("tile")))
    return cm.row_changes(before, after, ["dataset_id", "replicate_id"])


SHARED_SQL["rescored"] = "SELECT *, CASE WHEN toxic = 1 THEN score * 0.5 ELSE score END AS again FROM controls"


@query(
    "d6_calibration_changes",
    "set_id:s auc_before:d auc_after:d",
    """SELECT p.set_id, avg(CASE WHEN p.score < b.score THEN 1 WHEN p.score = b.score THEN 0.5 ELSE 0 END) AS auc_before, avg(CASE WHEN p.again < b.again THEN 1 WHEN p.again = b.again THEN 0.5 ELSE 0 END) AS auc_after FROM rescored p JOIN rescored b ON p.set_id = b.set_id AND p.side = 'P' AND b.side = 'B' GROUP BY ALL""",
)
def d6(t: Facts):
    rows = controls(t)
    again = rows.withColumn("score", F.when(F.col("toxic") == 1, F.col("score") * 0.5).otherwise(F.col("score")))
    before, after = (cal.areas(cal.control_steps(x)) for x in (rows, again))
    return before.select("set_id", F.col("auc").alias("auc_before")).join(after.select("set_id", F.col("auc").alias("auc_after")), "set_id")


@query("d7_run_digest", "dataset_id:s run_id:s digest:s n:i")
def d7(t: Facts):
    return cm.run_digest(t.cond_score, {"model": "ratio", "normalization": "complete", "combination": "fixed"})
