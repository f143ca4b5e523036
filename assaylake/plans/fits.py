"""Queries for error models, moderated combination, differences and published scores."""

import numpy as np
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.operators import differential as df_
from assaylake.operators import dimsum as dm
from assaylake.operators import moderate as md
from assaylake.operators import published as pb
from assaylake.operators import ratio as rt
from assaylake.operators.combine import combine_fixed
from assaylake.plans.facts import SHARED_SQL, Facts
from assaylake.plans.registry import query
from assaylake.plans.tables import design

BY = ["dataset_id"]
REPS = ["r1", "r2", "r3"]

SHARED_SQL.update(
    {
        "fit_of": """SELECT p.*, wi, wo, CASE WHEN c0 > 0 AND ct > 0 THEN ln(ct / c0) - ln(wo / wi) END AS fitness FROM pairs p JOIN (SELECT dataset_id, replicate_id, c0 AS wi, ct AS wo FROM pairs WHERE kind = 'wild type' AND c0 > 0 AND ct > 0) USING (dataset_id, replicate_id)""",
        "cond_pairs": """SELECT dataset_id, condition, variant, kind, replicate_id, i.c0, sum(cnt) AS ct FROM reads JOIN names USING (v) JOIN (SELECT dataset_id, v, replicate_id, sum(cnt) AS c0 FROM reads WHERE role = 'input' GROUP BY ALL) i USING (dataset_id, v, replicate_id) WHERE role = 'output' GROUP BY ALL""",
        "cond_norms": "SELECT dataset_id, condition, replicate_id, sum(ct) + 0.5 AS rt FROM cond_pairs GROUP BY ALL",
        "input_norms": "SELECT dataset_id, replicate_id, sum(cnt) + 0.5 AS r0 FROM reads WHERE role = 'input' GROUP BY ALL",
        "cond_reps": """SELECT *, (ln(ct + 0.5) - ln(rt)) - (ln(c0 + 0.5) - ln(r0)) AS score, sqrt(1 / (c0 + 0.5) + 1 / (ct + 0.5) + 1 / r0 + 1 / rt) AS se FROM cond_pairs JOIN cond_norms USING (dataset_id, condition, replicate_id) JOIN input_norms USING (dataset_id, replicate_id) WHERE c0 >= 1""",
        "two_conditions": "SELECT dataset_id, condition, variant, count(*) AS k, sum(score / (se * se)) / sum(1 / (se * se)) AS score, sqrt(1 / sum(1 / (se * se))) AS se FROM cond_reps GROUP BY ALL",
    }
)


def measurements(t: Facts):
    return t.used.select("dataset_id", "variant", "replicate_id", F.col("score").alias("y"), (F.col("se") * F.col("se")).alias("v"), ((F.col("c0") >= 5) & (F.col("ct") >= 5)).alias("informative"))


def condition_reps(t: Facts):
    from assaylake.plans.facts import Facts as _F

    # Reads are summed once: an input has no condition, a NULL one of its own.
    sums = cut(t.reads.groupBy("dataset_id", "v", "replicate_id", "role", F.when(F.col("role") == "output", F.col("condition")).alias("condition")).agg(F.sum("cnt").alias("cnt")))
    inputs = sums.where("role = 'input'").select("dataset_id", "v", "replicate_id", F.col("cnt").alias("c0"))
    outputs = sums.where("role = 'output'").select("dataset_id", "v", "replicate_id", "condition", F.col("cnt").alias("ct"))
    pairs = cut(_F.named(outputs.join(inputs, ["dataset_id", "v", "replicate_id"])).drop("v", "ref"))
    r0 = inputs.groupBy("dataset_id", "replicate_id").agg((F.sum("c0") + 0.5).alias("r0"))
    rT = pairs.groupBy("dataset_id", "condition", "replicate_id").agg((F.sum("ct") + 0.5).alias("rt"))
    norms = rT.join(r0, ["dataset_id", "replicate_id"])
    return rt.log_ratio(rt.replicate_state(pairs), norms, "full", by=("dataset_id", "condition", "replicate_id"))


def two_conditions(t: Facts):
    return cut(combine_fixed(condition_reps(t).where("state = 'used'"), ["dataset_id", "condition", "variant"]))


@query("a17_dimsum_fitness", "dataset_id:s replicate_id:s variant:s fitness:d", "SELECT * FROM fit_of")
def a17(t: Facts):
    return dm.fitness(t.pairs)


@query(
    "a18_dimsum_threshold",
    "dataset_id:s threshold:d",
    "SELECT dataset_id, exp(-quantile_cont(ln(ct / c0), 0.01)) AS threshold FROM pairs JOIN (SELECT dataset_id, variant FROM pairs WHERE c0 > 0 AND ct > 0 GROUP BY ALL HAVING count(*) = 3) USING (dataset_id, variant) GROUP BY ALL",
)
def a18(t: Facts):
    return dm.input_threshold(t.pairs, 3)


def dimsum_parts(t: Facts):
    t.pairs = cut(t.pairs)
    fit = dm.fitness(t.pairs)
    thresholds = dm.input_threshold(t.pairs, 3)
    arrays = cut(dm.fitting_arrays(fit, thresholds, REPS))
    return fit, arrays, cut(dm.normalise(arrays, 3))


@query("a19_dimsum_normalise", "dataset_id:s replicate:i scale:d shift:d")
def a19(t: Facts):
    scales = dimsum_parts(t)[2]
    return scales.select("dataset_id", F.posexplode(F.arrays_zip("scale", "shift")).alias("replicate", "x")).select("dataset_id", "replicate", "x.scale", "x.shift")


@query("a20_dimsum_error_model", "dataset_id:s replicate:i variants:i input:d output:d additive:d")
def a20(t: Facts):
    _, arrays, scales = dimsum_parts(t)
    model = dm.error_model(arrays, scales, 3, dm.substitution_weights(t.pairs))
    return model.select("dataset_id", "variants", F.posexplode(F.arrays_zip("input", "output", "additive")).alias("replicate", "x")).select("dataset_id", "replicate", "variants", "x.*")


@query("a22_dimsum_sigma", "dataset_id:s replicate_id:s variant:s score:d se:d")
def a22(t: Facts):
    fit, arrays, scales = dimsum_parts(t)
    return dm.score(fit, scales, dm.error_model(arrays, scales, 3, dm.substitution_weights(t.pairs), bootstrap=0), REPS)


@query(
    "a22_counting_sigma",
    "dataset_id:s replicate_id:s variant:s score:d se:d",
    "SELECT dataset_id, replicate_id, variant, fitness AS score, sqrt(1 / c0 + 1 / ct + 1 / wi + 1 / wo) AS se FROM fit_of WHERE fitness IS NOT NULL",
)
def a22_counting(t: Facts):
    ones = t.datasets.selectExpr("dataset_id", "array(1D, 1D, 1D) AS scale", "array(0D, 0D, 0D) AS shift")
    return dm.score(dm.fitness(t.pairs), ones, None, REPS)


@query("q20_qc_error_model", "dataset_id:s replicate:i input:d output:d additive:d input_low:d input_high:d")
def q20(t: Facts):
    _, arrays, scales = dimsum_parts(t)
    model = dm.error_model(arrays, scales, 3, dm.substitution_weights(t.pairs))
    return model.select("dataset_id", F.posexplode(F.arrays_zip("input", "output", "additive", "low", "high")).alias("replicate", "x")).select("dataset_id", "replicate", "x.input", "x.output", "x.additive", F.col("x.low").alias("input_low"), F.col("x.high").alias("input_high"))


@query("a28_error_model", "dataset_id:s a:d b:d pairs:i fitted:b")
def a28(t: Facts):
    return md.fit_error_model(md.measurement_arrays(measurements(t), BY), BY)


@query(
    "a29_replicate_shifts",
    "dataset_id:s replicate_id:s n:i shift:d",
    """WITH i AS (SELECT dataset_id, variant FROM used GROUP BY ALL HAVING count(*) >= 2 AND min(c0) >= 5 AND min(ct) >= 5)
       SELECT dataset_id, replicate_id, count(*) AS n, median(d) AS shift FROM (SELECT dataset_id, replicate_id, score - avg(score) OVER (PARTITION BY dataset_id, variant) AS d FROM used JOIN i USING (dataset_id, variant)) GROUP BY ALL HAVING count(*) >= 10""",
)
def a29(t: Facts):
    return md.replicate_shifts(md.measurement_arrays(measurements(t), BY), BY)


@query("a30_gls_combine", "dataset_id:s variant:s estimate:d unscaled:d phi:d k:i")
def a30(t: Facts):
    rows = condition_reps(t).where("state = 'used'").select(
        "dataset_id", "variant", F.concat_ws("-", "condition", "replicate_id").alias("replicate_id"), F.col("score").alias("y"), (F.col("se") * F.col("se")).alias("v"),
        F.col("replicate_id").alias("share"), (-F.sqrt(1 / (F.col("c0") + 0.5) + 1 / F.col("r0"))).alias("u"),
    )
    arrays = cut(md.measurement_arrays(rows, BY))
    model = md.fit_error_model(arrays, BY).join(md.shift_variance(md.replicate_shifts(arrays, BY), BY), "dataset_id")
    return md.gls_combine(arrays, model, BY)


@query("a31_squeeze_variances", "dataset_id:s s2_prior:d df_prior:d pooled:d")
def a31(t: Facts):
    spread = t.used.groupBy("dataset_id", "variant").agg(F.var_samp("score").alias("phi"), (F.count(F.lit(1)) - 1).alias("d"))
    out = md.squeeze_var(spread, BY)
    return out.withColumn("df_prior", F.when(F.col("df_prior") != F.lit(float("inf")), F.col("df_prior")))


@query("a31_moderated_combination", "dataset_id:s variant:s score:d se:d phi:d k:i a:d b:d")
def a31_moderated(t: Facts):
    return md.moderated_combination(measurements(t), BY)


SHARED_SQL["published_rows"] = "SELECT dataset_id, variant, CASE WHEN kind = 'nonsense' AND position % 3 = 0 THEN 'frameshift' ELSE kind END AS kind, score, CASE WHEN kind = 'synonymous' THEN NULL ELSE se END AS se FROM used"


def published_rows(t: Facts):
    rows = t.used.selectExpr("dataset_id", "variant", "CASE WHEN kind = 'nonsense' AND position % 3 = 0 THEN 'frameshift' ELSE kind END AS kind", "round(score, 9) AS score", "round(CASE WHEN kind = 'synonymous' THEN NULL ELSE se END, 9) AS se")
    return rows.unionByName(rows.where("kind = 'missense'"))


@query(
    "a35_published_scores",
    "dataset_id:s variant:s score:d se:d reason:s n_rows:i copies:i",
    """SELECT dataset_id, variant, CASE WHEN reason IS NULL THEN score END AS score, CASE WHEN reason IS NULL THEN se END AS se, reason, n_rows, CASE WHEN kind = 'missense' THEN n_all * 2 - n_rows ELSE n_all - n_rows END AS copies FROM (
       SELECT *, CASE WHEN kind = 'frameshift' AND n_rows > 1 THEN 'alike' WHEN NOT coalesce(se <= 0.6, false) THEN 'se' END AS reason FROM (
       SELECT dataset_id, variant, kind, count(*) AS n_rows, sum(n) AS n_all, CASE WHEN count(*) = 1 THEN max(score) WHEN count(CASE WHEN se > 0 THEN 1 END) = count(*) THEN sum(score / (se * se)) / sum(1 / (se * se)) ELSE avg(score) END AS score,
       CASE WHEN count(*) = 1 THEN max(se) WHEN count(CASE WHEN se > 0 THEN 1 END) = count(*) THEN sqrt(1 / sum(1 / (se * se))) END AS se FROM (SELECT dataset_id, variant, kind, round(score, 9) AS score, round(se, 9) AS se, count(*) AS n FROM published_rows GROUP BY ALL) GROUP BY ALL))""",
)
def a35(t: Facts):
    return pb.published_scores(published_rows(t), max_se=0.6)


SHARED_SQL["nt_scores"] = "SELECT dataset_id, replicate_id, variant, concat('p.', CAST(position AS STRING), CASE WHEN alt < 'K' THEN 'a' ELSE 'b' END) AS pro_key, kind, position % 5 = 0 AS mixed, score, se, c0, ct FROM used WHERE position IS NOT NULL"


@query(
    "a36_collapse_protein",
    "dataset_id:s pro_key:s score:d se:d n_members:i c0:d ct:d",
    """SELECT dataset_id, pro_key, CASE WHEN count(*) = 1 THEN max(score) ELSE sum(score / (se * se)) / sum(1 / (se * se)) END AS score, CASE WHEN count(*) = 1 THEN max(se) ELSE sqrt(1 / sum(1 / (se * se))) END AS se, count(*) AS n_members, sum(c0) AS c0, sum(ct) AS ct FROM nt_scores WHERE NOT mixed GROUP BY ALL""",
)
def a36(t: Facts):
    rows = t.used.where("position IS NOT NULL").selectExpr("dataset_id", "variant", "concat('p.', CAST(position AS STRING), CASE WHEN alt < 'K' THEN 'a' ELSE 'b' END) AS pro_key", "kind", "position % 5 = 0 AS mixed", "score", "se", "c0", "ct")
    return pb.collapse_protein(rows)


@query(
    "a37_diff_independent",
    "dataset_id:s condition:s variant:s status:s delta:d se:d z:d k:i",
    """WITH u AS (SELECT DISTINCT dataset_id, variant FROM two_conditions) SELECT u.dataset_id, 'drug' AS condition, u.variant, CASE WHEN a.score IS NULL THEN 'not scored in the reference condition' WHEN b.score IS NULL THEN 'not scored in the condition' ELSE 'estimated' END AS status,
       b.score - a.score AS delta, sqrt(a.se * a.se + b.se * b.se) AS se, (b.score - a.score) / sqrt(a.se * a.se + b.se * b.se) AS z, CASE WHEN a.k IS NULL THEN b.k WHEN b.k IS NULL THEN a.k ELSE least(a.k, b.k) END AS k
       FROM u LEFT JOIN two_conditions a ON a.dataset_id = u.dataset_id AND a.variant = u.variant AND a.condition = 'base' LEFT JOIN two_conditions b ON b.dataset_id = u.dataset_id AND b.variant = u.variant AND b.condition = 'drug'""",
)
def a37(t: Facts):
    return df_.diff_independent(two_conditions(t), "base")


@query("a37_diff_p_values", "dataset_id:s condition:s variant:s delta:d p:d q:d ci_low:d ci_high:d")
def a37_p(t: Facts):
    return df_.finish(df_.diff_independent(two_conditions(t), "base"))


def paired(t: Facts):
    reps = condition_reps(t).withColumn("replicate_id", F.concat_ws("-", "condition", "replicate_id")).drop("condition")
    pairs = t.datasets.selectExpr("dataset_id", "'drug' AS condition", "explode(array('r1', 'r2', 'r3')) AS r").selectExpr("dataset_id", "condition", "concat('base-', r) AS replicate_id_a", "concat('drug-', r) AS replicate_id_b")
    return df_.pair_differences(cut(reps), pairs)


@query(
    "a38_diff_paired_fixed",
    "dataset_id:s condition:s variant:s delta:d se:d k:i",
    """SELECT dataset_id, 'drug' AS condition, variant, sum(y / v) / sum(1 / v) AS delta, sqrt(1 / sum(1 / v)) AS se, count(*) AS k FROM (SELECT a.dataset_id, a.variant, b.score - a.score AS y, a.se * a.se + b.se * b.se - 2 * (1 / (a.c0 + 0.5) + 1 / a.r0) AS v
       FROM cond_reps a JOIN cond_reps b ON a.dataset_id = b.dataset_id AND a.variant = b.variant AND a.replicate_id = b.replicate_id AND a.condition = 'base' AND b.condition = 'drug') GROUP BY ALL""",
)
def a38(t: Facts):
    return df_.diff_paired(paired(t), "fixed")


@query("a38_diff_paired_moderated", "dataset_id:s condition:s variant:s delta:d se:d k:i z:d")
def a38_moderated(t: Facts):
    return df_.diff_paired(paired(t))


# One column per input library and one for selection in each condition.
LIMMA_SAMPLES = [f"{r}_input" for r in REPS] + [f"{r}_{c}" for c in ("base", "drug") for r in REPS]
LIMMA_X = np.array([[float(s.startswith(r)) for r in REPS] + [float(s.endswith(c)) for c in ("base", "drug")] for s in LIMMA_SAMPLES])


def limma_rows(t: Facts):
    sample = F.when(F.col("role") == "input", F.concat("replicate_id", F.lit("_input"))).otherwise(F.concat_ws("_", "replicate_id", "condition"))
    sums = Facts.named(t.reads.groupBy("dataset_id", "v", sample.alias("sample_id")).agg(F.sum("cnt").alias("cnt")))
    return cut(df_.log_cpm(sums, LIMMA_SAMPLES))


@query("a40_voom", "dataset_id:s variant:s w_first:d w_last:d")
def a40(t: Facts):
    return df_.voom(limma_rows(t), LIMMA_X).select("dataset_id", "variant", F.get("w", F.lit(0)).alias("w_first"), F.get("w", F.lit(8)).alias("w_last"))


@query("a41_moderated_t", "dataset_id:s variant:s delta:d se:d z:d df:d p:d q:d")
def a41(t: Facts):
    fit = df_.lm_fit(df_.voom(limma_rows(t), LIMMA_X), LIMMA_X, np.array([0, 0, 0, -1.0, 1.0]))
    return df_.finish(df_.moderated_t(fit).withColumn("condition", F.lit("drug")))


@query(
    "a42_class_effects",
    "dataset_id:s variant:s effect:d z:d",
    """SELECT dataset_id, variant, score - ref AS effect, CASE WHEN kind <> 'wild type' THEN (score - ref) / sqrt(se * se + re * re) END AS z FROM cond_score LEFT JOIN (
       SELECT dataset_id, coalesce(max(score) FILTER (kind = 'wild type'), median(score) FILTER (kind = 'synonymous')) AS ref, CASE WHEN count(*) FILTER (kind = 'wild type') > 0 THEN max(se) FILTER (kind = 'wild type') ELSE sqrt(pi() / 2 * sum(se * se) FILTER (kind = 'synonymous')) / count(*) FILTER (kind = 'synonymous') END AS re FROM cond_score GROUP BY ALL) USING (dataset_id)""",
)
def a42(t: Facts):
    return df_.class_effects(t.cond_score)


@query("a42_class_calls", "dataset_id:s variant:s effect:d p:d q:d call:s")
def a42_calls(t: Facts):
    return df_.class_calls(t.cond_score)
