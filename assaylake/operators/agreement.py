"""Agreement of two series: correlations with intervals, concordance, limits of agreement, AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import MEDIAN_CHI2_1, Z95, atanh, divide, tanh
from assaylake.functions.kernels import t_quantile_975, t_two_sided
from assaylake.functions.lineage import cut
from assaylake.functions.order import equal_bins, median, value_steps, with_average_rank


def pearson_ci(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pearson's r with Fisher's interval: SE of atanh r is 1/√(n − 3)."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))
    return _fisher(sums, keys, F.sqrt(1 / (F.col("n") - 3)))


def _fisher(sums: DataFrame, keys: Sequence[str], se: Column) -> DataFrame:
    r = F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r"))
    z = atanh(r)
    wide = F.col("n") > 3
    return sums.select(
        *keys, "n", r.alias("r"), F.when(wide, tanh(z - Z95 * se)).alias("r_low"), F.when(wide, tanh(z + Z95 * se)).alias("r_high")
    )


def spearman_ci(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Spearman's ρ (average ranks) with Bonett and Wright's interval."""
    ranked = with_average_rank(with_average_rank(df, keys, a, "__ra"), keys, b, "__rb")
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("r"))
    return _fisher(sums, keys, F.sqrt((1 + F.col("r") * F.col("r") / 2) / (F.col("n") - 3)))


def lin_ccc(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Lin's concordance, accuracy, scale and location shift, with the interval on the z scale."""
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"),
        F.covar_pop(a, b).alias("cab"),
    )
    s = s.where((F.col("n") >= 3) & (F.col("va") > 0) & (F.col("vb") > 0))
    gap = F.col("ma") - F.col("mb")
    s = s.withColumn("r", F.col("cab") / F.sqrt(F.col("va") * F.col("vb"))).withColumn(
        "ccc", 2 * F.col("cab") / (F.col("va") + F.col("vb") + gap * gap)
    )
    ccc, r = F.col("ccc"), F.col("r")
    u2 = gap * gap / F.sqrt(F.col("va") * F.col("vb"))
    c2, r2 = ccc * ccc, r * r
    var_z = (
        (1 - r2) * c2 / ((1 - c2) * r2)
        + 2 * c2 * ccc * (1 - ccc) * u2 / (r * (1 - c2) * (1 - c2))
        - c2 * c2 * u2 * u2 / (2 * r2 * (1 - c2) * (1 - c2))
    ) / (F.col("n") - 2)
    se = F.when((F.col("n") > 2) & (r != 0) & (c2 < 1) & (var_z >= 0), F.sqrt(var_z))
    return s.select(
        *keys,
        "n",
        ccc.alias("ccc"),
        F.when(r != 0, ccc / r).alias("accuracy"),
        F.sqrt(F.col("vb") / F.col("va")).alias("scale_shift"),
        ((F.col("mb") - F.col("ma")) / F.sqrt(F.sqrt(F.col("va") * F.col("vb")))).alias("location_shift"),
        tanh(atanh(ccc) - Z95 * se).alias("ccc_low"),
        tanh(atanh(ccc) + Z95 * se).alias("ccc_high"),
    )


def bland_altman(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Differences a − b: bias, 1.96-SD limits of agreement, their SEs, and the trend on the mean."""
    d, m = F.col(a) - F.col(b), (F.col(a) + F.col(b)) / 2
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.regr_slope(d, m).alias("slope"),
        F.regr_intercept(d, m).alias("intercept"), F.regr_sxx(d, m).alias("__sxx"), F.regr_syy(d, m).alias("__syy"),
    )
    n, sd = F.col("n"), F.col("sd")
    trend = (n >= 3) & (F.col("__sxx") > 0)
    resid = F.greatest(F.lit(0.0), F.col("__syy") - F.col("slope") * F.col("slope") * F.col("__sxx"))
    return (
        s.withColumn("lower", F.col("bias") - 1.96 * sd)
        .withColumn("upper", F.col("bias") + 1.96 * sd)
        .withColumn("bias_se", sd / F.sqrt(n))
        .withColumn("limit_se", F.sqrt(3 * sd * sd / n))
        .withColumn("slope_se", F.when(trend, F.sqrt(resid / (n - 2) / F.col("__sxx"))))
        .withColumn("slope", F.when(trend, F.col("slope")))
        .withColumn("intercept", F.when(trend, F.col("intercept")))
        .drop("__sxx", "__syy")
    )


def bland_altman_intervals(summary: DataFrame) -> DataFrame:
    """Student's 95% intervals of the bias, the limits and the trend, and the trend's p-value."""
    n = F.col("n").cast("double")
    out = summary.withColumn("t", t_quantile_975(n - 1)).withColumn("t_slope", t_quantile_975(n - 2))
    for name, se, q in (("bias", "bias_se", "t"), ("lower", "limit_se", "t"), ("upper", "limit_se", "t"), ("slope", "slope_se", "t_slope")):
        half = F.col(q) * F.col(se)
        out = out.withColumn(f"{name}_low", F.col(name) - half).withColumn(f"{name}_high", F.col(name) + half)
    return out.withColumn("slope_p", F.when(F.col("slope_se") > 0, t_two_sided(F.col("slope") / F.col("slope_se"), n - 2)))


def auc_delong(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """AUC of the rows where ``first`` holds against the others, with DeLong's variance and interval.

    A row's placement is the share of the other class below it (half of ties); the variance is
    that of the placements, so only running counts per distinct value are needed.
    """
    steps = value_steps(df, keys, value, {"in1": F.when(first, 1).otherwise(0), "in2": F.when(first, 0).otherwise(1)})
    pa = (F.col("in2_before") + F.col("in2") / 2.0) / F.col("in2_total")
    pb = (F.col("in1_total") - F.col("in1_before") - F.col("in1") / 2.0) / F.col("in1_total")
    both = steps.where("in1_total > 0 AND in2_total > 0")
    s = both.groupBy(*keys).agg(
        F.max("in1_total").alias("n1"), F.max("in2_total").alias("n2"), (F.sum(F.col("in1") * pa) / F.max("in1_total")).alias("auc")
    )
    dev = both.join(s.select(*keys, "auc"), list(keys)).groupBy(*keys).agg(
        F.sum(F.col("in1") * (pa - F.col("auc")) * (pa - F.col("auc"))).alias("sa"), F.sum(F.col("in2") * (pb - F.col("auc")) * (pb - F.col("auc"))).alias("sb")
    )
    out = s.join(dev, list(keys))
    n1, n2 = F.col("n1"), F.col("n2")
    se = F.when((n1 > 1) & (n2 > 1), F.sqrt(F.col("sa") / (n1 - 1) / n1 + F.col("sb") / (n2 - 1) / n2))
    out = out.withColumn("auc_se", se)
    return out.select(
        *keys, "n1", "n2", "auc", "auc_se",
        F.greatest(F.lit(0.0), F.col("auc") - Z95 * F.col("auc_se")).alias("auc_low"),
        F.least(F.lit(1.0), F.col("auc") + Z95 * F.col("auc_se")).alias("auc_high"),
    )


def non_negative_line(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares y = a·x + e per group, both kept at 0 or more: ``a, e``."""
    X, Y, Wt = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(Wt).alias("__w"), F.sum(Wt * X).alias("__x"), F.sum(Wt * Y).alias("__y"),
        F.sum(Wt * X * X).alias("__xx"), F.sum(Wt * X * Y).alias("__xy"), F.max(Y / X).alias("__only"),
    )
    det = F.col("__w") * F.col("__xx") - F.col("__x") * F.col("__x")
    a2 = divide(F.col("__w") * F.col("__xy") - F.col("__x") * F.col("__y"), det)
    e2 = divide(F.col("__xx") * F.col("__y") - F.col("__x") * F.col("__xy"), det)
    a1 = F.col("__xy") / F.col("__xx")
    s = s.withColumn("__a2", a2).withColumn("__e2", e2).withColumn("__a1", a1)
    through = ~F.coalesce(F.col("__e2") >= 0, F.lit(False))
    a = F.when(F.col("__n") == 1, F.col("__only")).when(through, F.col("__a1")).otherwise(F.col("__a2"))
    s = s.withColumn("__a", a)
    flat = (F.col("__n") > 1) & ~F.coalesce(F.col("__a") >= 0, F.lit(False))
    return s.select(
        *keys,
        F.when(flat, 0.0).otherwise(F.col("__a")).alias("a"),
        F.when(flat, F.col("__y") / F.col("__w")).when((F.col("__n") == 1) | through, 0.0).otherwise(F.col("__e2")).alias("e"),
    )


def robust_variance_line(df: DataFrame, keys: Sequence[str], r2: str, pv: str, small: bool = False) -> DataFrame:
    """Fits squared differences as a·(counting variance) + e, on medians of up to ten equal bins."""
    keys = list(keys)
    n_bins = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n_total") / 40)))
    binned = cut(equal_bins(df, keys, pv, n_bins, ties=[r2], small=small))
    inner = [*keys, "bin"]
    counting = binned.groupBy(*inner).agg((F.sum(F.col(pv) * F.col("weight")) / F.sum("weight")).alias("counting"), F.sum("weight").alias("n_bin"))
    observed = median(binned, inner, r2, "__m", weight=F.col("weight"), small=small)
    points = counting.join(observed, inner).select(
        *inner, "counting", (F.col("__m") / MEDIAN_CHI2_1).alias("observed"), (F.col("n_bin") / (F.col("counting") * F.col("counting"))).alias("w")
    )
    return non_negative_line(points, keys, "counting", "observed", "w").withColumnsRenamed({"a": "multiplier", "e": "additive"})
