"""Replicates combined under an error model shared by all variants, with moderated dispersions.

Everything is keyed by ``by`` (dataset, condition), so any number of experiments is fitted at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import MEDIAN_CHI2_1
from assaylake.functions.kernels import digamma, trigamma, trigamma_inverse, vectorized
from assaylake.functions.lineage import cut
from assaylake.functions.order import equal_bins, median
from assaylake.operators.agreement import non_negative_line

MIN_PAIRS = 40
PASSES = 10


def measurement_arrays(rows: DataFrame, by: Sequence[str], key: str = "variant", own_is_v: bool = True) -> DataFrame:
    """One row per variant: its measurements (replicate, y, v, own, share, u) as an ordered array.

    ``rows`` needs ``replicate_id, y, v``; ``own`` (a measurement's own variance), ``share`` (the first
    sample), ``u`` (√ of the counting variance it shares, signed) and ``informative`` are optional. Without ``own_is_v`` a missing own variance stays
    NULL, and the model's stands for it also where it could not be fitted.
    """
    opt = lambda c, t, d: F.col(c) if c in rows.columns else F.lit(d).cast(t)
    m = F.struct(
        F.col("replicate_id").alias("r"), F.col("y").alias("y"), F.col("v").alias("v"), (F.coalesce(opt("own", "double", None), F.col("v")) if own_is_v else opt("own", "double", None)).alias("own"),
        F.coalesce(opt("share", "string", None), F.concat(F.lit("\u0000"), F.col("replicate_id"))).alias("share"), F.coalesce(opt("u", "double", None), F.lit(0.0)).alias("u"),
    )
    return rows.groupBy(*by, key).agg(F.array_sort(F.collect_list(m)).alias("m"), F.min(opt("informative", "boolean", True)).alias("informative"))


def difference_pairs(arrays: DataFrame, by: Sequence[str]) -> DataFrame:
    """Differences of every two measurements of a variant: ``pair, d, x`` (v₁ + v₂) and ``c2`` (2 × shared)."""
    combos = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = arrays.where("informative").select(*by, F.explode(combos).alias("p"))
    same = F.col("p.a.share") == F.col("p.b.share")
    return p.select(
        *by, F.concat_ws("|", "p.a.r", "p.b.r").alias("pair"), (F.col("p.a.y") - F.col("p.b.y")).alias("d"), (F.col("p.a.v") + F.col("p.b.v")).alias("x"),
        F.when(same, 2 * F.col("p.a.u") * F.col("p.b.u")).otherwise(0.0).alias("c2"),
    ).where("x > 0 AND d IS NOT NULL")


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    sw, sx, sy, sxx, sxy = w.sum(), (w * x).sum(), (w * y).sum(), (w * x * x).sum(), (w * x * y).sum()
    det = sw * sxx - sx * sx
    a, e = ((sw * sxy - sx * sy) / det, (sxx * sy - sx * sxy) / det) if det != 0 else (np.nan, np.nan)
    if not e >= 0:
        a, e = sxy / sxx, 0.0
    return (a, e) if a >= 0 else (0.0, sy / sw)


def _fit_group(pdf: pd.DataFrame) -> tuple[float, float, bool]:
    d = pdf["d"] - pdf.groupby("pair")["d"].transform("median")
    pts = pd.DataFrame({"x": pdf["x"], "r2": d * d, "c2": pdf["c2"]}).sort_values(["x", "r2", "c2"])
    x, r2, c2 = (pts[c].to_numpy() for c in ("x", "r2", "c2"))
    n = len(x)
    if n < MIN_PAIRS:
        return 1.0, 0.0, False
    nb = max(2, min(10, n // 40))
    edges = [b * n // nb for b in range(nb + 1)]
    bx = np.array([x[i:j].mean() for i, j in zip(edges, edges[1:])])
    size = np.diff(edges)
    a, e = 1.0, 0.0
    for _ in range(PASSES):
        base = a * x + e
        z = r2 / np.maximum(base - c2, 1e-12 * base + 1e-300)
        by = np.array([np.median(z[i:j]) for i, j in zip(edges, edges[1:])]) / MEDIAN_CHI2_1 * (a * bx + e)
        a, e = _line(bx, by, size / np.square(np.maximum(a * bx + e, 1e-12)))
    return a, e / 2, True


def fit_error_model(arrays: DataFrame, by: Sequence[str], bound: int = 200_000) -> DataFrame:
    """Variance of a replicate score as a·s² + b: ``a, b, pairs, fitted`` per group.

    Groups of up to ``bound`` pairs (twelve bytes a pair and column) are fitted one to a task; larger
    ones together, each reweighting pass one set of distributed medians.
    """
    by = list(by)
    pairs = cut(difference_pairs(arrays, by))
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in by) + ", a double, b double, fitted boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, ok = _fit_group(pdf)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), a, b, ok]], columns=[*by, "a", "b", "fitted"])

    small = pairs.join(sizes.where(F.col("pairs") <= bound).select(*by), by).groupBy(*by).applyInPandas(fit, schema)
    model = small
    big = sizes.where(F.col("pairs") > bound).select(*by)
    if not big.isEmpty():
        rows = pairs.join(big, by)
        centred = cut(rows.join(median(rows, [*by, "pair"], "d", "__c"), [*by, "pair"]).select(*by, "x", "c2", ((F.col("d") - F.col("__c")) * (F.col("d") - F.col("__c"))).alias("r2")))
        n_bins = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n_total") / 40)))
        binned = cut(equal_bins(centred, by, "x", n_bins, ties=["r2", "c2"]))
        inner = [*by, "bin"]
        w = F.col("weight")
        shape = cut(binned.groupBy(*inner).agg((F.sum(F.col("x") * w) / F.sum(w)).alias("bx"), F.sum(w).alias("size")))
        fits = big.withColumn("a", F.lit(1.0)).withColumn("e", F.lit(0.0))
        for _ in range(PASSES):
            base = F.col("a") * F.col("x") + F.col("e")
            z = binned.join(fits, by).withColumn("z", F.col("r2") / F.greatest(base - F.col("c2"), base * 1e-12 + 1e-300))
            at = F.col("a") * F.col("bx") + F.col("e")
            points = median(z, inner, "z", "mz", weight=w).join(shape, inner).join(fits, by).select(
                *by, "bx", (F.col("mz") / MEDIAN_CHI2_1 * at).alias("vy"), (F.col("size") / F.pow(F.greatest(at, F.lit(1e-12)), 2)).alias("ww")
            )
            fits = cut(non_negative_line(points, by, "bx", "vy", "ww"))
        model = small.unionByName(fits.select(*by, "a", (F.col("e") / 2).alias("b"), F.lit(True).alias("fitted")))
    return model.join(sizes, by)


def replicate_shifts(arrays: DataFrame, by: Sequence[str], minimum: int = 10) -> DataFrame:
    """Median departure of each replicate's scores from their variants' means, where ten or more."""
    many = arrays.where("informative AND size(m) >= 2")
    mean = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["y"]) / F.size("m")
    rows = many.withColumn("__mean", mean).select(*by, "__mean", F.inline("m")).select(*by, F.col("r").alias("replicate_id"), (F.col("y") - F.col("__mean")).alias("departure"))
    return median(rows, [*by, "replicate_id"], "departure", "shift", count="n").where(F.col("n") >= minimum)


def shift_variance(shifts: DataFrame, by: Sequence[str]) -> DataFrame:
    return shifts.groupBy(*by).agg(F.coalesce(F.var_samp("shift"), F.lit(0.0)).alias("shift_variance"), F.count("shift").alias("n_shifts"))


@vectorized("estimate double, unscaled double, phi double, weights2 double")
def _gls(y: pd.Series, v: pd.Series, own: pd.Series, share: pd.Series, u: pd.Series, a: pd.Series, extra: pd.Series, fitted: pd.Series) -> pd.DataFrame:
    out = np.full((len(y), 4), np.nan)
    sizes = np.array([len(r) for r in y])
    av, ev, fv = a.to_numpy(float), extra.to_numpy(float), fitted.to_numpy(bool)
    for k in np.unique(sizes):
        i = np.flatnonzero(sizes == k)
        stack = lambda s: np.vstack([np.asarray(s.iloc[j], dtype=float) for j in i])
        Y, V, O, U = stack(y), stack(v), stack(own), stack(u)
        names = np.vstack([np.asarray(share.iloc[j], dtype=object) for j in i])
        M = np.minimum(av[i], 1.0)[:, None, None] * (U[:, :, None] * U[:, None, :]) * (names[:, :, None] == names[:, None, :])
        diag = np.where(fv[i][:, None] | np.isnan(O), av[i][:, None] * V + ev[i][:, None], O)
        M[:, np.arange(k), np.arange(k)] = diag
        good = (np.linalg.eigvalsh(M) > 0).all(1)
        out[i[~good], 0], out[i[~good], 1] = Y[~good].mean(1), 0.0
        if good.any():
            W = np.linalg.inv(M[good])
            row = W.sum(2)
            s1 = row.sum(1)
            m = (row * Y[good]).sum(1) / s1
            r = Y[good] - m[:, None]
            g = i[good]
            out[g, 0], out[g, 1], out[g, 3] = m, 1 / s1, np.square(row / s1[:, None]).sum(1)
            if k > 1:
                out[g, 2] = np.einsum("ij,ijk,ik->i", r, W, r) / (k - 1)
    return pd.DataFrame(out, columns=["estimate", "unscaled", "phi", "weights2"])


def gls_combine(arrays: DataFrame, model: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each variant by generalized least squares under the model: ``estimate, unscaled, phi, d, k``.

    ``model`` has ``a, b, fitted, shift_variance``. A few measurements that share a sample covary by
    its counting variance.
    """
    f = lambda c: F.transform("m", lambda x: x[c])
    got = _gls(f("y"), f("v"), f("own"), f("share"), f("u"), F.col("a"), F.col("b") + F.col("shift_variance"), F.col("fitted"))
    out = arrays.join(model, list(by)).withColumn("k", F.size("m")).withColumn("__g", got)
    ok = lambda c: F.when(~F.isnan(f"__g.{c}"), F.col(f"__g.{c}"))
    out = out.withColumn("estimate", F.col("__g.estimate")).withColumn("unscaled", F.col("__g.unscaled")).withColumn("weights2", F.coalesce(ok("weights2"), F.lit(0.0)))
    phi = F.when(F.col("informative"), ok("phi"))
    return out.withColumn("phi", phi).withColumn("d", F.when(phi.isNotNull(), F.col("k") - 1).otherwise(0)).drop("__g")


@vectorized("dig double, tri double")
def _gammas(d: pd.Series) -> pd.DataFrame:
    half = d.to_numpy(float) / 2
    return pd.DataFrame({"dig": digamma(half), "tri": trigamma(half)})


@vectorized("s2_prior double, df_prior double")
def _prior(mean: pd.Series, excess: pd.Series) -> pd.DataFrame:
    m, e = mean.to_numpy(float), excess.to_numpy(float)
    spread = e > 0
    df = np.where(spread, 2 * trigamma_inverse(np.where(spread, e, 1.0)), np.inf)
    safe = np.where(spread, df, 2.0)
    return pd.DataFrame({"s2_prior": np.where(spread, np.exp(m + digamma(safe / 2) - np.log(safe / 2)), np.exp(m)), "df_prior": df})


def squeeze_var(rows: DataFrame, by: Sequence[str], s2: str = "phi", d: str = "d") -> DataFrame:
    """The scaled inverse-χ² prior of variances by moment matching on their logarithms.

    ``s2_prior, df_prior`` (infinite when variances vary no more than chance), ``pooled`` degrees of
    freedom; a prior of 1 on infinite degrees of freedom with fewer than two variances.
    """
    by = list(by)
    have = rows.where(F.col(s2).isNotNull() & (F.col(d) > 0)).select(*by, F.greatest(F.col(s2), F.lit(0.0)).alias("s2"), F.col(d).cast("double").alias("d"))
    gammas = have.select("d").distinct().withColumn("g", _gammas("d")).select("d", "g.dig", "g.tri")
    floor = F.when(F.col("mid") > 0, F.col("mid")).otherwise(1.0) * 1e-5
    e = F.log(F.greatest(F.col("s2"), floor)) - F.col("dig") + F.log(F.col("d") / 2)
    logs = have.join(gammas, "d").join(median(have, by, "s2", "mid"), by).withColumn("e", e)
    stats = logs.groupBy(*by).agg(F.avg("e").alias("mean"), (F.var_samp("e") - F.avg("tri")).alias("excess"), F.count("e").alias("n"), F.sum("d").alias("pooled"))
    some = stats.where("n >= 2").withColumn("p", _prior("mean", "excess")).select(*by, "p.s2_prior", "p.df_prior", "pooled")
    every = rows.select(*by).distinct().join(some, by, "left")
    return every.select(*by, F.coalesce("s2_prior", F.lit(1.0)).alias("s2_prior"), F.coalesce("df_prior", F.lit(float("inf"))).alias("df_prior"), F.coalesce("pooled", F.lit(0.0)).alias("pooled"))


def moderated_combination(rows: DataFrame, by: Sequence[str], key: str = "variant", bound: int = 200_000, own_is_v: bool = True) -> DataFrame:
    """Every variant's replicates combined: ``score, se, df, phi, k`` and the parts without the reference.

    Degrees of freedom of the reference's part and the model's are joined by Satterthwaite's rule.
    """
    by = list(by)
    arrays = cut(measurement_arrays(rows, by, key, own_is_v))
    groups = arrays.select(*by).distinct()
    model = groups.join(fit_error_model(arrays, by, bound), by, "left").join(shift_variance(replicate_shifts(arrays, by), by), by, "left")
    model = model.na.fill({"a": 1.0, "b": 0.0, "fitted": False, "shift_variance": 0.0, "n_shifts": 0, "pairs": 0})
    fits = cut(gls_combine(arrays, model, by).drop("m"))
    out = fits.join(squeeze_var(fits, by), by)
    inf = F.lit(float("inf"))
    never = F.col("df_prior") == inf
    phi = F.when(never | (F.col("d") == 0), F.col("s2_prior")).otherwise((F.col("df_prior") * F.col("s2_prior") + F.col("d") * F.col("phi")) / (F.col("df_prior") + F.col("d")))
    out = out.withColumn("phi", phi)
    total, ref = F.col("phi") * F.col("unscaled"), F.col("phi") * F.col("shift_variance") * F.col("weights2")
    df_model = F.when(never, inf).otherwise(F.least(F.col("df_prior") + F.col("d"), F.col("pooled")))
    out = out.withColumn("__t", total).withColumn("__b", ref).withColumn("df_within", df_model)
    a = F.col("__t") - F.col("__b")
    denominator = F.when(F.col("df_within") == inf, 0.0).otherwise(a * a / F.col("df_within")) + F.col("__b") * F.col("__b") / F.when(F.col("n_shifts") > 1, F.col("n_shifts") - 1)
    joined = F.when((F.col("__b") > 0) & (F.col("n_shifts") > 1) & (denominator > 0), F.least(F.col("df_within"), F.floor(10 * F.col("__t") * F.col("__t") / denominator) / 10)).otherwise(F.col("df_within"))
    return out.select(
        *by, key, F.col("estimate").alias("score"), F.sqrt("__t").alias("se"), joined.alias("df"), "phi", "k", F.sqrt(F.greatest(a, F.lit(0.0))).alias("se_within"), "df_within", "a", "b", "shift_variance", "s2_prior", "df_prior", "pairs", "fitted"
    )
