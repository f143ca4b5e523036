"""Replicate scores of a variant combined: fixed effects, mean, REML, the fifty-update estimator.

Replicates of one variant are few by design, so their scores travel as an array; barcodes of one
variant are not, and ``combine_reml_large`` iterates over sums instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.kernels import padded, vectorized
from assaylake.functions.lineage import cut


def combine_fixed(
    df: DataFrame, keys: Sequence[str], y: str = "score", se: str = "se", extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Inverse-variance weighted mean; a score known exactly (variance 0) takes all the weight."""
    value, v = F.col(y), F.col(se) * F.col(se)
    sums = df.groupBy(*keys).agg(
        F.count(value).alias("k"),
        F.avg(F.when(v == 0, value)).alias("__exact"),
        F.sum(F.when(v > 0, 1 / v)).alias("__sw"),
        F.sum(F.when(v > 0, value / v)).alias("__swy"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    exact = F.col("__exact").isNotNull()
    return sums.select(
        *keys,
        "k",
        F.when(exact, F.col("__exact")).otherwise(F.col("__swy") / F.col("__sw")).alias("score"),
        F.when(exact, F.lit(0.0)).otherwise(F.sqrt(1 / F.col("__sw"))).alias("se"),
        *(extra or {}),
    )


def combine_mean(df: DataFrame, keys: Sequence[str], y: str = "score", se: str = "se") -> DataFrame:
    """Plain mean, its SE the SD over √k; a single score keeps its own SE."""
    return df.groupBy(*keys).agg(
        F.count(y).alias("k"),
        F.avg(y).alias("score"),
        F.when(F.count(y) == 1, F.max(se)).otherwise(F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se"),
    )


def replicate_arrays(df: DataFrame, keys: Sequence[str], y: str = "score", se: str = "se", by: str = "replicate_id") -> DataFrame:
    """One row per variant with its replicates as an ordered array of (replicate, y, v)."""
    rep = F.struct(F.col(by).alias("replicate"), F.col(y).alias("y"), (F.col(se) * F.col(se)).alias("v"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(rep)).alias("reps"))


def _total(reps: Column, f) -> Column:
    return F.aggregate(reps, F.lit(0.0), lambda acc, r: acc + f(r))


def heterogeneity(arrays: DataFrame) -> DataFrame:
    """Adds Cochran's Q about the fixed-effect mean and I²; NULL for one replicate or a variance 0."""
    reps = F.col("reps")
    k = F.size(reps)
    exact = F.exists(reps, lambda r: r["v"] == 0)
    mean = _total(reps, lambda r: r["y"] / r["v"]) / _total(reps, lambda r: 1 / r["v"])
    with_mean = arrays.withColumn("__m", F.when(~exact, mean))
    q = F.when((k >= 2) & ~exact, _total(reps, lambda r: (r["y"] - F.col("__m")) * (r["y"] - F.col("__m")) / r["v"]))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (k - 1)) / F.col("q"))).otherwise(
        F.when(F.col("q").isNotNull(), 0.0)
    )
    return with_mean.withColumn("q", q).withColumn("i2", i2).drop("__m")


def leave_one_out(arrays: DataFrame, how: str = "fixed") -> DataFrame:
    """Adds the largest shift of the estimate when one replicate is left out, and which one."""
    reps = F.col("reps")
    k = F.size(reps)
    if how == "fixed":
        full = arrays.withColumn("__sw", _total(reps, lambda r: 1 / r["v"])).withColumn("__s", _total(reps, lambda r: r["y"] / r["v"]))
        without = lambda r: (F.col("__s") - r["y"] / r["v"]) / (F.col("__sw") - 1 / r["v"])
    elif how == "mean":
        full = arrays.withColumn("__sw", k.cast("double")).withColumn("__s", _total(reps, lambda r: r["y"]))
        without = lambda r: (F.col("__s") - r["y"]) / (F.col("__sw") - 1)
    else:
        raise ValueError(f"unknown combination {how!r}")
    shifts = F.transform(reps, lambda r: F.abs(without(r) - F.col("__s") / F.col("__sw")))
    return (
        full.withColumn("__shifts", F.when(k >= 2, shifts))
        .withColumn("loo", F.array_max("__shifts"))
        .withColumn("loo_replicate", F.get(F.col("reps"), (F.array_position("__shifts", F.col("loo")) - 1).cast("int"))["replicate"])
        .drop("__shifts", "__sw", "__s")
    )


def _inverse_variance(y: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.where(np.isnan(v), 0.0, 1 / v)
    sw = w.sum(1)
    return (w * np.nan_to_num(y)).sum(1) / sw, np.sqrt(1 / sw)


def _restricted_loglik(y: np.ndarray, v: np.ndarray, tau2: np.ndarray) -> np.ndarray:
    have = ~np.isnan(v)
    total = np.where(have, v + tau2[:, None], 1.0)
    w = np.where(have, 1 / total, 0.0)
    sw = w.sum(1)
    beta = (w * np.nan_to_num(y)).sum(1) / sw
    rss = (w * np.square(np.nan_to_num(y) - beta[:, None])).sum(1)
    return -0.5 * np.log(total).sum(1) - 0.5 * np.log(sw) - 0.5 * rss


# Fixed values of the fit: convergence threshold, most iterations, likelihood tolerance at zero.
REML_THRESHOLD, REML_ITERATIONS, REML_TOLERANCE = 1e-12, 1000, 1.220703125e-4


def reml_batch(y: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """REML random effects of each row (NaN-padded), all rows iterated together."""
    have = ~np.isnan(y)
    k = have.sum(1)
    y0, n = np.where(have, y, 0.0), len(y)
    est, se, tau2 = (np.full(n, np.nan) for _ in range(3))
    steps, ok = np.zeros(n, int), k > 0
    one = k == 1
    est[one], se[one] = y0[one].sum(1), np.sqrt(np.where(have, v, 0.0)[one].sum(1))
    exact = (k > 1) & (np.where(have, v, 1.0) == 0).any(1)
    if exact.any():
        zero = have[exact] & (v[exact] == 0)
        est[exact], se[exact], tau2[exact] = (y0[exact] * zero).sum(1) / zero.sum(1), 0.0, 0.0
    rest = np.flatnonzero((k > 1) & ~exact)
    if len(rest):
        yr, vr, hr, kr = y[rest], v[rest], have[rest], k[rest]
        yz, vz = np.where(hr, yr, 0.0), np.where(hr, vr, 0.0)
        m = yz.sum(1) / kr
        t = np.maximum(0.0, (np.where(hr, yr - m[:, None], 0.0) ** 2).sum(1) / (kr - 1) - vz.sum(1) / kr)
        active, count = np.ones(len(rest), bool), np.zeros(len(rest), int)
        while active.any():
            a = np.flatnonzero(active)
            w = np.where(hr[a], 1 / np.where(hr[a], vr[a] + t[a, None], 1.0), 0.0)
            sw, sw2, sw3 = w.sum(1), (w**2).sum(1), (w**3).sum(1)
            beta = (w * yz[a]).sum(1) / sw
            ypp = np.square(w * (yz[a] - beta[:, None])).sum(1)
            adj = (ypp - (sw - sw2 / sw)) / (sw2 - 2 * sw3 / sw + np.square(sw2 / sw))
            adj = np.where(np.isfinite(adj) & ((t[a] > 0) | (adj > 0)), adj, 0.0)
            while True:
                low = t[a] + adj < 0
                if not low.any():
                    break
                adj = np.where(low, adj / 2, adj)
            t[a] += adj
            count[a] += 1
            late = count[a] > REML_ITERATIONS
            active[a] = (np.abs(adj) > REML_THRESHOLD) & ~late
            ok[rest[a[late]]] = False
        back = (t > REML_THRESHOLD) & ok[rest]
        if back.any():
            gain = _restricted_loglik(yr[back], vr[back], np.zeros(back.sum())) - _restricted_loglik(yr[back], vr[back], t[back])
            t[np.flatnonzero(back)[gain > REML_TOLERANCE]] = 0.0
        est[rest], se[rest] = _inverse_variance(yr, np.where(hr, vr + t[:, None], np.nan))
        tau2[rest], steps[rest] = t, count
    return pd.DataFrame({"estimate": est, "se": se, "tau2": tau2, "iterations": steps, "converged": ok})


@vectorized("estimate double, se double, tau2 double, iterations int, converged boolean")
def _reml(y: pd.Series, v: pd.Series) -> pd.DataFrame:
    return reml_batch(padded(y), padded(v))


def combine_reml(arrays: DataFrame) -> DataFrame:
    """REML random effects per variant: ``score, se, tau2, iterations, converged``."""
    fit = _reml(F.transform("reps", lambda r: r["y"]), F.transform("reps", lambda r: r["v"]))
    return (
        arrays.withColumn("__fit", fit)
        .withColumn("k", F.size("reps"))
        .select("*", F.col("__fit.estimate").alias("score"), "__fit.se", "__fit.tau2", "__fit.iterations", "__fit.converged")
        .drop("__fit")
    )


@vectorized("shift double, which int")
def _reml_leave_one_out(y: pd.Series, v: pd.Series, full: pd.Series) -> pd.DataFrame:
    ys, vs = padded(y), padded(v)
    k = (~np.isnan(ys)).sum(1)
    shifts = np.full(ys.shape, -np.inf)
    for j in range(ys.shape[1]):
        yj, vj = ys.copy(), vs.copy()
        yj[:, j], vj[:, j] = np.nan, np.nan
        out = np.abs(reml_batch(yj, vj)["estimate"].to_numpy() - full.to_numpy(dtype=float))
        shifts[:, j] = np.where((k >= 2) & ~np.isnan(ys[:, j]), out, -np.inf)
    shift = shifts.max(1) if ys.shape[1] else np.full(len(ys), -np.inf)
    some = np.isfinite(shift)
    return pd.DataFrame({"shift": np.where(some, shift, np.nan), "which": np.where(some, shifts.argmax(1) if ys.shape[1] else 0, -1)})


def leave_one_out_reml(combined: DataFrame) -> DataFrame:
    """As :func:`leave_one_out`, each reduced set combined again by REML."""
    got = _reml_leave_one_out(F.transform("reps", lambda r: r["y"]), F.transform("reps", lambda r: r["v"]), F.col("score"))
    return (
        combined.withColumn("__l", got)
        .withColumn("loo", F.when(~F.isnan("__l.shift"), F.col("__l.shift")))
        .withColumn("loo_replicate", F.when(F.col("__l.which") >= 0, F.get("reps", F.col("__l.which"))["replicate"]))
        .drop("__l")
    )


def fifty_updates(y: np.ndarray, v: np.ndarray, variants: np.ndarray, updates: int = 50) -> pd.DataFrame:
    have = ~np.isnan(y)
    k = have.sum(1)
    yz = np.where(have, y, 0.0)
    m = yz.sum(1) / np.maximum(k, 1)
    t = np.where(have, np.square(y - m[:, None]), 0.0).sum(1) / (variants - 1)
    beta, eps = m.copy(), np.zeros(len(y))
    for _ in range(updates):
        w = np.where(have, 1 / np.where(have, v + t[:, None], 1.0), 0.0)
        sw, sw2 = w.sum(1), (w * w).sum(1)
        beta = (w * yz).sum(1) / sw
        num = (np.where(have, np.square(y - beta[:, None]), 0.0) * w * w).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            new = t * num / (sw - sw2 / sw)
        eps, t = np.abs(t - new), new
    inv = np.where(have, 1 / np.where(have, v + t[:, None], 1.0), 0.0).sum(1)
    one = k == 1
    return pd.DataFrame(
        {
            "estimate": np.where(one, yz.sum(1), beta),
            "se": np.where(one, np.sqrt(np.where(have, v, 0.0).sum(1)), np.sqrt(1 / inv)),
            "tau2": np.where(one, np.nan, t),
            "epsilon": np.where(one, 0.0, eps),
        }
    )


@vectorized("estimate double, se double, tau2 double, epsilon double")
def _fifty(y: pd.Series, v: pd.Series, n: pd.Series) -> pd.DataFrame:
    return fifty_updates(padded(y), padded(v), n.to_numpy(dtype=float))


def combine_enrich2(arrays: DataFrame, by: Sequence[str], expected: Column) -> DataFrame:
    """Random effects by fifty fixed updates; only variants with all ``expected`` replicates.

    The start depends on how many variants of the group have every replicate.
    """
    complete = arrays.where(F.size("reps") == expected)
    n = complete.groupBy(*by).agg(F.count(F.lit(1)).alias("n_variants"))
    fit = _fifty(F.transform("reps", lambda r: r["y"]), F.transform("reps", lambda r: r["v"]), F.col("n_variants").cast("double"))
    return (
        complete.join(n, list(by))
        .withColumn("__fit", fit)
        .withColumn("k", F.size("reps"))
        .select("*", F.col("__fit.estimate").alias("score"), "__fit.se", "__fit.tau2", "__fit.epsilon")
        .drop("__fit")
    )


def combine_reml_large(df: DataFrame, keys: Sequence[str], y: str = "score", se: str = "se", bound: int = 256) -> DataFrame:
    """REML for groups of any size: arrays up to ``bound`` members, sums per iteration beyond.

    Returns keys, ``k, score, se, tau2, converged``. Large groups are few (each has over ``bound``
    rows); a round is one map-side combined aggregate for all of them together.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(y).alias("y"), (F.col(se) * F.col(se)).alias("v")).where(F.col("y").isNotNull())
    sizes = rows.groupBy(*keys).agg(
        F.count("y").alias("k"), F.avg("y").alias("m"), F.var_samp("y").alias("s2"), F.avg("v").alias("mv"),
        F.avg(F.when(F.col("v") == 0, F.col("y"))).alias("exact"),
    )
    arrays = (
        rows.join(sizes.where(F.col("k") <= bound).select(*keys), keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("reps"))
    )
    small = combine_reml(arrays).select(*keys, F.col("k").cast("long").alias("k"), "score", "se", "tau2", "converged")
    state = cut(sizes.where(F.col("k") > bound).withColumn("tau2", F.greatest(F.lit(0.0), F.col("s2") - F.col("mv"))).withColumn("moving", F.col("exact").isNull()))
    if state.isEmpty():
        return small
    big = cut(rows.join(state.select(*keys), keys))
    for _ in range(REML_ITERATIONS):
        if state.where("moving").isEmpty():
            break
        w = 1 / (F.col("v") + F.col("tau2"))
        live = big.join(state.where("moving").select(*keys, "tau2"), keys)
        sums = live.groupBy(*keys).agg(
            F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * w * w).alias("sw3"), F.sum(w * F.col("y")).alias("swy"),
            F.sum(w * w * F.col("y")).alias("sw2y"), F.sum(w * w * F.col("y") * F.col("y")).alias("sw2yy"),
        )
        beta = F.col("swy") / F.col("sw")
        ypp = F.col("sw2yy") - 2 * beta * F.col("sw2y") + beta * beta * F.col("sw2")
        tr_pp = F.col("sw2") - 2 * F.col("sw3") / F.col("sw") + F.pow(F.col("sw2") / F.col("sw"), 2)
        adj = (ypp - (F.col("sw") - F.col("sw2") / F.col("sw"))) / tr_pp
        # Halving until tau2 + adj >= 0: the number of halvings follows from the ratio.
        halvings = F.when(F.col("tau2") + F.col("adj") >= 0, 0).otherwise(
            F.when(F.col("tau2") > 0, F.ceil(F.log2(-F.col("adj") / F.col("tau2")))).otherwise(2000)
        )
        moved = (
            sums.select(*keys, adj.alias("adj"))
            .join(state, keys)
            .withColumn("step", F.col("adj") / F.pow(F.lit(2.0), halvings))
            .select(*keys, (F.col("tau2") + F.col("step")).alias("new"), (F.abs("step") > F.lit(1e-10) * (1 + F.col("tau2"))).alias("go"))
        )
        state = cut(
            state.join(moved, keys, "left")
            .withColumn("tau2", F.coalesce("new", "tau2"))
            .withColumn("moving", F.coalesce("go", F.lit(False)))
            .drop("new", "go")
        )
    converged = ~F.col("moving")
    both = big.join(state.where("exact IS NULL").select(*keys, "tau2"), keys)

    def fit(at: Column) -> list[Column]:
        w = 1 / (F.col("v") + at)
        return [F.sum(w), F.sum(w * F.col("y")), F.sum(w * F.col("y") * F.col("y")), F.sum(F.log(F.col("v") + at))]

    names = ["sw", "swy", "swyy", "logs"]
    tau, zero = fit(F.col("tau2")), fit(F.lit(0.0))
    sums = both.groupBy(*keys).agg(*[c.alias(f"t_{n}") for c, n in zip(tau, names)], *[c.alias(f"z_{n}") for c, n in zip(zero, names)])
    loglik = lambda p: -0.5 * F.col(f"{p}_logs") - 0.5 * F.log(f"{p}_sw") - 0.5 * (F.col(f"{p}_swyy") - F.col(f"{p}_swy") * F.col(f"{p}_swy") / F.col(f"{p}_sw"))
    at_zero = (F.col("tau2") > REML_THRESHOLD) & (loglik("z") - loglik("t") > REML_TOLERANCE)
    pick = lambda n: F.when(at_zero, F.col(f"z_{n}")).otherwise(F.col(f"t_{n}"))
    large = state.join(sums, keys, "left").select(
        *keys,
        "k",
        F.coalesce(F.col("exact"), pick("swy") / pick("sw")).alias("score"),
        F.when(F.col("exact").isNotNull(), 0.0).otherwise(F.sqrt(1 / pick("sw"))).alias("se"),
        F.when(F.col("exact").isNotNull() | at_zero, 0.0).otherwise(F.col("tau2")).alias("tau2"),
        converged.alias("converged"),
    )
    return small.unionByName(large)
