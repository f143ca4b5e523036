"""Differences between conditions, classes against the wild type, and linear models of log counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import Z95
from assaylake.functions.kernels import normal_two_sided, t_quantile_975, t_two_sided, vectorized
from assaylake.functions.lineage import cut
from assaylake.functions.order import benjamini_hochberg, equal_bins, median
from assaylake.operators.combine import combine_fixed
from assaylake.operators.moderate import moderated_combination, squeeze_var

Q = 0.05
LN2 = 0.6931471805599453


def diff_independent(conditions: DataFrame, reference: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Each condition's combined scores less the reference's, as independent: ``delta, se, z`` and why not."""
    keys = [*by, "variant"]
    ref = conditions.where(F.col("condition") == reference).select(*keys, F.col("score").alias("__sa"), F.col("se").alias("__ea"), F.col("k").alias("__ka"))
    others = conditions.where(F.col("condition") != reference).select(*keys, "condition", F.col("score").alias("__sb"), F.col("se").alias("__eb"), F.col("k").alias("__kb"))
    universe = conditions.select(*keys).distinct().join(others.select(*by, "condition").distinct(), list(by))
    both = universe.join(ref, keys, "left").join(others, [*keys, "condition"], "left")
    status = F.when(F.col("__sa").isNull(), "not scored in the reference condition").when(F.col("__sb").isNull(), "not scored in the condition").otherwise("estimated")
    out = both.withColumn("status", status).withColumn("delta", F.col("__sb") - F.col("__sa")).withColumn("se", F.sqrt(F.col("__ea") * F.col("__ea") + F.col("__eb") * F.col("__eb")))
    return out.select(*keys, "condition", "status", "delta", "se", (F.col("delta") / F.col("se")).alias("z"), F.least("__ka", "__kb").alias("k"))


def finish(diff: DataFrame, by: Sequence[str] = ("dataset_id", "condition")) -> DataFrame:
    """Adds p (t where ``df`` is finite), q within each contrast, and the 95% interval."""
    has_df = "df" in diff.columns
    inf = F.lit(float("inf"))
    p = t_two_sided("z", F.coalesce("df", inf)) if has_df else normal_two_sided("z")
    t = t_quantile_975(F.coalesce("df", inf)) if has_df else F.lit(Z95)
    out = diff.withColumn("p", F.when(F.col("z").isNotNull(), p)).withColumn("__t", t)
    out = out.withColumn("ci_low", F.col("delta") - F.col("__t") * F.col("se")).withColumn("ci_high", F.col("delta") + F.col("__t") * F.col("se")).drop("__t")
    return benjamini_hochberg(cut(out), by)


def pair_differences(reps: DataFrame, pairs: DataFrame, pseudocount: float = 0.5, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Differences of paired replicates, their shared input's variance removed: ``y, v`` per pair.

    ``reps(…, replicate_id, variant, state, score, se, c0, r0)``, ``pairs(…, condition,
    replicate_id_a, replicate_id_b)``.
    """
    used = reps.where("state = 'used'")
    side = lambda s: used.select(*by, "variant", *[F.col(c).alias(f"{c}_{s}") for c in ("replicate_id", "score", "se", "c0", "r0")])
    both = pairs.join(side("a"), [*by, "replicate_id_a"]).join(side("b"), [*by, "variant", "replicate_id_b"])
    shared = 1 / (F.col("c0_a") + pseudocount) + F.when(F.col("r0_a") == F.col("r0_b"), 1 / F.col("r0_a")).otherwise(0.0)
    v = F.col("se_b") * F.col("se_b") + F.col("se_a") * F.col("se_a") - 2 * shared
    return both.select(*by, "condition", "variant", F.concat_ws("|", "replicate_id_a", "replicate_id_b").alias("replicate_id"), (F.col("score_b") - F.col("score_a")).alias("y"), v.alias("v"))


def diff_paired(differences: DataFrame, how: str = "moderated", by: Sequence[str] = ("dataset_id", "condition")) -> DataFrame:
    """Pairs' differences combined as replicates are."""
    if how == "moderated":
        out = moderated_combination(differences, by, own_is_v=False)
        return out.select(*by, "variant", F.col("score").alias("delta"), "se", "df", "k", (F.col("score") / F.col("se")).alias("z"))
    rows = differences.withColumn("se", F.sqrt("v")).withColumnRenamed("y", "score")
    out = combine_fixed(rows, [*by, "variant"])
    return out.select(*by, "variant", F.col("score").alias("delta"), "se", "k", (F.col("score") / F.col("se")).alias("z"))


def class_effects(scores: DataFrame, by: Sequence[str] = ("dataset_id",), reference_exact: bool = False) -> DataFrame:
    """Each score's effect and z against the wild type, or the synonymous median where it is not scored.

    ``reference_exact``: scores already relative to the wild type carry its error.
    """
    by = list(by)
    ok = scores.where("score IS NOT NULL")
    wt = ok.where("kind = 'wild type'").groupBy(*by).agg(F.max("score").alias("__w"), F.max("se").alias("__we"))
    syn = ok.where("kind = 'synonymous'")
    mid = median(syn, by, "score", "__s", count="__n").join(syn.groupBy(*by).agg(F.sum(F.col("se") * F.col("se")).alias("__ss")), by)
    refs = ok.select(*by).distinct().join(wt, by, "left").join(mid, by, "left")
    error = F.lit(0.0) if reference_exact else F.coalesce("__we", F.lit(0.0))
    refs = refs.select(
        *by, F.coalesce("__w", "__s").alias("reference"), F.when(F.col("__w").isNotNull(), error).otherwise(F.sqrt(F.lit(1.5707963267948966) * F.col("__ss")) / F.col("__n")).alias("reference_se")
    )
    out = scores.join(refs, by, "left").withColumn("effect", F.col("score") - F.col("reference"))
    z = F.when((F.col("kind") != "wild type") & (F.col("se") > 0), F.col("effect") / F.sqrt(F.col("se") * F.col("se") + F.col("reference_se") * F.col("reference_se")))
    return out.withColumn("z", z)


def class_calls(scores: DataFrame, by: Sequence[str] = ("dataset_id",), reference_exact: bool = False) -> DataFrame:
    """lower, like or higher than the wild type at q below 0.05."""
    e = class_effects(scores, by, reference_exact)
    p = t_two_sided("z", F.coalesce("df", F.lit(float("inf")))) if "df" in e.columns else normal_two_sided("z")
    out = benjamini_hochberg(cut(e.withColumn("p", F.when(F.col("z").isNotNull(), p))), by)
    called = F.coalesce(F.col("q") < Q, F.lit(False))
    return out.withColumn("call", F.when(F.col("score").isNull(), None).when(called & (F.col("effect") < 0), "lower").when(called, "higher").otherwise("like"))


# --- Linear models of log counts --------------------------------------------------------------------


def log_cpm(counts: DataFrame, samples: Sequence[str], by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """log₂ counts per million of variants counted in every sample, relative to the wild type's counts.

    ``counts(…, variant, kind, sample_id, cnt)``. Library sizes are the wild type's counts scaled to
    the libraries' geometric mean.
    """
    by = list(by)
    wide = counts.groupBy(*by, "variant", "kind").pivot("sample_id", list(samples)).agg(F.first("cnt"))
    whole = cut(wide.na.drop(subset=list(samples)))
    n = float(len(samples))
    wt = whole.where("kind = 'wild type'").groupBy(*by).agg(*[F.sum(s).alias(f"w_{s}") for s in samples])
    lib = whole.groupBy(*by).agg(*[F.sum(s).alias(f"l_{s}") for s in samples])
    lift = sum((F.log(f"l_{s}") for s in samples), F.lit(0.0)) / n - sum((F.log(f"w_{s}") for s in samples), F.lit(0.0)) / n
    usable = sum((F.when(F.col(f"w_{s}") > 0, 0).otherwise(1) for s in samples), F.lit(0)) == 0
    sizes = wt.join(lib, by).where(usable).select(*by, F.array(*[F.exp(F.log(f"w_{s}") + lift) for s in samples]).alias("lib"))
    e = F.array(*[F.log2((F.col(s) + 0.5) / (F.get("lib", F.lit(i)) + 1) * 1e6) for i, s in enumerate(samples)])
    return whole.join(sizes, by).select(*by, "variant", e.alias("e"), "lib", F.array(*samples).alias("c"))


def _fit(E: np.ndarray, X: np.ndarray, W: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.ones_like(E) if W is None else W
    A = np.einsum("gs,si,sj->gij", w, X, X)
    b = np.einsum("gs,si,gs->gi", w, X, E)
    inv = np.linalg.inv(A)
    beta = np.einsum("gij,gj->gi", inv, b)
    res = E - beta @ X.T
    df = X.shape[0] - X.shape[1]
    return beta, np.sqrt(np.einsum("gii->gi", inv)), np.sqrt((w * res * res).sum(1) / df)


def lowess(x: np.ndarray, y: np.ndarray, size: np.ndarray, span: float, rounds: int = 3) -> np.ndarray:
    """Robust local lines through binned points, each bin counting its rows."""
    out, robust = np.empty_like(y), np.ones_like(y)
    total = size.sum()
    for r in range(rounds + 1):
        for i, at in enumerate(x):
            d = np.abs(x - at)
            order = np.argsort(d)
            reach = d[order[min(np.searchsorted(np.cumsum(size[order]), span * total), len(x) - 1)]]
            w = np.where(d < max(reach, 1e-12) * 0.999, (1 - (d / max(reach, 1e-12)) ** 3) ** 3, 0.0) * robust * size
            sw = w.sum()
            if sw <= 0:
                out[i] = y[i]
                continue
            mx, my = (w * x).sum() / sw, (w * y).sum() / sw
            sxx = (w * (x - mx) ** 2).sum()
            out[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (at - mx) if sxx > 1e-12 else 0.0)
        res = np.abs(y - out)
        scale = 6 * np.median(np.repeat(res, np.maximum(1, (size * 200 / total)).astype(int)))
        if r == rounds or scale <= 0:
            break
        robust = np.where(res < scale, (1 - (res / scale) ** 2) ** 2, 0.0)
    return out


def voom(rows: DataFrame, X: np.ndarray, by: Sequence[str] = ("dataset_id",), bins: int = 200) -> DataFrame:
    """Adds ``w``: precision weights from the trend of residual SD on mean log count.

    The trend is a local regression through at most ``bins`` groups of equal count per dataset, so its
    input stays that small however many variants there are (exact local regression uses every row).
    """
    by = list(by)

    @F.pandas_udf("amean double, sd double")
    def row_fit(e: pd.Series, lib: pd.Series) -> pd.DataFrame:
        E = np.vstack(e.to_numpy())
        L = np.log2(np.vstack(lib.to_numpy()) + 1).mean(1) - np.log2(1e6)
        return pd.DataFrame({"amean": E.mean(1) + L, "sd": np.sqrt(_fit(E, X, None)[2])})

    fits = cut(rows.withColumn("f", row_fit("e", "lib")).select(*by, F.col("f.amean").alias("x"), F.col("f.sd").alias("y")))
    binned = equal_bins(fits, by, "x", F.least(F.lit(bins), F.col("n_total")), ties=["y"])
    w = F.col("weight")
    points = binned.groupBy(*by, "bin").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.sum(w).alias("size"))
    schema = ", ".join(f"{k} string" for k in by) + ", tx array<double>, ty array<double>"

    def trend(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("x")
        n = p["size"].sum()
        ty = lowess(p["x"].to_numpy(), p["y"].to_numpy(), p["size"].to_numpy(dtype=float), min(1.0, 0.3 + 0.7 * (50 / n) ** (1 / 3)))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "tx": [p["x"].tolist()], "ty": [ty.tolist()]})

    trends = points.groupBy(*by).applyInPandas(trend, schema)

    @F.pandas_udf("array<double>")
    def weights(e: pd.Series, lib: pd.Series, tx: pd.Series, ty: pd.Series) -> pd.Series:
        E = np.vstack(e.to_numpy())
        fitted = _fit(E, X, None)[0] @ X.T + np.log2(np.vstack(lib.to_numpy()) + 1) - np.log2(1e6)
        return pd.Series([1 / np.interp(f, a, b) ** 4 for f, a, b in zip(fitted, tx, ty)])

    return rows.join(trends, by).withColumn("w", weights("e", "lib", "tx", "ty")).drop("tx", "ty")


def lm_fit(rows: DataFrame, X: np.ndarray, contrast: np.ndarray) -> DataFrame:
    """Each variant's weighted linear model and a contrast of it: ``estimate, unscaled, sigma, df``.

    The correlation of coefficients is the design's, their scales each row's own.
    """
    cov = np.linalg.inv(X.T @ X)
    rho = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))

    @F.pandas_udf("estimate double, unscaled double, sigma double")
    def fit(e: pd.Series, w: pd.Series) -> pd.DataFrame:
        beta, sd, sigma = _fit(np.vstack(e.to_numpy()), X, np.vstack(w.to_numpy()))
        scaled = sd * contrast
        return pd.DataFrame({"estimate": beta @ contrast, "unscaled": np.sqrt(np.einsum("gi,ij,gj->g", scaled, rho, scaled)), "sigma": sigma})

    out = rows.withColumn("f", fit("e", "w"))
    return out.select(*[c for c in rows.columns if c not in ("e", "w", "lib", "c")], "f.estimate", "f.unscaled", "f.sigma", F.lit(X.shape[0] - X.shape[1]).alias("d"))


def moderated_t(fit: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Moderated t of a contrast, in natural logarithms: ``delta, se, z`` (t), ``df``."""
    fits = cut(fit.withColumn("s2", F.col("sigma") * F.col("sigma")))
    out = fits.join(squeeze_var(fits, by, "s2", "d"), list(by))
    inf = F.lit(float("inf"))
    post = F.when(F.col("df_prior") == inf, F.col("s2_prior")).otherwise((F.col("df_prior") * F.col("s2_prior") + F.col("d") * F.col("s2")) / (F.col("df_prior") + F.col("d")))
    se = F.sqrt(post) * F.col("unscaled")
    return out.select(*by, "variant", (F.col("estimate") * LN2).alias("delta"), (se * LN2).alias("se"), (F.col("estimate") / se).alias("z"), F.least(F.col("d") + F.col("df_prior"), F.col("pooled")).alias("df"))
