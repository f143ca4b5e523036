"""Time series: each variant's slope of normalised log count on time, by least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import settle
from assaylake.functions.order import median
from assaylake.operators.ratio import BY_REPLICATE, PSEUDOCOUNT


def time_normalizers(rows: DataFrame, method: str, pseudocount: float = PSEUDOCOUNT, by: Sequence[str] = BY_REPLICATE) -> DataFrame:
    """The normaliser ``r`` of each replicate and time. ``rows(…, variant, kind, time, cnt)``."""
    by = list(by)
    if method == "synonymous":
        return rows.select(*by, "time").distinct().withColumn("r", F.lit(1.0))
    if method == "full":
        base = rows
    elif method == "wt":
        base = rows.where(F.col("kind") == "wild type")
    elif method == "complete":
        times = rows.select(*by, "time").distinct().groupBy(*by).agg(F.count("time").alias("n_times"))
        whole = rows.groupBy(*by, "variant").agg(F.count("cnt").alias("n"))
        complete = whole.join(times, by).where("n = n_times").select(*by, "variant")
        base = rows.join(complete, [*by, "variant"], "left_semi")
    else:
        raise ValueError(f"unknown normalization {method!r}")
    return base.groupBy(*by, "time").agg((F.sum("cnt") + pseudocount).alias("r"))


def _sum(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))


def slope_scores(
    rows: DataFrame,
    norms: DataFrame,
    *,
    weighted: bool = True,
    per_unit: bool = False,
    synonymous: bool = False,
    se_method: str = "counting-floor",
    pseudocount: float = PSEUDOCOUNT,
    min_points: int | str = 3,
    min_input: float = 1,
    by: Sequence[str] = BY_REPLICATE,
    carry: Sequence[str] = ("kind",),
) -> DataFrame:
    """One row per replicate and variant: slope ``score``, ``se``, ``fit`` = χ²/(n − 2), ``points``.

    A variant is fitted on the times where it is counted, the first always among them. The points
    of one variant in one replicate are as few as the design's times, so they are fitted as an
    array after a single shuffle. Also ``intercept``, ``se_counting``, ``first_coef``,
    ``first_var``, and the measurement's ``state``.
    """
    by = list(by)
    spans = norms.groupBy(*by).agg(F.max("time").alias("t_max"), F.min("time").alias("t_first"), F.count("time").alias("n_times"))
    cp = F.col("cnt") + pseudocount
    v = 1 / cp if synonymous else 1 / cp + 1 / F.col("r")
    y = F.log(cp) if synonymous else F.log(cp) - F.log("r")
    points = rows.where("cnt IS NOT NULL").join(norms, [*by, "time"]).join(spans, by)
    x = F.col("time") if per_unit else F.col("time") / F.col("t_max")
    point = F.struct(F.col("time").alias("t"), x.alias("x"), y.alias("y"), v.alias("v"), (1 / v if weighted else F.lit(1.0)).alias("w"))
    fits = points.groupBy(*by, "variant", *carry).agg(
        F.array_sort(F.collect_list(point)).alias("pts"),
        F.max(F.when(F.col("time") == F.col("t_first"), F.col("cnt"))).alias("first_cnt"),
        F.max_by("cnt", "time").alias("last_cnt"),
        F.sum("cnt").alias("total_cnt"),
        F.max("n_times").alias("n_times"),
    )
    pts, n = F.col("pts"), F.size("pts")
    need = F.col("n_times") if min_points == "all" else F.least(F.lit(min_points), F.col("n_times"))
    state = (
        F.when(F.col("first_cnt").isNotNull() & (n > 1) & (n < need), "few points")
        .when(F.col("first_cnt").isNull() | (n < need), "not counted")
        .when(F.col("first_cnt") < min_input, "input count")
        .otherwise("used")
    )
    usable = F.col("first_cnt").isNotNull() & (n >= need)
    sw = _sum(pts, lambda p: p["w"])
    # Each step is settled: as one expression, a filter on the fit would repeat the sums inside one another.
    out = settle(
        fits.withColumn("state", state).withColumn("points", n),
        __mx=_sum(pts, lambda p: p["w"] * p["x"]) / sw,
        __my=_sum(pts, lambda p: p["w"] * p["y"]) / sw,
    )
    out = settle(
        out,
        __sxx=_sum(pts, lambda p: p["w"] * (p["x"] - F.col("__mx")) * (p["x"] - F.col("__mx"))),
        __sxy=_sum(pts, lambda p: p["w"] * (p["x"] - F.col("__mx")) * (p["y"] - F.col("__my"))),
    )
    out = settle(out, score=F.when(usable & (F.col("__sxx") > 0), F.col("__sxy") / F.col("__sxx")))
    out = settle(out, intercept=F.col("__my") - F.col("score") * F.col("__mx"))
    err = lambda p: p["y"] - F.col("intercept") - F.col("score") * p["x"]
    df = F.col("points") - 2
    out = settle(
        out,
        __rss=_sum(pts, lambda p: p["w"] * err(p) * err(p)),
        fit=F.when(df > 0, _sum(pts, lambda p: err(p) * err(p) / p["v"]) / df),
        se_counting=F.when(F.col("__sxx") > 0, F.sqrt(_sum(pts, lambda p: p["w"] * p["w"] * (p["x"] - F.col("__mx")) * (p["x"] - F.col("__mx")) * p["v"])) / F.col("__sxx")),
    ).withColumn("se_residual", F.when((df > 0) & (F.col("__sxx") > 0), F.sqrt(F.col("__rss") / df / F.col("__sxx"))))
    floor = F.when(df > 0, F.greatest("se_residual", "se_counting"))
    first = F.get("pts", F.lit(0))
    return out.select(
        *by,
        "variant",
        *carry,
        "state",
        "score",
        F.when(F.col("score").isNotNull(), F.col("se_residual") if se_method == "residual" else floor).alias("se"),
        F.when(F.col("score").isNotNull(), F.col("fit")).alias("fit"),
        F.when(F.col("score").isNotNull(), F.col("se_counting")).alias("se_counting"),
        "intercept",
        "points",
        "n_times",
        F.col("first_cnt").alias("c0"),
        F.col("last_cnt").alias("ct"),
        F.when(F.col("first_cnt").isNotNull(), first["w"] * (first["x"] - F.col("__mx")) / F.col("__sxx")).alias("first_coef"),
        F.when(F.col("first_cnt").isNotNull(), first["v"]).alias("first_var"),
    )


def center_synonymous_slopes(df: DataFrame, by: Sequence[str] = BY_REPLICATE) -> DataFrame:
    """Slopes less the median slope of the replicate's used synonymous variants."""
    reference = df.where("kind = 'synonymous' AND state = 'used' AND score IS NOT NULL")
    return df.join(median(reference, by, "score", "__c"), list(by)).withColumn("score", F.col("score") - F.col("__c")).drop("__c")


def time_course(rows: DataFrame, norms: DataFrame, fits: DataFrame, per_unit: bool = False, pseudocount: float = PSEUDOCOUNT, by: Sequence[str] = BY_REPLICATE) -> DataFrame:
    """Observed and fitted log counts at each time a variant is counted."""
    by = list(by)
    t_max = norms.groupBy(*by).agg(F.max("time").alias("__t_max"))
    x = F.col("time") if per_unit else F.col("time") / F.col("__t_max")
    return (
        rows.where("cnt IS NOT NULL")
        .join(norms, [*by, "time"])
        .join(t_max, by)
        .join(fits.select(*by, "variant", "score", "intercept"), [*by, "variant"])
        .select(
            *by,
            "variant",
            "time",
            (F.log(F.col("cnt") + pseudocount) - F.log("r")).alias("observed"),
            (F.col("intercept") + F.col("score") * x).alias("fitted"),
        )
    )
