"""Research calibration: controls, ROC and PR curves, thresholds, OddsPath, likelihood ratios."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import wilson
from assaylake.functions.lineage import cut
from assaylake.functions.order import quantiles, value_steps

KEYS = ("set_id",)
# Review statuses as stars.
STARS = {
    "practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2, "criteria provided, conflicting classifications": 1,
    "criteria provided, conflicting interpretations": 1, "criteria provided, single submitter": 1,
}


def classification_class(text: Column) -> Column:
    """pathogenic, benign, conflicting, uncertain or other, from a classification's words."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isin("", "-"), F.lit(None))
        .when(t.startswith("conflicting"), "conflicting")
        .when(t.rlike(r"^(pathogenic|likely pathogenic|pathogenic/likely pathogenic)(,|;|$)"), "pathogenic")
        .when(t.rlike(r"^(benign|likely benign|benign/likely benign)(,|;|$)"), "benign")
        .when(t.startswith("uncertain significance"), "uncertain")
        .otherwise("other")
    )


def read_date(text: Column) -> Column:
    """A date in one of three written forms as ISO text, NULL where there is none."""
    s = F.trim(text)
    iso = F.regexp_replace(F.regexp_extract(s, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})(?!\d)", 1), "/", "-")
    us = F.regexp_extract(s, r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", 0)
    parts = lambda a, m, d, y: F.concat_ws(" ", F.initcap(F.regexp_extract(s, a, m)), F.regexp_extract(s, a, d), F.regexp_extract(s, a, y))
    p1, p2 = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.? (\d{4})$"
    when = F.coalesce(
        F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-M-d")),
        F.when(s.rlike(p1), F.try_to_timestamp(parts(p1, 1, 2, 3), F.lit("MMM d yyyy"))),
        F.when(s.rlike(p2), F.try_to_timestamp(parts(p2, 2, 1, 3), F.lit("MMM d yyyy"))),
    )
    return F.date_format(when, "yyyy-MM-dd")


def classified_controls(records: DataFrame, min_stars: int = 1, kinds: Sequence[str] = ("missense",), before: int | None = None, by: Sequence[str] = KEYS) -> DataFrame:
    """Every record with ``side`` and the first reason it is left out (NULL: kept).

    ``records(set_id, transcript, key, kind, classification, review_status, evaluated)``; records on
    another transcript than most are left out.
    """
    tally = records.groupBy(*by, "transcript").agg(F.count(F.lit(1)).alias("n"))
    first = tally.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "transcript")).alias("t")).select(*by, F.col("t.transcript").alias("__main"))
    stars = F.coalesce(F.create_map(*[F.lit(x) for p in STARS.items() for x in p])[F.lower("review_status")], F.lit(0))
    cls = classification_class(F.col("classification"))
    side = F.when(cls == "pathogenic", "P").when(cls == "benign", "B")
    rows = records.join(first, list(by)).withColumn("stars", stars).withColumn("side", side).withColumn("__c", F.coalesce(cls, F.lit("other")))
    reason = (
        F.when(F.col("transcript") != F.col("__main"), "on another transcript")
        .when(F.col("key").isNull(), "not a single substitution")
        .when(F.col("side").isNull(), F.col("__c"))
        .when(F.col("stars") < min_stars, "too few review stars")
        .when(~F.col("kind").isin(*kinds), "class not chosen")
    )
    if before is not None:
        reason = reason.when(F.col("evaluated").isNull(), "no date last evaluated").when(F.col("evaluated") >= f"{before}-01-01", "evaluated too late")
    return rows.withColumn("reason", reason).withColumn("label", F.col("classification")).drop("__main", "__c")


# Words that put a control on a side.
PATHOGENIC_WORDS = ("pathogenic", "likely pathogenic", "pathogenic/likely pathogenic", "p", "lp", "p/lp", "plp", "abnormal", "functionally abnormal")
BENIGN_WORDS = ("benign", "likely benign", "benign/likely benign", "b", "lb", "b/lb", "blb", "normal", "functionally normal")


def side_from_words(label: Column) -> Column:
    """P or B from the first term of a label; NULL for other words."""
    first = F.element_at(F.split(label, "[,;]"), 1)
    t = F.trim(F.regexp_replace(F.lower(first), r"[_\s]+", " "))
    return F.when(t.isin(*PATHOGENIC_WORDS), "P").when(t.isin(*BENIGN_WORDS), "B")


def merge_labels(labels: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: records on one side merged (most stars' label, of several the last in order; latest date), others conflicting."""
    out = labels.groupBy(*by, "key").agg(
        F.min("side").alias("side"), (F.min("side") != F.max("side")).alias("conflict"), F.max(F.struct("stars", "label")).getField("label").alias("label"), F.max("stars").alias("stars"), F.max("evaluated").alias("evaluated"), F.count(F.lit(1)).alias("records")
    )
    return out


def composition(labels: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return labels.groupBy(*by, "side", "kind").agg(F.count(F.lit(1)).alias("n"))


def circularity(labels: DataFrame, used: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """How many controls of each side were among the variants a score was built from."""
    marks = used.select(*by, "key").distinct().withColumn("__u", F.lit(1))
    return labels.join(marks, [*by, "key"], "left").groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n"), F.count("__u").alias("circular"))


def control_steps(controls: DataFrame, side: str = "below", by: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """Distinct scores with ``p, b`` at each, and ``tp, fp``: controls at or beyond it, from the abnormal side.

    ``controls(set_id, side, score)``; abnormal-like scores lie ``side`` the others. Oriented scores
    ``u`` rise toward the abnormal.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    rows = controls.where("score IS NOT NULL").withColumn("u", -F.col("score") if side == "below" else F.col("score"))
    steps = value_steps(rows, by, "u", {"p": F.when(F.col("side") == "P", w).otherwise(0), "b": F.when(F.col("side") == "B", w).otherwise(0)})
    steps = steps.where("p_total > 0 AND b_total > 0 AND p + b > 0")
    return steps.select(
        *by, "u", "p", "b", (F.col("p_total") - F.col("p_before")).alias("tp"), (F.col("b_total") - F.col("b_before")).alias("fp"),
        F.col("p_total").alias("n_p"), F.col("b_total").alias("n_b"),
    )


def roc(steps: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """ROC points: ``threshold`` midway below each score (NULL at both ends), tp, fp, sensitivity, specificity."""
    by = list(by)
    below = steps.select(*by, "tp", "fp", F.col("u").alias("__prev"), (F.col("tp") - F.col("p")).alias("__tp"), (F.col("fp") - F.col("b")).alias("__fp"))
    prev = below.select(*by, F.col("__tp").alias("tp"), F.col("__fp").alias("fp"), "__prev")
    points = steps.join(prev, [*by, "tp", "fp"], "left")
    sizes = ["n_p", "n_b"]
    point = F.struct(((F.col("u") + F.col("__prev")) / 2).alias("threshold"), "tp", "fp", *sizes, F.lit(False).alias("top"))
    # The end before every score comes from the first step, not from a union: Spark 4.1 takes parts of a union that are dealt alike for one, and runs them as two.
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), *sizes, F.lit(True).alias("top"))
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("b"))
    both = points.select(*by, F.inline(F.when(first, F.array(point, end)).otherwise(F.array(point))))
    return both.withColumn("sensitivity", F.col("tp") / F.col("n_p")).withColumn("specificity", (F.col("n_b") - F.col("fp")) / F.col("n_b"))


def areas(steps: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Area under the ROC curve and under the precision–recall curve (Keilwagen's interpolation)."""
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("b")
    r = F.col("n_p")
    h = F.when(F.col("p") > 0, F.col("b") / F.col("p"))
    a, b = 1 + h, (fp0 - h * tp0) / r
    piece = F.when(b == 0, F.col("p") / r / a).otherwise((F.col("p") / r - b / a * (F.log(a * F.col("tp") / r + b) - F.log(a * tp0 / r + b))) / a)
    return steps.groupBy(*by).agg(
        F.max("n_p").alias("n_p"), F.max("n_b").alias("n_b"), (F.sum(F.col("b") * (tp0 + F.col("p") / 2)) / F.max("n_p") / F.max("n_b")).alias("auc"), F.sum(F.when(F.col("p") > 0, piece)).alias("pr_auc")
    )


def pr_points(steps: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return steps.select(*by, F.col("u").alias("threshold"), (F.col("tp") / F.col("n_p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def sensitivity_at(points: DataFrame, grid: Sequence[float], by: Sequence[str] = KEYS) -> DataFrame:
    """Sensitivity at each specificity: a point's own, else linearly between the two around it."""
    sp, se = F.col("specificity"), F.col("sensitivity")
    aggs = []
    for i, g in enumerate(grid):
        aggs += [
            F.max(F.when(sp == g, se)).alias(f"own{i}"), F.min(F.when(sp > g, F.struct(sp.alias("sp"), (-se).alias("m")))).alias(f"hi{i}"), F.max(F.when(sp < g, F.struct(sp.alias("sp"), (-se).alias("m")))).alias(f"lo{i}")
        ]
    wide = points.groupBy(*by).agg(*aggs)
    value = lambda i, g: F.coalesce(
        F.col(f"own{i}"),
        -F.col(f"hi{i}.m") + (g - F.col(f"hi{i}.sp")) / (F.col(f"lo{i}.sp") - F.col(f"hi{i}.sp")) * (-F.col(f"lo{i}.m") + F.col(f"hi{i}.m")),
    )
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(float(g)).alias("specificity"), value(i, g).alias("sensitivity")) for i, g in enumerate(grid)])))


def precision_at(steps: DataFrame, grid: Sequence[float], by: Sequence[str] = KEYS) -> DataFrame:
    """Precision at each recall on the interpolated curve, in the first step that reaches it."""
    step = F.struct("tp", "fp", "p", "b", "n_p")
    want = lambda g: g * F.col("n_p")
    wide = steps.where("p > 0").groupBy(*by).agg(*[F.min(F.when(F.col("tp") >= want(g) - 1e-9, step)).alias(f"s{i}") for i, g in enumerate(grid)])

    def value(i: int, g: float) -> Column:
        s = F.col(f"s{i}")
        tp0, fp0 = s["tp"] - s["p"], s["fp"] - s["b"]
        x = F.greatest(F.lit(0.0), F.least(s["p"].cast("double"), g * s["n_p"] - tp0))
        return (tp0 + x) / (tp0 + x + fp0 + s["b"] / s["p"] * x)

    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(float(g)).alias("recall"), value(i, g).alias("precision")) for i, g in enumerate(grid)])))


def thresholds(points: DataFrame, rule: str = "error", error: float = 0.05, side: str = "below", by: Sequence[str] = KEYS) -> DataFrame:
    """Abnormal and normal thresholds on the scores' own scale, and whether they crossed.

    'error': most P controls abnormal-like with at most ``error`` of the B so, and the reverse;
    'youden': the largest sensitivity + specificity. A threshold beyond every score is NULL.
    """
    back = (lambda c: -c) if side == "below" else (lambda c: c)
    end = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("top"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    pts = points.withColumn("t", end)
    if rule == "youden":
        best = pts.groupBy(*by).agg(F.max(F.struct((F.col("sensitivity") + F.col("specificity")).alias("j"), (-F.col("fp")).alias("f"), (-F.col("t")).alias("m"))).alias("x"))
        t = -F.col("x.m")
        out = best.select(*by, t.alias("a"), t.alias("n"))
    else:
        max_b, max_p = F.floor(error * F.col("n_b") + 1e-9), F.floor(error * F.col("n_p") + 1e-9)
        out = pts.groupBy(*by).agg(
            F.max(F.when(F.col("fp") <= max_b, F.struct("tp", (-F.col("fp")).alias("f"), (-F.col("t")).alias("m")))).alias("x"),
            F.max(F.when(F.col("n_p") - F.col("tp") <= max_p, F.struct((-F.col("fp")).alias("f"), "tp", (-F.col("t")).alias("m")))).alias("y"),
        ).select(*by, (-F.col("x.m")).alias("a"), (-F.col("y.m")).alias("n"))
    crossed = F.col("a") < F.col("n")
    mid = (F.col("a") + F.col("n")) / 2
    tidy = lambda c: F.when(F.abs(c) != F.lit(float("inf")), back(c))
    return out.select(*by, tidy(F.when(crossed, mid).otherwise(F.col("a"))).alias("abnormal"), tidy(F.when(crossed, mid).otherwise(F.col("n"))).alias("normal"), crossed.alias("crossed"))


def functional_class(score: Column, side: str = "below") -> Column:
    """abnormal-like, intermediate or WT-like, from columns ``abnormal`` and ``normal``."""
    a, n = F.col("abnormal"), F.col("normal")
    if side == "below":
        return F.when(score <= a, "abnormal-like").when(n.isNotNull() & (score > n), "WT-like").otherwise("intermediate")
    return F.when(score >= a, "abnormal-like").when(n.isNotNull() & (score < n), "WT-like").otherwise("intermediate")


def class_counts(controls: DataFrame, limits: DataFrame, side: str = "below", by: Sequence[str] = KEYS) -> DataFrame:
    """Controls in each functional class: ``p, b`` and the totals ``n_p, n_b``."""
    rows = controls.where("score IS NOT NULL").join(limits, list(by)).withColumn("class", functional_class(F.col("score"), side))
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    counts = rows.groupBy(*by, "class").agg(n("P").alias("p"), n("B").alias("b"))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("n_p"), F.sum("b").alias("n_b"))
    return counts.join(totals, list(by))


def class_rates(counts: DataFrame) -> DataFrame:
    """Share of each side in a class with Wilson's interval."""
    p, b = wilson(F.col("p"), F.col("n_p")), wilson(F.col("b"), F.col("n_b"))
    return counts.select("*", *[c.alias(f"{s}_{k}") for s, t in (("p", p), ("b", b)) for k, c in zip(("rate", "low", "high"), t)])


# The strength of an OddsPath, toward the abnormal side and toward the normal.
ABOVE = [(350, "PS3_very_strong"), (18.7, "PS3"), (4.3, "PS3_moderate"), (2.1, "PS3_supporting")]
BELOW = [(0.053, "BS3"), (0.23, "BS3_moderate"), (0.48, "BS3_supporting")]


def odds_path(counts: DataFrame) -> DataFrame:
    """OddsPath of the abnormal-like and WT-like classes and its strength toward the class's side."""
    rows = counts.where("class <> 'intermediate' AND n_p > 0 AND n_b > 0 AND p + b > 0")
    prior = F.col("n_p") / (F.col("n_p") + F.col("n_b"))
    abnormal = F.col("class") == "abnormal-like"
    post = F.when(abnormal, F.col("p") / (F.col("p") + F.col("b") + 1)).otherwise((F.col("p") + 1) / (F.col("p") + F.col("b") + 1))
    rows = rows.withColumn("prior", prior).withColumn("posterior", post)
    odds = F.when(F.col("posterior") < 1, F.col("posterior") * (1 - F.col("prior")) / ((1 - F.col("posterior")) * F.col("prior")))
    rows = rows.withColumn("odds_path", odds)
    up, down = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for t, code in ABOVE:
        up = up.when(F.col("odds_path") > t, code)
    for t, code in BELOW:
        down = down.when(F.col("odds_path") < t, code)
    strength = F.coalesce(F.when(abnormal, up).otherwise(down), F.lit("Indeterminate"))
    contrary = F.when(abnormal, F.col("odds_path") < 1).otherwise(F.col("odds_path") > 1)
    return rows.withColumn("strength", strength).withColumn("contrary", contrary)


def range_counts(scores: DataFrame, ranges: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Scores in each published range (open or closed ends); a calibration has a handful of ranges."""
    rows = scores.where("score IS NOT NULL").join(ranges, list(by))
    low = F.col("lo").isNull() | F.when(F.col("lo_closed"), F.col("score") >= F.col("lo")).otherwise(F.col("score") > F.col("lo"))
    high = F.col("hi").isNull() | F.when(F.col("hi_closed"), F.col("score") <= F.col("hi")).otherwise(F.col("score") < F.col("hi"))
    hit = rows.where(low & high).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("side") == "P", 1)).alias("p"), F.count(F.when(F.col("side") == "B", 1)).alias("b"))
    return ranges.select(*by, "label").join(hit, [*by, "label"], "left").na.fill(0, ["n", "p", "b"])


# Where the resampled curves are read.
SPECIFICITIES = [k * 0.05 for k in range(21)]
RECALLS = [(k + 1) * 0.05 for k in range(20)]
#: Resamples drawn in one task.
DRAWS = 100


def _curve_measures(u: np.ndarray, p: np.ndarray, b: np.ndarray, rule: str, error: float) -> list[float]:
    """AUC, PR area, both thresholds (oriented, infinite for an empty class), whether they are one, sensitivities and precisions of one resample.

    ``u`` descends from the most abnormal-like score; ``p`` and ``b`` are how often each was drawn.
    """
    there = (p + b) > 0
    u, p, b = u[there], p[there].astype(float), b[there].astype(float)
    tp, fp = np.cumsum(p), np.cumsum(b)
    n_p, n_b = tp[-1], fp[-1]
    tp0, fp0 = tp - p, fp - b
    auc = float((b * (tp0 + p / 2)).sum() / n_p / n_b)
    own = p > 0
    h = b[own] / p[own]
    slope, rest = 1 + h, (fp0[own] - h * tp0[own]) / n_p
    with np.errstate(divide="ignore", invalid="ignore"):
        bent = (p[own] / n_p - rest / slope * (np.log(slope * tp[own] / n_p + rest) - np.log(slope * tp0[own] / n_p + rest))) / slope
    area = float(np.where(rest == 0, p[own] / n_p / slope, bent).sum())
    # Points of the ROC curve: before the first score, between neighbours, after the last.
    cut_at = np.concatenate([[np.inf], (u[:-1] + u[1:]) / 2, [-np.inf]])
    hits, alarms = np.concatenate([[0.0], tp]), np.concatenate([[0.0], fp])
    sens, spec = hits / n_p, (n_b - alarms) / n_b
    if rule == "youden":
        best = np.lexsort((alarms, -(sens + spec)))[0]
        low = high = float(cut_at[best])
    else:
        few, most = np.flatnonzero(alarms <= np.floor(error * n_b + 1e-9)), np.flatnonzero(n_p - hits <= np.floor(error * n_p + 1e-9))
        high = float(cut_at[few[np.lexsort((alarms[few], -hits[few]))[0]]])
        low = float(cut_at[most[np.lexsort((-hits[most], alarms[most]))[0]]])
        if high < low:
            high = low = (high + low) / 2
    found = []
    for g in SPECIFICITIES:
        same = np.flatnonzero(spec == g)
        above, below = np.flatnonzero(spec > g), np.flatnonzero(spec < g)
        if len(same):
            found.append(float(sens[same[-1]]))
        elif len(above) and len(below):
            i, j = above[-1], below[0]
            found.append(float(sens[i] + (g - spec[i]) / (spec[j] - spec[i]) * (sens[j] - sens[i])))
        else:
            found.append(float("nan"))
    for g in RECALLS:
        i = np.flatnonzero(own & (tp >= g * n_p - 1e-9))
        if not len(i):
            found.append(float("nan"))
            continue
        i = i[0]
        x = max(0.0, min(p[i], g * n_p - tp0[i]))
        found.append(float((tp0[i] + x) / (tp0[i] + x + fp0[i] + b[i] / p[i] * x)))
    return [auc, area, high, low, float(high == low), *found]


MEASURES = [("auc", None), ("pr_auc", None), ("abnormal", None), ("normal", None), ("without_zone", None), *[("sensitivity", g) for g in SPECIFICITIES], *[("precision", g) for g in RECALLS]]


def bootstrap(controls: DataFrame, samples: int = 2000, seed: int = 20261009, side: str = "below", rule: str = "error", error: float = 0.05, by: Sequence[str] = KEYS) -> DataFrame:
    """Percentile intervals of the areas, thresholds and curves over stratified resamples: ``metric, at, low, median, high, samples``.

    ``at`` is the specificity of a sensitivity, the recall of a precision. Each side's controls are drawn again, as many as it has: after they are summed per distinct score, a resample is
    two multinomial draws over the scores, so controls are never expanded. Resamples of a set are dealt over tasks, each with the set's scores once; a threshold
    beyond every score is no value (``samples`` counts the others); ``without_zone`` has the share of resamples without a score between the thresholds as its ``median`` (a mean).
    """
    by = list(by)
    back = -1.0 if side == "below" else 1.0
    rows = controls.where("score IS NOT NULL AND NOT isnan(score) AND side IN ('P', 'B')")
    steps = rows.groupBy(*by, (F.col("score").cast("double") * back).alias("u")).agg(F.count_if(F.col("side") == "P").alias("p"), F.count_if(F.col("side") == "B").alias("b"))
    steps = cut(steps)
    both = steps.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("b").alias("_b")).where("_p > 0 AND _b > 0").select(*by)
    dealt = steps.join(both, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // DRAWS) - 1))))
    kinds = ", ".join(f"{k} {steps.schema[k].dataType.simpleString()}" for k in by)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", ascending=False)
        u, p, b = (pdf[c].to_numpy() for c in ("u", "p", "b"))
        block = int(pdf["block"].iloc[0])
        names = [pdf[k].iloc[0] for k in by]
        rng = np.random.default_rng([seed, block, *"|".join(map(str, names)).encode()])
        out = []
        for _ in range(min(DRAWS, samples - block * DRAWS)):
            values = _curve_measures(u, rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(b.sum(), b / b.sum()), rule, error)
            values[2:4] = [back * v for v in values[2:4]]
            out += [(*names, m, at, v if np.isfinite(v) else None) for (m, at), v in zip(MEASURES, values)]
        return pd.DataFrame(out, columns=[*by, "metric", "at", "value"]).astype({"at": float, "value": float})

    drawn = dealt.groupBy(*by, "block").applyInPandas(draw, f"{kinds}, metric string, at double, value double")
    drawn = drawn.withColumn("at", F.when(~F.isnan("at"), F.col("at"))).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    q = drawn.groupBy(*by, "metric", "at").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"), F.avg("value").alias("_m"), F.count("value").alias("samples"))
    share = F.col("metric") == "without_zone"
    return q.select(*by, "metric", "at", F.when(~share, F.get("_q", 0)).alias("low"), F.when(share, F.col("_m")).otherwise(F.get("_q", 1)).alias("median"), F.when(~share, F.get("_q", 2)).alias("high"), "samples")


def given_thresholds(sets: DataFrame, side: str = "below", by: Sequence[str] = KEYS) -> DataFrame:
    """Thresholds given with each set (``abnormal, normal``) in the form of :func:`thresholds`, and the ``problem`` with them: missing, or on the wrong sides of each other."""
    a, n = F.col("abnormal").cast("double"), F.col("normal").cast("double")
    wrong = a > n if side == "below" else a < n
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    problem = F.when(~(finite(a) & finite(n)), "not two numbers").when(wrong, "abnormal beyond normal")
    return sets.select(*by, a.alias("abnormal"), n.alias("normal"), F.lit(False).alias("crossed"), problem.alias("problem"))


# The levels of score evidence, from the most benign.
LEVELS = ["Benign-VeryStrong", "Benign-Strong", "Benign-Moderate", "Benign-Supporting", "indeterminate", "Pathogenic-Supporting", "Pathogenic-Moderate", "Pathogenic-Strong", "Pathogenic-VeryStrong"]


def evidence_thresholds(odds: float) -> list[float]:
    """Likelihood ratios between the levels, from the odds of very strong evidence."""
    powers = [1.0, 0.5, 0.25, 0.125]
    return [odds**-p for p in powers] + [odds**p for p in reversed(powers)]


def _pool_adjacent(y: np.ndarray) -> np.ndarray:
    means: list[float] = []
    sizes: list[int] = []
    for v in y:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            m, n = means.pop(), sizes.pop()
            means[-1] = (means[-1] * sizes[-1] + m * n) / (sizes[-1] + n)
            sizes[-1] += n
    return np.repeat(means, sizes)


def score_likelihood(controls: DataFrame, odds: float = 1124.0, points: int = 1024, minimum: int = 10, draws: int = 200, seed: int = 20261009, by: Sequence[str] = KEYS) -> DataFrame:
    """Likelihood ratio of scores on a grid: kernel densities of P and B controls, monotone, with levels.

    The controls are counted on the grid first (map-side combined), so a set of any size becomes
    ``points`` numbers per side; the kernel, the resampling of those counts, the pooling and the levels
    then work on that. ``controls(set_id, side, score)``.
    """
    by = list(by)
    rows = controls.where("score IS NOT NULL AND side IN ('P', 'B')")
    span = rows.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.when(F.col("side") == "P", 1)).alias("n_p"), F.count(F.when(F.col("side") == "B", 1)).alias("n_b"))
    span = span.where((F.col("n_p") >= minimum) & (F.col("n_b") >= minimum) & (F.col("hi") > F.col("lo")))
    spread = quantiles(rows, [*by, "side"], "score", {"q1": 0.25, "q3": 0.75}).join(rows.groupBy(*by, "side").agg(F.stddev_samp("score").alias("sd")), [*by, "side"])
    at = F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (points - 1)).cast("int")
    counted = rows.join(span, by).groupBy(*by, "side", at.alias("cell"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    binned = counted.join(spread, [*by, "side"])
    limits = np.log(evidence_thresholds(odds))
    schema = ", ".join(f"{k} string" for k in by) + ", score double, log_lr double, log_lr_low double, log_lr_high double, level string"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        grid = np.linspace(0, 1, points)
        rng = np.random.default_rng(seed)
        curves = {}
        for s, part in pdf.groupby("side"):
            mass = np.zeros(points)
            np.add.at(mass, part["cell"].to_numpy(), part["n"].to_numpy(dtype=float))
            n = mass.sum()
            width = 0.9 * max(min(part["sd"].iloc[0], (part["q3"].iloc[0] - part["q1"].iloc[0]) / 1.34) / (hi - lo), 1e-3) * n**-0.2
            reach = np.exp(-0.5 * np.square((grid - 0.5) / width)) / (width * np.sqrt(2 * np.pi))
            again = np.vstack([mass, rng.multinomial(int(n), mass / n, size=draws)]) / n
            size = 2 * points
            f = np.fft.irfft(np.fft.rfft(again, size) * np.fft.rfft(reach, size), size)[:, points // 2 : points // 2 + points]
            curves[s] = np.maximum(f, 0.0)
        raw = np.log(curves["P"] + 1e-9) - np.log(curves["B"] + 1e-9)
        noise = np.median(np.abs(raw[1:] - np.median(raw[1:], axis=0)), axis=0)
        damp = noise / max(noise.max(), 1e-12) * np.sqrt(np.square(np.diff(noise)).sum()) / max(noise.sum(), 1e-12)
        llr = np.log(curves["P"] + damp + 1e-9) - np.log(curves["B"] + damp + 1e-9)
        falling = np.corrcoef(llr[1:].mean(0), grid)[0, 1] < 0
        mono = lambda y: _pool_adjacent(y[::-1])[::-1] if falling else _pool_adjacent(y)
        boot = np.vstack([mono(r) for r in llr[1:]])
        mid, low, high = mono(np.median(boot, axis=0)), np.quantile(boot, 0.025, axis=0), np.quantile(boot, 0.975, axis=0)
        careful = np.where(mid < 0, high, low)
        level = np.searchsorted(limits, careful, side="left")
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * points for k in by})
        return out.assign(score=lo + grid * (hi - lo), log_lr=mid, log_lr_low=low, log_lr_high=high, level=[LEVELS[i] for i in level])

    return binned.groupBy(*by).applyInPandas(fit, schema)
