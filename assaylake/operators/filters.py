"""Filter stages in order with reason codes, the filter flow, flags and rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.order import median

# The stages in the order they apply, and the code of each.
STAGES = {"measured": 1, "identifier": 2, "class": 3, "excluded": 4, "input-count": 5, "total-count": 6, "barcodes": 9, "replicates": 7, "se": 8}
FLAG_OUTPUT_ZERO, FLAG_INPUT_ZERO, FLAG_FEWER_REPLICATES, FLAG_FEWER_POINTS = 1, 2, 4, 8

NOT_MEASURED = ("not counted", "few points", "not estimable", "outside tile")
PAST_INPUT = ("used", "total count", "low frequency", "few barcodes")


def filter_reasons(
    rep: DataFrame,
    keys: Sequence[str],
    *,
    exclude_kinds: Sequence[str] = (),
    exclude: Sequence[str] = (),
    min_replicates: int | str = 1,
    invalid: Column | None = None,
    expected: Column | None = None,
    combine: bool = False,
) -> DataFrame:
    """One row per variant: usable replicates k, those expected, flags, and the stage leaving it out.

    ``rep`` has one row per variant and replicate with ``state, c0, ct``. The reason is NULL for a
    variant that is scored. With ``combine``, the same aggregation also gives its fixed-effects
    ``score`` and ``se`` from the replicates' (one shuffle for both).
    """
    state = F.col("state")
    used = state == "used"
    flag = lambda test, bit: F.when(F.max(F.when(used & test, 1)) == 1, bit).otherwise(0)
    v = F.col("se") * F.col("se")
    weigh = lambda c: F.sum(F.when(used & (v > 0), c / v))
    parts = [F.avg(F.when(used & (v == 0), F.col("score"))).alias("__exact"), weigh(F.col("score")).alias("__wy"), weigh(F.lit(1.0)).alias("__w")] if combine else []
    sums = rep.groupBy(*keys).agg(
        *parts,
        F.count(F.when(used, 1)).alias("k"),
        (F.count(F.lit(1)) if expected is None else F.max(expected)).alias("expected"),
        F.max((~state.isin(*NOT_MEASURED)).cast("int")).alias("__counted"),
        F.max(state.isin(*PAST_INPUT).cast("int")).alias("__past"),
        F.max((state == "few barcodes").cast("int")).alias("__few"),
        (flag(F.col("ct") == 0, FLAG_OUTPUT_ZERO).bitwiseOR(flag(F.col("c0") == 0, FLAG_INPUT_ZERO))).alias("__flags"),
    )
    minimum = F.greatest(F.lit(1), F.col("expected")) if min_replicates == "all" else F.lit(min_replicates)
    reason = F.when(F.col("__counted") == 0, "measured")
    if invalid is not None:
        reason = reason.when(invalid, "identifier")
    if exclude_kinds:
        reason = reason.when(F.col("kind").isin(*exclude_kinds), "class")
    if exclude:
        reason = reason.when(F.col("variant").isin(*exclude), "excluded")
    reason = (
        reason.when((F.col("k") == 0) & (F.col("__few") == 1), "barcodes")
        .when((F.col("k") == 0) & (F.col("__past") == 1), "total-count")
        .when(F.col("k") == 0, "input-count")
        .when(F.col("k") < minimum, "replicates")
    )
    fewer = F.when(F.col("k") < F.col("expected"), FLAG_FEWER_REPLICATES).otherwise(0)
    kept = F.col("reason").isNull()
    exact = F.col("__exact").isNotNull() if combine else None
    combined = [
        F.when(kept, F.when(exact, F.col("__exact")).otherwise(F.col("__wy") / F.col("__w"))).alias("score"), F.when(kept, F.when(exact, 0.0).otherwise(F.sqrt(1 / F.col("__w")))).alias("se")
    ] if combine else []
    return sums.withColumn("reason", reason).select(
        *keys,
        *combined,
        "k",
        "expected",
        "reason",
        F.when(F.col("reason").isNull(), F.col("__flags").bitwiseOR(fewer)).otherwise(0).alias("flags"),
    )


def max_se_stage(scores: DataFrame, max_se: float | None) -> DataFrame:
    """The last stage: variants whose SE is above the maximum keep their numbers and get a reason."""
    if max_se is None:
        return scores
    over = F.col("reason").isNull() & ~F.coalesce(F.col("se") <= max_se, F.lit(False))
    return scores.withColumn("reason", F.when(over, "se").otherwise(F.col("reason")))


def filter_flow(scores: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How many variants each stage leaves out, and how many remain after it."""
    counted = scores.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("rows"))
    removed = counted.where("reason IS NOT NULL").select(*by, F.col("reason").alias("stage"), F.col("n").alias("removed"))
    every = totals.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_no")) for i, s in enumerate(STAGES)])))
    every = every.select(*by, "rows", "__s.*")
    up_to = Window.partitionBy(*by).orderBy("stage_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        every.join(removed, [*by, "stage"], "left")
        .withColumn("removed", F.coalesce("removed", F.lit(0)))
        .withColumn("remaining", F.col("rows") - F.sum("removed").over(up_to))
    )


# What each rescaling sends to which score.
RESCALINGS = {
    "nonsense-wt": (("nonsense", 0.0), ("wild type", 1.0)),
    "synonymous-nonsense": (("synonymous", 0.0), ("nonsense", -1.0)),
}


def anchors(scores: DataFrame, preset: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Where the two anchors of a rescaling lie: ``from0, from1, slope`` and their errors se0, se1.

    The wild type's own score, or the median of a class of controls; a median of n controls errs by
    about π/2 times their mean squared SE over n.
    """
    by = list(by)
    out = None
    for j, (what, _) in enumerate(RESCALINGS[preset]):
        rows = scores.where(F.col("score").isNotNull() & (F.col("kind") == what))
        if what == "wild type":
            one = rows.groupBy(*by).agg(F.max("score").alias(f"from{j}"), F.max("se").alias(f"se{j}"))
        else:
            error = rows.groupBy(*by).agg(
                F.when(F.count("se") >= 2, F.sqrt(F.lit(3.141592653589793 / 2) * F.sum(F.col("se") * F.col("se")) / F.count("se") / F.count("se"))).alias(f"se{j}")
            )
            one = median(rows, by, "score", f"from{j}").join(error, by)
        out = one if out is None else out.join(one, by)
    (_, to0), (_, to1) = RESCALINGS[preset]
    gap = F.col("from1") - F.col("from0")
    return out.withColumn("slope", F.when(gap != 0, F.lit(to1 - to0) / gap))


def rescale(scores: DataFrame, preset: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Scores, SEs and their scale's own error (``se_scale``) on the scale the anchors set.

    Datasets without both anchors drop out of the result (see :func:`rescale_problems`).
    """
    (_, to0), (_, to1) = RESCALINGS[preset]
    on_scale = F.lit(to0) + (F.col("score") - F.col("from0")) * F.col("slope")
    t = (F.col("score") - to0) / (to1 - to0)
    slope = F.abs("slope")
    return (
        scores.join(anchors(scores, preset, by), list(by))
        .where(F.col("slope").isNotNull())
        .withColumn("score", on_scale)
        .withColumn("se", F.col("se") * slope)
        .withColumn("se_scale", F.sqrt(F.pow((1 - t) * F.col("se0") * slope, 2) + F.pow(t * F.col("se1") * slope, 2)))
    )


def rescale_problems(scores: DataFrame, preset: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Datasets refused because an anchor is missing or both anchors score the same."""
    good = anchors(scores, preset, by).where("slope IS NOT NULL").select(*by)
    return scores.select(*by).distinct().join(good, list(by), "left_anti").withColumn("problem", F.lit("rescaling anchors missing or equal"))
