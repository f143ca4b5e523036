"""An analysis end to end: what must not be scored and why, scores of the rest, rescaling.

A refusal is a row (dataset_id, place, code, n): ``place`` is the replicate it concerns, NULL for the whole dataset, ``n`` how many rows it
names. A dataset with any refusal is left out of the scoring by an anti-join on the (small) set of refused datasets, and
stays in the result as one row with the reason ``refused``: nothing vanishes unlisted. Every check is an aggregate per dataset or replicate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.operators import combine as cb
from assaylake.operators import filters as fl
from assaylake.operators import ratio as rt
from assaylake.operators.barcodes import barcode_problems
from assaylake.operators.moderate import moderated_combination

# The code of each refusal and what it says.
REFUSALS = {
    "negative-count": "counts below zero",
    "duplicate-variant": "variants on more than one row of a sample",
    "barcode-repeated": "barcodes on more than one row",
    "barcode-blank": "rows without a barcode",
    "wild-type-absent": "the normalization needs the wild type, and the table has none",
    "wild-type-rows": "more than one row is the wild type",
    "wild-type-uncounted": "the wild type is not counted in every sample of the replicate",
    "wild-type-no-reads": "the wild type has no reads in a sample of the replicate",
    "no-synonymous": "no synonymous variant is scored in the replicate",
    "few-time-points": "a regression needs three time points in the replicate",
    "no-later-time": "all time points of the replicate are at time 0 or before",
    "bin-unscaled": "the bin scale's reference is not scored in the replicate",
    "bin-flat": "both references of the bin scale score the same",
    "anchor-absent": "the rescaling needs an anchor that is not scored",
    "anchors-equal": "both anchors of the rescaling score the same",
}
REP = ("dataset_id", "replicate_id")


def _refusal(rows: DataFrame, code: str | Column, n: Column, place: Column | None = None) -> DataFrame:
    named = F.lit(None).cast("string") if place is None else place.cast("string")
    return rows.select("dataset_id", named.alias("place"), (F.lit(code) if isinstance(code, str) else code).alias("code"), n.cast("long").alias("n"))


def count_refusals(counts: DataFrame) -> DataFrame:
    """Negative counts, and variants on more than one row of a sample. ``counts(dataset_id, sample_id, variant, cnt)``; a NULL count is missing, not wrong."""
    cells = counts.groupBy("dataset_id", "sample_id", "variant").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cnt") < 0).alias("negative"))
    totals = cells.groupBy("dataset_id").agg(F.sum("negative").alias("negative"), F.count_if(F.col("rows") > 1).alias("twice"))
    found = F.filter(F.array(F.struct(F.lit("negative-count").alias("code"), F.col("negative").alias("n")), F.struct(F.lit("duplicate-variant").alias("code"), F.col("twice").alias("n"))), lambda x: x["n"] > 0)
    return _refusal(totals.select("dataset_id", F.inline(found)), F.col("code"), F.col("n"))


def barcode_refusals(rows: DataFrame) -> DataFrame:
    """Barcodes on several rows of one table, and rows without one. ``rows(dataset_id, barcode)``."""
    problems = barcode_problems(rows).groupBy("dataset_id", "problem").agg(F.count("barcode").alias("barcodes"), F.sum("n_rows").alias("rows"))
    repeated = F.col("problem") == "repeated"
    return _refusal(problems, F.when(repeated, "barcode-repeated").otherwise("barcode-blank"), F.when(repeated, F.col("barcodes")).otherwise(F.col("rows")))


def wild_type_refusals(pairs: DataFrame) -> DataFrame:
    """What forbids the wild type's normalization, by dataset or replicate. ``pairs(dataset_id, replicate_id, variant, kind, c0, ct)``."""
    wt = F.col("kind") == "wild type"
    both = F.col("c0").isNotNull() & F.col("ct").isNotNull()
    reps = pairs.groupBy(*REP).agg(
        F.max(F.when(wt & both, F.least(F.col("c0"), F.col("ct")))).alias("_least"), F.min(F.when(wt, F.col("variant"))).alias("_first"), F.max(F.when(wt, F.col("variant"))).alias("_last")
    )
    whole = reps.groupBy("dataset_id").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    state = F.when(F.col("_first").isNull(), "wild-type-absent").when(F.col("_first") < F.col("_last"), "wild-type-rows")
    datasets = _refusal(whole.withColumn("_c", state).where("_c is not null"), F.col("_c"), F.lit(1))
    there = reps.drop("_first", "_last").join(whole.where("_first is not null").select("dataset_id"), "dataset_id", "left_semi")
    missing = F.when(F.col("_least").isNull(), "wild-type-uncounted").when(F.col("_least") <= 0, "wild-type-no-reads")
    return datasets.unionByName(_refusal(there.withColumn("_c", missing).where("_c is not null"), F.col("_c"), F.lit(1), F.col("replicate_id")))


def synonymous_refusals(states: DataFrame) -> DataFrame:
    """Replicates without a used synonymous variant to centre on."""
    n = F.count_if((F.col("kind") == "synonymous") & (F.col("state") == "used"))
    return _refusal(states.groupBy(*REP).agg(n.alias("_n")).where("_n = 0"), "no-synonymous", F.lit(1), F.col("replicate_id"))


def regression_refusals(times: DataFrame) -> DataFrame:
    """Replicates with fewer than three time points, or none after time 0. ``times(dataset_id, replicate_id, time)``."""
    points = times.groupBy(*REP).agg(F.count_distinct("time").alias("_n"), F.max("time").alias("_last"))
    code = F.when(F.col("_n") < 3, "few-time-points").when(F.col("_last") <= 0, "no-later-time")
    return _refusal(points.withColumn("_c", code).where("_c is not null"), F.col("_c"), F.col("_n"), F.col("replicate_id"))


def bin_refusals(scores: DataFrame, low: str = "nonsense") -> DataFrame:
    """Replicates that cannot be scaled to the class ``low`` (0) and the wild type (1)."""
    used = F.col("state") == "used"
    value = lambda kind: F.when(used & (F.col("kind") == kind), F.col("score"))
    ends = scores.groupBy(*REP).agg(F.max(value("wild type")).alias("_one"), F.median(value(low)).alias("_zero"))
    code = F.when(F.col("_one").isNull() | F.col("_zero").isNull(), "bin-unscaled").when(F.col("_one") == F.col("_zero"), "bin-flat")
    return _refusal(ends.withColumn("_c", code).where("_c is not null"), F.col("_c"), F.lit(1), F.col("replicate_id"))


def rescale_refusals(scores: DataFrame, preset: str) -> DataFrame:
    """Datasets without a scored anchor, or whose anchors score the same. ``scores`` must hold every dataset asked for."""
    asked = scores.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    state = asked.join(fl.anchors(scores, preset), "dataset_id", "left")
    code = F.when(F.col("from0").isNull() | F.col("from1").isNull(), "anchor-absent").when(F.col("slope").isNull(), "anchors-equal")
    return _refusal(state.withColumn("_c", code).where("_c is not null"), F.col("_c"), F.lit(1))


def refusals(*frames: DataFrame) -> DataFrame:
    """All refusals in one frame."""
    return reduce(DataFrame.unionByName, frames)


def admitted(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """Rows of the datasets without a refusal."""
    return rows.join(refused.select("dataset_id").distinct(), "dataset_id", "left_anti")


@dataclass(frozen=True)
class Settings:
    """How an experiment of two populations is scored; the values are the default analysis."""

    normalization: str = "wt"
    pseudocount: float = 0.5
    combination: str = "moderated"
    min_input: float = 1
    min_total: float = 0
    min_replicates: int | str = 1
    max_se: float | None = None
    exclude_kinds: Sequence[str] = ()
    rescale: str | None = None


def _combined(used: DataFrame, how: str, keys: Sequence[str]) -> DataFrame:
    """keys, score, se and, under the moderated model, df."""
    none = F.lit(None).cast("double").alias("df")
    if how == "fixed":
        return cb.combine_fixed(used, keys).select(*keys, "score", "se", none)
    if how == "mean":
        return cb.combine_mean(used, keys).select(*keys, "score", "se", none)
    if how == "reml":
        return cb.combine_reml(cb.replicate_arrays(used, keys)).select(*keys, "score", "se", none)
    if how == "moderated":
        reads = F.least("c0", "ct") >= 5
        rows = used.select(*keys, "replicate_id", F.col("score").alias("y"), (F.col("se") * F.col("se")).alias("v"), reads.alias("informative"))
        by = [k for k in keys if k != "variant"]
        return moderated_combination(rows, by).select(*keys, "score", "se", "df")
    raise ValueError(f"unknown combination {how!r}")


def analyse(pairs: DataFrame, settings: Settings = Settings(), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of every variant of the admitted datasets, and the refusals.

    ``pairs(dataset_id, replicate_id, variant, kind, c0, ct)``; ``known`` are refusals found before (of counts, barcodes, designs). Scores:
    dataset_id, variant, k, expected, reason, flags, score, se, df; a refused dataset has one row, variant NULL, with the reason ``refused``. Score and SE stand
    where the reason is NULL or ``se``.
    """
    keys = ["dataset_id", "variant"]
    # Read by the refusals, the normalizers and the scores: written once.
    pairs = cut(pairs)
    found = [known] if known is not None else []
    if settings.normalization == "wt":
        found.append(wild_type_refusals(pairs))
    states = rt.replicate_state(pairs, settings.min_input, settings.min_total)
    if settings.normalization == "synonymous":
        found.append(synonymous_refusals(states))
    refused = cut(refusals(*found)) if found else None
    fit = admitted(states, refused) if refused is not None else states
    measured = rt.log_ratio(fit, rt.normalizers(fit, settings.normalization, settings.pseudocount), settings.normalization, settings.pseudocount)
    if settings.normalization == "synonymous":
        measured = rt.center_synonymous(measured)
    measured = cut(measured)
    reasons = fl.filter_reasons(measured, [*keys, "kind"], exclude_kinds=settings.exclude_kinds, min_replicates=settings.min_replicates)
    kept = measured.where("state = 'used'").join(reasons.where("reason is null").select(*keys), keys, "left_semi")
    scores = reasons.join(_combined(kept, settings.combination, keys), keys, "left")
    scores = cut(fl.max_se_stage(scores, settings.max_se))
    if settings.rescale:
        asked = scores.withColumn("score", F.when(F.col("reason").isNull(), F.col("score")))
        more = cut(rescale_refusals(asked, settings.rescale))
        refused = more if refused is None else refused.unionByName(more)
        ends = fl.anchors(asked, settings.rescale).where("slope is not null").select("dataset_id", "from0", "slope")
        (_, zero), _ = fl.RESCALINGS[settings.rescale]
        scores = admitted(scores, more).join(ends, "dataset_id").withColumn("score", F.lit(zero) + (F.col("score") - F.col("from0")) * F.col("slope")).withColumn("se", F.col("se") * F.abs("slope"))
    columns = [*keys, "k", "expected", "reason", "flags", "score", "se", "df"]
    scores = scores.select(*columns)
    if refused is None:
        refused = _refusal(pairs.where(F.lit(False)), "", F.lit(0))
    listed = refused.select("dataset_id").distinct().withColumn("reason", F.lit("refused"))
    return scores.unionByName(listed, allowMissingColumns=True), refused
