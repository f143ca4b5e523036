"""Pooling of technical replicates and log ratios of two populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import strict_sum
from assaylake.functions.order import median

BY_REPLICATE = ("dataset_id", "replicate_id")
PSEUDOCOUNT = 0.5


def pool_technical(lanes: DataFrame, design_sample: DataFrame) -> DataFrame:
    """Counts of technical replicates summed per sample; missing in one lane is missing in the sum.

    ``lanes(dataset_id, variant, source_column, cnt)``, ``design_sample(dataset_id, sample_id,
    source_column, missing_means_zero)``. A missing total is a NULL count, or 0 where the design
    says missing means zero (then also for variants absent from every lane of the sample).
    """
    sizes = design_sample.groupBy("dataset_id", "sample_id").agg(
        F.count("source_column").alias("n_lanes"), F.max("missing_means_zero").alias("missing_means_zero")
    )
    lane_of = design_sample.select("dataset_id", "sample_id", "source_column")
    pooled = (
        lanes.join(lane_of, ["dataset_id", "source_column"])
        .groupBy("dataset_id", "variant", "sample_id")
        .agg(F.count("cnt").alias("n_counted"), F.sum("cnt").alias("cnt"))
    )
    zero_samples = sizes.where("missing_means_zero").select("dataset_id", "sample_id")
    variants = lanes.select("dataset_id", "variant").distinct()
    absent = (
        variants.join(zero_samples, "dataset_id")
        .join(pooled.select("dataset_id", "variant", "sample_id"), ["dataset_id", "variant", "sample_id"], "left_anti")
        .withColumn("n_counted", F.lit(0).cast("long"))
        .withColumn("cnt", F.lit(None).cast("double"))
    )
    full = pooled.unionByName(absent).join(sizes, ["dataset_id", "sample_id"])
    complete = F.when(F.col("n_counted") >= F.col("n_lanes"), F.col("cnt"))
    cnt = F.when(F.col("missing_means_zero"), F.coalesce(complete, F.lit(0.0))).otherwise(complete)
    return full.select("dataset_id", "variant", "sample_id", cnt.alias("cnt"))


def pool_technical_known(lanes: DataFrame, keys: Sequence[str], n_lanes: int) -> DataFrame:
    """The same sum for samples known to have ``n_lanes`` lanes each, with no design to join."""
    return lanes.groupBy(*keys).agg(strict_sum(F.col("cnt"), F.lit(n_lanes)).alias("cnt"))


def first_and_last(counts: DataFrame, design: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Attaches the design and keeps, per variant and replicate, the first and last sample's count.

    ``design(dataset_id, sample_id, replicate_id, role, [time])``; input and output, or the first
    and last time point.
    """
    order = F.coalesce(F.col("time"), F.when(F.col("role") == "output", 1.0).otherwise(0.0))
    spans = design.withColumn("__at", order)
    ends = spans.groupBy("dataset_id", "replicate_id").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    slots = spans.join(ends, ["dataset_id", "replicate_id"])
    rows = counts.join(slots, ["dataset_id", "sample_id"])
    return rows.groupBy("dataset_id", "variant", "replicate_id", *extra).agg(
        F.max(F.when(F.col("__at") == F.col("__first"), F.col("cnt"))).alias("c0"),
        F.max(F.when(F.col("__at") == F.col("__last"), F.col("cnt"))).alias("ct"),
    )


def replicate_state(
    df: DataFrame,
    min_input: float = 1,
    min_total: float = 0,
    *,
    counted: Column | None = None,
    total: Column | None = None,
    few_points: Column | None = None,
    outside_tile: Column | None = None,
) -> DataFrame:
    """Whether a replicate's measurement of a variant is used, and if not, the first reason why."""
    counted = F.col("c0").isNotNull() & F.col("ct").isNotNull() if counted is None else counted
    total = F.col("c0") + F.col("ct") if total is None else total
    state = F.when(F.lit(False), F.lit(""))
    if outside_tile is not None:
        state = state.when(outside_tile, "outside tile")
    if few_points is not None:
        state = state.when(few_points, "few points")
    state = (
        state.when(~counted, "not counted")
        .when(F.col("c0") < min_input, "input count")
        .when(total < min_total, "total count")
        .otherwise("used")
    )
    return df.withColumn("state", state)


def normalizers(
    pairs: DataFrame,
    method: str,
    pseudocount: float = PSEUDOCOUNT,
    by: Sequence[str] = BY_REPLICATE,
    samples: Sequence[str] = ("c0", "ct"),
) -> DataFrame:
    """What each sample's counts are relative to, per replicate: ``r_<sample>`` columns r0, rt.

    'wt' the wild type's count, 'complete' the variants counted in every sample, 'full' all reads
    (each plus the pseudocount), 'synonymous' 1 (the scores are centred afterwards). A replicate
    whose wild type is missing or has no reads gets no normalizer.
    """
    first, last = samples
    both = F.col(first).isNotNull() & F.col(last).isNotNull()
    if method == "wt":
        wt = F.col("kind") == "wild type"
        sums = [F.sum(F.when(wt & both & (F.col(first) > 0) & (F.col(last) > 0), F.col(c))) for c in samples]
    elif method == "complete":
        sums = [F.sum(F.when(both, F.col(c))) for c in samples]
    elif method == "full":
        sums = [F.sum(c) for c in samples]
    elif method == "synonymous":
        return pairs.select(*by).distinct().withColumn("r0", F.lit(1.0)).withColumn("rt", F.lit(1.0))
    else:
        raise ValueError(f"unknown normalization {method!r}")
    return pairs.groupBy(*by).agg((sums[0] + pseudocount).alias("r0"), (sums[1] + pseudocount).alias("rt"))


def log_ratio(
    df: DataFrame,
    norms: DataFrame,
    method: str,
    pseudocount: float = PSEUDOCOUNT,
    by: Sequence[str] = BY_REPLICATE,
) -> DataFrame:
    """Adds ``score`` (normalised log ratio of last to first) and its Poisson ``se``."""
    c0, ct = F.col("c0") + pseudocount, F.col("ct") + pseudocount
    out = df.join(norms, list(by))
    if method == "synonymous":
        score, variance = F.log(ct) - F.log(c0), 1 / c0 + 1 / ct
    else:
        score = (F.log(ct) - F.log("rt")) - (F.log(c0) - F.log("r0"))
        variance = 1 / c0 + 1 / ct + 1 / F.col("r0") + 1 / F.col("rt")
    return out.withColumn("score", score).withColumn("se", F.sqrt(variance))


def center_synonymous(df: DataFrame, by: Sequence[str] = BY_REPLICATE) -> DataFrame:
    """Subtracts from every score the median of the used synonymous variants of its replicate."""
    reference = df.where((F.col("kind") == "synonymous") & (F.col("state") == "used"))
    center = median(reference, by, "score", "synonymous_median", count="n_synonymous")
    return df.join(center, list(by)).withColumn("score", F.col("score") - F.col("synonymous_median"))


def ratio_per_unit(df: DataFrame, design: DataFrame) -> DataFrame:
    """Scores and errors per unit of time between a replicate's first and last sample."""
    span = design.groupBy(*BY_REPLICATE).agg((F.max("time") - F.min("time")).alias("span"))
    return (
        df.join(span, list(BY_REPLICATE))
        .withColumn("score", F.col("score") / F.col("span"))
        .withColumn("se", F.col("se") / F.col("span"))
    )
