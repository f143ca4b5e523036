"""Findings: metrics read against review and fail levels, one verdict per finding and dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.order import pick_order_statistics, value_steps

# Each finding's threshold: which way is bad, review level, fail level.
THRESHOLDS: dict[str, tuple[str, float, float]] = {
    "missing-sample": ("below", 1, 1),
    "depth": ("below", 30, 10),
    "low-count": ("above", 0.2, 0.5),
    "missingness": ("above", 0.2, 0.5),
    "dropout": ("above", 0.5, 2),
    "coverage": ("below", 0.9, 0.5),
    "agreement": ("below", 0.8, 0.5),
    "excess-variance": ("above", 2, 5),
    "outlier-replicate": ("above", 2, 4),
    "separation": ("below", 0.9, 0.75),
    "resolution": ("above", 0.25, 0.5),
    "scored-fraction": ("below", 0.8, 0.5),
    "time-points": ("above", 0.1, 0.3),
    "time-fit": ("above", 2, 5),
    "bin-occupancy": ("below", 0.05, 0.01),
    "cells-per-bin": ("below", 20, 5),
    "barcode-map": ("above", 0.05, 0.2),
    "barcodes-per-variant": ("above", 0.5, 0.95),
    "barcode-agreement": ("above", 2, 5),
    "split-half": ("below", 0.8, 0.5),
    "outlier-barcodes": ("above", 0.01, 0.05),
}
STATUSES = ("na", "pass", "review", "fail")


def metric(df: DataFrame, finding: str, entity: str | None, value: Column, where: Column | None = None) -> DataFrame:
    """A finding's metric in long form: ``dataset_id, finding, entity, value``."""
    rows = df if where is None else df.where(where)
    name = F.lit(None).cast("string") if entity is None else F.col(entity).cast("string")
    return rows.select("dataset_id", F.lit(finding).alias("finding"), name.alias("entity"), value.cast("double").alias("value"))


def sample_findings(samples: DataFrame, inputs: Column) -> DataFrame:
    """Empty samples, depth, low counts before selection, and missingness beyond the typical sample."""
    has = (F.col("counted") > 0) & (F.col("total") > 0)
    empty = metric(samples, "missing-sample", "sample_id", F.when(has, 1.0).otherwise(0.0))
    present = samples.where(has)
    # The typical sample: the lower median of the missing fractions.
    typical = pick_order_statistics(
        value_steps(present, ["dataset_id"], "missing_fraction"), ["dataset_id"], "missing_fraction", {"typical": F.floor((F.col("n_total") - 1) / 2)}
    ).select("dataset_id", "typical")
    return (
        empty.unionByName(metric(present, "depth", "sample_id", F.col("reads_per_variant")))
        .unionByName(metric(present, "low-count", "sample_id", F.col("low_fraction"), inputs))
        .unionByName(metric(present.join(typical, "dataset_id"), "missingness", "sample_id", F.col("missing_fraction") - F.col("typical")))
    )


def dropout_finding(drops: DataFrame) -> DataFrame:
    """1 where a sample without zeros misses variants that had been depleted (a dropout written as missing)."""
    looks = (
        (F.col("missing") / F.col("counted") >= 0.05) & (F.col("zeros") == 0) & F.coalesce(F.col("missing_trend") < 0.25 * F.col("counted_trend"), F.lit(False))
    )
    return metric(drops, "dropout", "replicate_id", F.when(looks, 1.0).otherwise(0.0), F.col("counted") >= 20)


def status_of(value: Column, finding: Column, thresholds: Mapping[str, tuple[str, float, float]] = THRESHOLDS) -> Column:
    """pass, review or fail of a metric under its finding's levels; na without a value."""
    pick = lambda i: F.create_map(*[x for k, t in thresholds.items() for x in (F.lit(k), F.lit(t[i]) if i == 0 else F.lit(float(t[i])))])[finding]
    above = pick(0) == "above"
    fail = F.when(above, value > pick(2)).otherwise(value < pick(2))
    review = F.when(above, value > pick(1)).otherwise(value < pick(1))
    return F.when(value.isNull() | F.isnan(value), "na").when(fail, "fail").when(review, "review").otherwise("pass")


def findings(metrics: DataFrame, thresholds: Mapping[str, tuple[str, float, float]] = THRESHOLDS) -> DataFrame:
    """One row per dataset and finding: the worst status, how many entities at each, the worst value.

    A finding with no metric is not in the result; one whose metrics are all missing is 'na'.
    """
    judged = metrics.withColumn("status", status_of(F.col("value"), F.col("finding"), thresholds))
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    above = F.create_map(*[x for k, t in thresholds.items() for x in (F.lit(k), F.lit(t[0] == "above"))])[F.col("finding")]
    out = judged.groupBy("dataset_id", "finding").agg(
        *[n(s).alias(f"n_{s}") for s in STATUSES], F.min("value").alias("__lo"), F.max("value").alias("__hi"),
    )
    worst = F.when(F.col("n_fail") > 0, "fail").when(F.col("n_review") > 0, "review").when(F.col("n_pass") > 0, "pass").otherwise("na")
    return out.withColumn("status", worst).withColumn("worst_value", F.when(above, F.col("__hi")).otherwise(F.col("__lo"))).drop("__lo", "__hi")


def overall(verdicts: DataFrame) -> DataFrame:
    """The worst finding of each dataset, how many of each, and whether a blocking one fails."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = verdicts.groupBy("dataset_id").agg(
        *[n(s).alias(f"n_{s}") for s in STATUSES], (F.count(F.when((F.col("finding") == "missing-sample") & (F.col("status") == "fail"), 1)) > 0).alias("blocked")
    )
    return out.withColumn("status", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_review") > 0, "review").otherwise("pass"))
