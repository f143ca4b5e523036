"""Published scores read as given, and nucleotide runs read at protein level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_score(score: Column, se: Column) -> list[Column]:
    """Aggregates of scores weighted by 1/SE², averaged (SE unknown) when any SE is missing or 0."""
    weighable = F.count(F.when(se > 0, 1)) == F.count(score)
    one = F.count(score) == 1
    w = 1 / (se * se)
    return [
        F.when(one, F.max(score)).when(weighable, F.sum(F.when(se > 0, score * w)) / F.sum(F.when(se > 0, w))).otherwise(F.avg(score)).alias("score"),
        F.when(one, F.max(se)).when(weighable, F.sqrt(1 / F.sum(F.when(se > 0, w)))).alias("se"),
    ]


def published_scores(rows: DataFrame, max_se: float | None = None, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """One row per variant: copies read once, rows with other scores merged, frameshifts alike set aside.

    ``rows(dataset_id, variant, kind, score, se)``. ``reason``: given (no score), alike, se.
    """
    keys = [*by, "variant", "kind"]
    once = rows.groupBy(*keys, "score", "se").agg(F.count(F.lit(1)).alias("__copies"))
    out = once.groupBy(*keys).agg(*merged_score(F.col("score"), F.when(F.col("score").isNotNull(), F.col("se"))), F.count(F.lit(1)).alias("n_rows"), (F.sum("__copies") - F.count(F.lit(1))).alias("copies"), F.count("score").alias("n_scored"))
    reason = F.when((F.col("kind") == "frameshift") & (F.col("n_rows") > 1), "alike").when(F.col("n_scored") == 0, "given")
    if max_se is not None:
        reason = reason.when(~F.coalesce(F.col("se") <= max_se, F.lit(False)), "se")
    out = out.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.withColumn("score", F.when(ok, F.col("score"))).withColumn("se", F.when(ok, F.col("se")))


def collapse_protein(scores: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Nucleotide variants merged into the protein variants they make; mixed ones and frameshifts left out.

    ``scores(dataset_id, variant, pro_key, kind, mixed, score, se, c0, ct)``.
    """
    kept = scores.where("pro_key IS NOT NULL AND NOT mixed AND kind <> 'frameshift' AND NOT (pro_key LIKE 'p.[%' AND kind = 'synonymous')")
    return kept.groupBy(*by, "pro_key").agg(
        *merged_score(F.col("score"), F.when(F.col("score").isNotNull(), F.col("se"))), F.count("score").alias("n_scored"), F.count(F.lit(1)).alias("n_members"), F.sum("c0").alias("c0"), F.sum("ct").alias("ct")
    )


def collapse_summary(scores: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How many nucleotide variants are mixed, and how many make no protein variant to merge into."""
    unmerged = F.col("pro_key").isNull() | (F.col("kind") == "frameshift")
    return scores.groupBy(*by).agg(F.count(F.when(F.col("mixed"), 1)).alias("mixed"), F.count(F.when(~F.coalesce("mixed", F.lit(False)) & unmerged, 1)).alias("unmerged"))
