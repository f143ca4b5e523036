"""Result tables as they are exported, and writing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import Z95

# What each flag of a score says.
FLAGS = {
    1: "no reads after selection in a replicate: the score rests on the pseudocount",
    2: "no reads before selection in a replicate",
    4: "scored in fewer replicates than the design has",
    8: "fitted on fewer time points than the replicate has (missing at the others)",
}


def flag_text(flags: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(flags.bitwiseAND(b) > 0, F.lit(t)) for b, t in FLAGS.items()]), lambda x: x.isNotNull()), "; ")


def status(reason: Column, flags: Column) -> Column:
    return (
        F.when(reason == "measured", "not measured").when(reason.isNotNull(), F.concat(F.lit("filtered: "), reason)).when(flags > 0, "low confidence").otherwise("scored")
    )


def scores_table(scores: DataFrame, reps: DataFrame | None = None, replicates: Sequence[str] = (), t_quantile: str | None = None, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Scores with names first, interval, status, flags, and each replicate's score and SE.

    The interval uses the column ``t_quantile`` where given, else the normal quantile.
    """
    q = F.col(t_quantile) if t_quantile else F.lit(Z95)
    scored = F.col("reason").isNull()
    opt = lambda c: F.col(c) if c in scores.columns else F.lit(None).cast("double")
    out = scores.select(
        *by, F.lit("NA").alias("hgvs_nt"), F.lit("NA").alias("hgvs_splice"), F.col("variant").alias("hgvs_pro"), F.when(scored, F.col("score")).alias("score"), F.when(scored, F.col("se")).alias("SE"),
        F.when(scored, F.col("score") - q * F.col("se")).alias("ci95_lower"), F.when(scored, F.col("score") + q * F.col("se")).alias("ci95_upper"), opt("df").alias("df"), opt("se_scale").alias("SE_scale"),
        F.col("k").alias("replicates"), F.col("expected").alias("replicates_expected"), status(F.col("reason"), F.col("flags")).alias("status"), flag_text(F.col("flags")).alias("flags"), opt("tau2").alias("tau2"),
    )
    if reps is None:
        return out
    wide = reps.groupBy(*by, F.col("variant").alias("hgvs_pro")).pivot("replicate_id", list(replicates)).agg(F.first("score").alias("score"), F.first("se").alias("SE"))
    renamed = wide.select(*by, "hgvs_pro", *[F.col(f"{r}_{c}").alias(f"{c}_{r}") for r in replicates for c in ("score", "SE")])
    return out.join(renamed, [*by, "hgvs_pro"], "left")


def differential_table(diff: DataFrame, by: Sequence[str] = ("dataset_id", "contrast")) -> DataFrame:
    cols = {"delta": "difference", "se": "SE", "ci_low": "ci95_lower", "ci_high": "ci95_upper", "z": "z", "p": "p", "q": "q", "k": "pairs", "status": "status"}
    return diff.select(*by, F.col("variant").alias("hgvs_pro"), *[F.col(a).alias(b) for a, b in cols.items() if a in diff.columns])


def counts_table(counts: DataFrame, samples: Sequence[str], by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Counts as scored, one column per sample."""
    return counts.groupBy(*by, F.col("variant").alias("hgvs_pro")).pivot("sample_id", list(samples)).agg(F.first("cnt"))


def barcodes_table(barcodes: DataFrame, replicates: Sequence[str], by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Each barcode with its counts, score, z, outlier mark and use in every replicate."""
    used = F.when(F.col("outlier"), "no (outlier)").when(F.col("state") == "used", "yes").otherwise(F.col("state"))
    rows = barcodes.withColumn("used", used)
    names = {"c0": "before", "ct": "after", "score": "score", "se": "SE", "z": "z", "used": "used"}
    wide = rows.groupBy(*by, "barcode", F.col("variant").alias("hgvs_pro")).pivot("replicate_id", list(replicates)).agg(*[F.first(a).alias(b) for a, b in names.items()])
    return wide.select(*by, "barcode", "hgvs_pro", *[F.col(f"{r}_{b}").alias(f"{b}_{r}") for r in replicates for b in names.values()])


def qc_variants_table(reps: DataFrame, replicates: Sequence[str], by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How each replicate measured a variant."""
    rows = reps.withColumn("used", F.when(F.col("state") == "used", "yes").otherwise(F.col("state")))
    wide = rows.groupBy(*by, F.col("variant").alias("hgvs_pro")).pivot("replicate_id", list(replicates)).agg(F.first("c0").alias("before"), F.first("ct").alias("after"), F.first("used").alias("used"))
    return wide.select(*by, "hgvs_pro", *[F.col(f"{r}_{b}").alias(f"{b}_{r}") for r in replicates for b in ("before", "after", "used")])


def selection_table(keys: DataFrame, scores: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Selected variants with their scores; those not in the table say so."""
    run = scores.select(*by, F.col("variant").alias("hgvs_pro"), "score", F.col("se").alias("SE"), status(F.col("reason"), F.col("flags")).alias("__s"))
    return keys.select(*by, F.col("key").alias("hgvs_pro")).join(run, [*by, "hgvs_pro"], "left").withColumn("status", F.coalesce("__s", F.lit("not in the table"))).drop("__s")


def deposit_table(table: DataFrame, name_column: str, by: Sequence[str] = ("dataset_id",)) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable name; and per dataset and column how many values it has (0: left out)."""
    usable = table.where(F.col(name_column).isNotNull() & (F.col(name_column) != "NA"))
    others = [c for c in usable.columns if c not in (*by, name_column)]
    filled = usable.groupBy(*by).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in others])
    return usable, filled.unpivot(list(by), others, "column", "n_values")


def deposit_columns(filled: DataFrame) -> list[str]:
    """The columns some dataset has a value in."""
    return [r["column"] for r in filled.groupBy("column").agg(F.sum("n_values").alias("n")).where("n > 0").select("column").collect()]


def write_csv(table: DataFrame, path: str) -> None:
    """A table as CSV files with NA for missing values, one folder per dataset."""
    table.write.partitionBy("dataset_id").csv(path, header=True, nullValue="NA", emptyValue="")


def write_parquet(table: DataFrame, path: str) -> None:
    table.write.partitionBy("dataset_id").parquet(path)
