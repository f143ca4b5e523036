"""The position × residue map, its summaries and tracks, and selections of variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.order import median, quantiles

RESIDUES = "ARNDCQEGHILKMFPSTWYV*"
SINGLE = ("missense", "nonsense", "start lost", "synonymous")


def map_grid(scores: DataFrame, targets: DataFrame, tiles: DataFrame | None = None, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Every residue of every position with its state: not designed, missing, filtered, low, scored, reference."""
    letters = F.array(*[F.lit(a) for a in RESIDUES])
    cells = targets.select(*by, "position", "ref_aa", F.explode(letters).alias("alt"))
    if tiles is not None:
        inside = tiles.select(*by, F.explode(F.sequence("pos_start", "pos_end")).alias("position")).distinct().withColumn("__designed", F.lit(True))
        cells = cells.join(inside, [*by, "position"], "left")
    else:
        cells = cells.withColumn("__designed", F.lit(True))
    single = scores.where(F.col("kind").isin(*SINGLE)).select(*by, "position", "alt", "variant", "score", "se", "k", "reason", "flags", F.lit(1).alias("__in"))
    out = cells.join(single, [*by, "position", "alt"], "left")
    is_ref = F.col("alt") == F.col("ref_aa")
    absent = F.col("__in").isNull() | (F.coalesce("reason", F.lit("")) == "measured")
    state = (
        F.when(F.col("__designed").isNull(), "not designed").when(absent, F.when(is_ref, "reference").otherwise("missing")).when(F.col("reason").isNotNull(), "filtered").when(F.col("flags") > 0, "low").otherwise("scored")
    )
    out = out.withColumn("state", state).withColumn("is_reference", is_ref)
    shown = F.col("state").isin("scored", "low")
    return out.withColumn("value", F.when(shown, F.col("score"))).drop("__in", "__designed")


def off_map(scores: DataFrame, targets: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Variants with no cell on the map, by class (the wild type not counted)."""
    cells = targets.select(*by, "position")
    single = F.col("kind").isin(*SINGLE)
    on = scores.where(single).join(cells, [*by, "position"], "left_semi").select(*by, "variant")
    return scores.where("kind <> 'wild type'").join(on, [*by, "variant"], "left_anti").groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))


def map_domain(grid: DataFrame, wild_type: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The colour domain: 2nd to 98th percentile, symmetric about the wild type's score (0 without one)."""
    q = quantiles(grid, by, "value", {"lo": 0.02, "hi": 0.98}).join(wild_type.select(*by, F.col("score").alias("wt")), list(by), "left")
    centre = F.coalesce("wt", F.lit(0.0))
    span = F.greatest(centre - F.col("lo"), F.col("hi") - centre, F.lit(1e-9))
    return q.select(*by, centre.alias("center"), (centre - span).alias("min"), (centre + span).alias("max"))


def _substitutions(grid: DataFrame) -> DataFrame:
    return grid.where("value IS NOT NULL AND NOT is_reference")


def position_medians(grid: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Median score of each position's substitutions (a position has at most twenty)."""
    return _substitutions(grid).groupBy(*by, "position").agg(F.percentile("value", 0.5).alias("median"), F.count("value").alias("n"))


def residue_medians(grid: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Median score of the substitutions to each residue."""
    return median(_substitutions(grid), [*by, "alt"], "value", "median", count="n")


def builtin_tracks(grid: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Per position: share of designed substitutions scored, median effect, median SE."""
    designed = grid.where("state <> 'not designed' AND NOT is_reference")
    scored = F.col("state").isin("scored", "low")
    return designed.groupBy(*by, "position").agg(
        F.avg(F.when(scored, 1.0).otherwise(0.0)).alias("coverage"), F.percentile(F.when(scored, F.col("score")), 0.5).alias("effect"), F.percentile(F.when(scored, F.col("se")), 0.5).alias("uncertainty")
    )


def variant_track(entries: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Annotation values by position: mean, largest, and how many entries."""
    return entries.groupBy(*by, "position").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def class_stacks(entries: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return entries.where("cls IS NOT NULL").groupBy(*by, "position", "cls").agg(F.count(F.lit(1)).alias("n"))


def filter_track(entries: DataFrame, classes: Sequence[str] | None = None, stars: int | None = None, minimum: float | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Entries of the chosen classes or types, with at least so many stars and at least the value."""
    out = entries
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    if classes is not None:
        out = out.where(F.col("cls").isin(*classes))
    if stars is not None:
        out = out.where(F.coalesce("stars", F.lit(0)) >= stars)
    return out if minimum is None else out.where(F.col("value") >= minimum)


def allele_frequency(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Frequency of each protein change: over the nucleotide variants seen and passing filters."""
    ok = rows.where("(filters IS NULL OR filters = '') AND ac > 0 AND an > 0")
    return ok.groupBy(*by, "key").agg(F.sum(F.col("ac") / F.col("an")).alias("frequency"), F.sum("ac").alias("ac"), F.max("an").alias("an"), F.count(F.lit(1)).alias("n_variants"))


def position_values(grid: DataFrame, abnormal: Column, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Per position (stops left out): median, mean, extremes, share abnormal-like, spread, uncertainty, state."""
    rows = grid.where("state <> 'not designed' AND NOT is_reference AND alt <> '*'")
    shown = F.col("state").isin("scored", "low")
    v = F.when(shown, F.col("score"))
    out = rows.groupBy(*by, "position").agg(
        F.count(F.lit(1)).alias("designed"), F.count(v).alias("scored"), F.percentile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.avg(F.when(shown, F.when(abnormal, 1.0).otherwise(0.0))).alias("fraction_abnormal"), F.stddev_samp(v).alias("disagreement"), F.percentile(F.when(shown, F.col("se")), 0.5).alias("uncertainty"),
        F.count(F.when(F.col("state") == "low", 1)).alias("__low"), F.count(F.when(F.col("state") == "filtered", 1)).alias("__filtered"),
    )
    state = F.when(F.col("scored") == 0, F.when(F.col("__filtered") > 0, "filtered").otherwise("missing")).when(F.col("__low") == F.col("scored"), "low").otherwise("value")
    return out.withColumn("state", state).drop("__low", "__filtered")


# --- Selections ------------------------------------------------------------------------------------

# Groups of residues by chemistry.
RESIDUE_GROUPS = {"hydrophobic": "AVILMFWC", "aromatic": "FWYH", "polar": "STNQCY", "charged": "DEKRH", "positive": "KRH", "negative": "DE", "small": "AGSCTPDN", "aliphatic": "AVILM", "proline": "P", "stop": "*"}


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def at_positions(*ranges: tuple[int, int]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | F.col("position").between(a, b)
    return F.coalesce(out, F.lit(False))


def residue_in(column: str, group: str) -> Column:
    """The reference (``ref_aa``) or new residue (``alt``) is the letter, or in the group."""
    return F.coalesce(F.col(column).isin(*RESIDUE_GROUPS.get(group, group)), F.lit(False))


def compare(column: str, op: str, value: float) -> Column:
    c = F.col(column)
    test = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "=": c == value}[op]
    return F.coalesce(test, F.lit(False))


def select(rows: DataFrame, predicate: Column) -> DataFrame:
    """Keys of the rows where the predicate holds; predicates combine with &, | and ~."""
    return rows.where(predicate).select("dataset_id", "variant").distinct()


def combine(current: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """A selection replaced, added to, intersected with, or less another."""
    if how == "replace":
        return new
    if how == "add":
        return current.unionByName(new).distinct()
    if how == "intersect":
        return current.join(new, current.columns, "left_semi")
    if how == "subtract":
        return current.join(new, current.columns, "left_anti")
    raise ValueError(f"unknown operation {how!r}")


def listed(scores: DataFrame, columns: Sequence[str], sort: str, descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a score listing, sorted with missing values last."""
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return scores.orderBy(order, "dataset_id", "variant").select(*columns).offset(offset).limit(limit)
