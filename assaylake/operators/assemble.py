"""Table assembly: checks of counts, shared samples, tiles, controls, matching and annotation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_checks(counts: DataFrame, by: Sequence[str] = ("dataset_id", "sample_id")) -> DataFrame:
    """Per sample: total, observed, zeros, missing, negative and fractional counts, and the problem level."""
    c = F.col("cnt")
    n = lambda test: F.count(F.when(test, 1))
    out = counts.groupBy(*by).agg(
        F.sum(c).alias("total"), n(c.isNotNull() & (c != 0)).alias("observed"), n(c == 0).alias("zeros"), n(c.isNull()).alias("missing"), n(c < 0).alias("negative"), n(c != F.floor(c)).alias("non_integer")
    )
    return out.withColumn("problem", F.when(F.col("negative") > 0, "error").when((F.col("non_integer") > 0) | (F.col("observed") == 0), "warning"))


def problems(counts: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Datasets that must not be scored, and why (a negative count, a variant written twice in a sample)."""
    negative = count_checks(counts).where("negative > 0").select(*by).distinct().withColumn("problem", F.lit("negative counts"))
    twice = counts.groupBy(*by, "sample_id", "variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by).distinct().withColumn("problem", F.lit("a variant on more than one row"))
    return negative.unionByName(twice)


def identical_samples(counts: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Pairs of samples equal count for count: candidates by digest, then checked row by row."""
    row = F.xxhash64("variant", F.coalesce(F.col("cnt").cast("string"), F.lit("missing"))).cast("decimal(38,0)")
    digests = counts.groupBy(*by, "sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest"), F.bit_xor(F.xxhash64("variant", "cnt")).alias("x"))
    a = digests.withColumnRenamed("sample_id", "sample_a")
    b = digests.withColumnRenamed("sample_id", "sample_b")
    pairs = a.join(b, [*by, "n", "digest", "x"]).where("sample_a < sample_b").select(*by, "sample_a", "sample_b", "n")
    left = counts.select(*by, F.col("sample_id").alias("sample_a"), "variant", F.col("cnt").alias("__ca")).join(pairs, [*by, "sample_a"])
    right = counts.select(*by, F.col("sample_id").alias("sample_b"), "variant", F.col("cnt").alias("__cb"))
    equal = left.join(right, [*by, "sample_b", "variant"]).where(F.col("__ca").eqNullSafe(F.col("__cb")))
    checked = equal.groupBy(*by, "sample_a", "sample_b").agg(F.count(F.lit(1)).alias("same"), F.max("n").alias("n"))
    return checked.where("same = n").select(*by, "sample_a", "sample_b", "n")


def attach_design(counts: DataFrame, design: DataFrame) -> DataFrame:
    """Counts with the replicate and role of their sample; a shared sample appears in each replicate."""
    return counts.join(design, ["dataset_id", "sample_id"])


def shared_samples(design: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of replicates using one sample whose tiles can hold the same variant."""
    slots = design.select("dataset_id", "sample_id", "replicate_id", "condition", "tile").distinct().join(tiles, ["dataset_id", "tile"], "left")
    side = lambda s: slots.select("dataset_id", "sample_id", *[F.col(c).alias(f"{c}_{s}") for c in ("replicate_id", "condition", "tile", "pos_start", "pos_end")])
    pairs = side("a").join(side("b"), ["dataset_id", "sample_id"]).where("replicate_id_a < replicate_id_b")
    apart = F.col("pos_start_a").isNotNull() & F.col("pos_start_b").isNotNull() & ((F.col("pos_start_a") > F.col("pos_end_b")) | (F.col("pos_start_b") > F.col("pos_end_a")))
    same_condition = F.col("condition_a").eqNullSafe(F.col("condition_b"))
    return pairs.where(~apart).select("dataset_id", "sample_id", "replicate_id_a", "replicate_id_b", same_condition.alias("within_condition"))


def apply_tiles(rows: DataFrame, tiles: DataFrame, counts: Sequence[str] = ("cnt",)) -> DataFrame:
    """Counts outside a replicate's tile become missing; rows without a position belong to every tile."""
    out = rows.join(tiles, ["dataset_id", "tile"], "left")
    inside = F.col("tile").isNull() | F.col("pos_start").isNull() | F.col("position").isNull() | F.col("position").between(F.col("pos_start"), F.col("pos_end"))
    for c in counts:
        out = out.withColumn(c, F.when(inside, F.col(c)))
    return out.withColumn("outside_tile", ~inside).drop("pos_start", "pos_end")


def control_rows(variants: DataFrame, controls: DataFrame) -> DataFrame:
    """Variants serving as controls of a class, by kind, within the positions where the class serves.

    ``controls(dataset_id, class, mode, pos_start, pos_end)``; mode 'none' switches a class off.
    """
    active = controls.where("mode <> 'none'").withColumnRenamed("class", "kind")
    near = (F.col("pos_start").isNull() | (F.col("position") >= F.col("pos_start"))) & (F.col("pos_end").isNull() | (F.col("position") <= F.col("pos_end")))
    return variants.join(active, ["dataset_id", "kind"]).where(near).drop("mode", "pos_start", "pos_end")


def match_variants(a: DataFrame, b: DataFrame, key: str = "variant", by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Two score sets variant by variant: ``score_a, se_a, score_b, se_b`` and where each is."""
    side = lambda df, s: df.where("kind <> 'wild type'").select(*by, key, *[F.col(c).alias(f"{c}_{s}") for c in ("score", "se")], F.lit(1).alias(f"__{s}"))
    both = side(a, "a").join(side(b, "b"), [*by, key], "full_outer")
    where = (
        F.when(F.col("__a").isNull(), "only b").when(F.col("__b").isNull(), "only a").when(F.col("score_a").isNull() | F.col("score_b").isNull(), "not scored").otherwise("both")
    )
    return both.withColumn("match", where).drop("__a", "__b")


def match_by_reference(a: DataFrame, b: DataFrame, offset_a: int, offset_b: int, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """As :func:`match_variants`, by reference position and alternative residue instead of the name."""
    shift = lambda df, o: df.where("position IS NOT NULL").withColumn("ref_key", F.concat_ws(":", F.col("position") + o, "alt"))
    return match_variants(shift(a, offset_a), shift(b, offset_b), "ref_key", by)


def match_counts(matched: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return matched.groupBy(*by, "match").agg(F.count(F.lit(1)).alias("n"))


def pair_replicates(design: DataFrame) -> DataFrame:
    """Replicates of two conditions paired by first sample and tile, equal biological numbers first.

    ``design(dataset_id, condition, is_reference, replicate_id, biological, tile, first_sample)``.
    Those left pair in order of replicate within the same sample and tile.
    """
    keys = ["dataset_id", "first_sample", "tile"]
    rows = design.withColumn("tile", F.coalesce("tile", F.lit("")))
    cols = ["replicate_id", "biological"]
    a = rows.where("is_reference").select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = rows.where("NOT is_reference").select(*keys, "condition", *[F.col(c).alias(f"{c}_b") for c in cols])
    same = a.join(b, keys).where("biological_a = biological_b")
    # A biological number may repeat: the first of each.
    wa = Window.partitionBy(*keys, "condition", "replicate_id_a").orderBy("replicate_id_b")
    wb = Window.partitionBy(*keys, "condition", "replicate_id_b").orderBy("replicate_id_a")
    first = same.withColumn("__i", F.row_number().over(wa)).withColumn("__j", F.row_number().over(wb)).where("__i = 1 AND __j = 1").select(*keys, "condition", "replicate_id_a", "replicate_id_b")
    conditions = b.select(*keys, "condition").distinct()
    rest_a = a.join(conditions, keys).join(first, [*keys, "condition", "replicate_id_a"], "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "condition").orderBy("replicate_id_a")))
    rest_b = b.join(first, [*keys, "condition", "replicate_id_b"], "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "condition").orderBy("replicate_id_b")))
    second = rest_a.join(rest_b, [*keys, "condition", "__n"]).select(*keys, "condition", "replicate_id_a", "replicate_id_b")
    return first.unionByName(second)


def match_controls(labels: DataFrame, scores: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Labelled variants against a run: scored, not scored, or not in the run."""
    run = scores.select(*by, F.col("variant").alias("key"), "score", F.lit(1).alias("__in"))
    found = F.when(F.col("__in").isNull(), "not in run").when(F.col("score").isNull(), "not scored").otherwise("scored")
    return labels.join(run, [*by, "key"], "left").withColumn("found", found).drop("__in")


def expand_features(features: DataFrame) -> DataFrame:
    """One row per position of a feature, so that overlap is an equality (features are short stretches)."""
    return features.where("pos_end >= pos_start").withColumn("position", F.explode(F.sequence("pos_start", "pos_end")))


def in_features(rows: DataFrame, features: DataFrame, pattern: str | None = None, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Rows whose position lies under a feature whose label or type matches (``*`` and ``?`` as wildcards)."""
    kept = features
    if pattern is not None:
        escaped = "".join(".*" if ch == "*" else "." if ch == "?" else ("\\" + ch if ch in ".^$+{}[]()|\\" else ch) for ch in pattern.lower())
        kept = features.where(F.lower("label").rlike(f"^{escaped}$") | F.lower("type").rlike(f"^{escaped}$"))
    under = expand_features(kept).select(*by, "position").distinct()
    return rows.join(under, [*by, "position"], "left_semi")


def annotate(scores: DataFrame, annotations: DataFrame, features: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Scores with each source's value of the variant, and the labels of the features at its position.

    ``annotations(dataset_id, source, key, value)`` in long form; one row per variant and source.
    """
    labels = expand_features(features).groupBy(*by, "position").agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("features"))
    named = annotations.select(*by, F.col("key").alias("variant"), "source", "value")
    return scores.join(named, [*by, "variant"], "left").join(labels, [*by, "position"], "left")


def neighbor_pairs(coords: DataFrame, distance: float, by: Sequence[str] = ("dataset_id",), label: str = "position") -> DataFrame:
    """Pairs of points within ``distance``: cells of that width, each point offered to its half of the neighbours.

    A point meets its own cell and the 13 cells after it in order, so that each pair meets once and
    no pair beyond the neighbouring cells is formed.
    """
    cell = [F.floor(F.col(c) / distance).cast("long") for c in ("x", "y", "z")]
    pts = coords.select(*by, label, "x", "y", "z", *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in steps])
    a = pts.withColumn("s", F.explode(shifts)).select(
        *by, F.col(label).alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"),
        (F.col("c0") + F.col("s.i")).alias("c0"), (F.col("c1") + F.col("s.j")).alias("c1"), (F.col("c2") + F.col("s.k")).alias("c2"),
        ((F.col("s.i") == 0) & (F.col("s.j") == 0) & (F.col("s.k") == 0)).alias("same"),
    )
    b = pts.select(*by, F.col(label).alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"), "c0", "c1", "c2")
    d2 = sum(((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in ("x", "y", "z")), F.lit(0.0))
    near = a.join(b, [*by, "c0", "c1", "c2"]).where(~F.col("same") | (F.col("a") < F.col("b"))).withColumn("d2", d2).where(F.col("d2") <= distance * distance)
    return near.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.sqrt("d2").alias("distance"))


def place_query(queries: DataFrame, targets: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The best ungapped placement of a query on a protein: ``shift, overlap, same``; at least 80% equal.

    Every shift is scored as an expression on the pair of sequences; the best is kept.
    """
    q, t = F.col("query"), F.col("protein")
    lq, lt = F.length(q), F.length(t)
    shifts = F.sequence(1 - lq, lt - 1)

    def score(shift: Column) -> Column:
        start, stop = F.greatest(F.lit(0), -shift), F.least(lq, lt - shift)
        at = F.sequence(start, stop - 1)
        same = F.size(F.filter(at, lambda j: F.substr(q, j + 1, F.lit(1)) == F.substr(t, j + shift + 1, F.lit(1))))
        return F.struct(same.alias("same"), (stop - start).alias("overlap"), shift.alias("shift"))

    enough = lambda x: (x["overlap"] >= F.least(F.lit(10), lq, lt)) & (x["overlap"] >= F.least(lq, lt) / 2)
    scored = F.filter(F.transform(shifts, score), enough)
    best = F.element_at(F.array_sort(F.transform(scored, lambda x: F.struct(x["same"].alias("same"), x["overlap"].alias("overlap"), (-x["shift"]).alias("back")))), -1)
    out = queries.join(targets, list(by)).withColumn("__b", best)
    return out.where(F.col("__b.same") >= 0.8 * F.col("__b.overlap")).select(*by, "query", (-F.col("__b.back")).alias("shift"), F.col("__b.overlap").alias("overlap"), F.col("__b.same").alias("same"))
