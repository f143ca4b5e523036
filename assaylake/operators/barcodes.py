"""Barcode tables: maps, sums per variant, disagreement, outliers, barcode scores combined.

A variant may carry any number of barcodes (the wild type a third of a library), so nothing here
gathers a variant's barcodes unless their number was checked first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import MEDIAN_CHI2_1
from assaylake.functions.lineage import cut
from assaylake.functions.order import median
from assaylake.operators.combine import combine_fixed, combine_mean, combine_reml_large

GROUP = ("dataset_id", "replicate_id", "variant")
# Names that mean "no variant" or "no barcode".
BLANK = ("", "NA", "N/A", "NaN", "null", "None")


def barcode_map(pairs: DataFrame) -> DataFrame:
    """A barcode-to-variant map read strictly: ``variant`` NULL and ``status`` conflict when given two.

    Repeats of the same pair are harmless; ``repeats`` counts them.
    """
    named = pairs.where(F.col("variant").isNotNull() & ~F.trim("variant").isin(*BLANK))
    return named.groupBy("dataset_id", "barcode").agg(
        F.when(F.min("variant") == F.max("variant"), F.min("variant")).alias("variant"),
        F.when(F.min("variant") == F.max("variant"), "mapped").otherwise("conflict").alias("status"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    )


def apply_barcode_map(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Barcode counts with their variant; barcodes not in the map, or in conflict, get NULL."""
    return counts.join(mapping.select("dataset_id", "barcode", "variant", "status"), ["dataset_id", "barcode"], "left").withColumn(
        "status", F.coalesce("status", F.lit("unmapped"))
    )


def uncounted_barcodes(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped barcodes that no sample counts."""
    return mapping.join(counts.select("dataset_id", "barcode").distinct(), ["dataset_id", "barcode"], "left_anti")


def barcode_problems(rows: DataFrame) -> DataFrame:
    """Barcodes on several rows of one table, and rows without a barcode, per dataset."""
    blank = F.col("barcode").isNull() | F.trim("barcode").isin(*BLANK)
    repeated = rows.where(~blank).groupBy("dataset_id", "barcode").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    blanks = rows.where(blank).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return repeated.withColumn("problem", F.lit("repeated")).unionByName(
        blanks.withColumn("barcode", F.lit(None).cast("string")).withColumn("problem", F.lit("blank"))
    )


def sum_barcodes(counts: DataFrame, keys: Sequence[str] = ("dataset_id", "variant", "sample_id")) -> DataFrame:
    """Counts summed over a variant's barcodes: missing ones skipped, missing only when all are."""
    return counts.where("variant IS NOT NULL").groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.count("cnt").alias("n_barcodes"))


def _leave_one_out_z(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``k`` and ``dev``: each score against the weighted mean of its variant's others."""
    w = 1 / (F.col("se") * F.col("se"))
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("__sw"), F.sum(w * F.col("score")).alias("__swy"))
    others = F.col("__sw") - w
    dev = (F.col("score") - (F.col("__swy") - w * F.col("score")) / others) / F.sqrt(F.col("se") * F.col("se") + 1 / others)
    return rows.join(sums, list(group)).withColumn("dev", F.when(F.col("k") >= 2, dev)).drop("__sw", "__swy")


def barcode_disagreement(rows: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Used barcodes with ``dev`` (leave-one-out z), ``phi`` of their replicate and ``z`` = dev/√φ.

    φ is the median dev² over the median of χ²₁, at least 1; z is NULL for fewer than three.
    """
    by = list(group[:-1])
    dev = cut(_leave_one_out_z(cut(rows), group))
    squares = dev.where("dev IS NOT NULL").withColumn("__d2", F.col("dev") * F.col("dev"))
    phi = median(squares, by, "__d2", "__m", count="compared").select(
        *by, F.greatest(F.lit(1.0), F.col("__m") / MEDIAN_CHI2_1).alias("phi"), "compared"
    )
    scale = F.sqrt(F.coalesce("phi", F.lit(1.0)))
    return dev.join(phi, by, "left").withColumn("z", F.when(F.col("k") >= 3, F.col("dev") / scale))


#: How far below its limit a barcode is a candidate, and candidates of a variant worked through at once.
MARGIN, HELD = 1.0, 4096


def _set_aside(y: np.ndarray, v: np.ndarray, scale: float, limit: float, alive: int, sw: float, swy: float) -> tuple:
    """Removes the worst of a variant's candidates until none departs by more than ``limit`` from all others.

    ``alive, sw, swy`` are the totals of the whole variant, from which each candidate's departure follows. Gives the departure of each removed one (NaN for those that stay),
    what is left of the totals, and between which bounds the mean and the total weight moved meanwhile.
    """
    w, z = 1 / v, np.full(len(y), np.nan)
    there = np.ones(len(y), bool)
    means, weights = [swy / sw], [sw]
    while alive >= 3 and there.any():
        i = np.flatnonzero(there)
        others = sw - w[i]
        now = (y[i] - (swy - w[i] * y[i]) / others) / np.sqrt(v[i] + 1 / others) / scale
        worst = int(np.argmax(np.abs(now)))
        if not abs(now[worst]) > limit:
            break
        j = i[worst]
        z[j], there[j] = now[worst], False
        alive, sw, swy = alive - 1, sw - w[j], swy - w[j] * y[j]
        means.append(swy / sw), weights.append(sw)
    return z, alive, sw, swy, min(means), max(means), min(weights), max(weights)


def barcode_outliers(rows: DataFrame, limit: float = 4.0, group: Sequence[str] = GROUP, held: int = HELD) -> DataFrame:
    """Barcodes with ``z`` and whether each is an ``outlier``, the worst set aside one at a time; variants of any size.

    ``rows`` are used barcodes with ``score, se``. Only candidates, near the limit or beyond, travel as an array; the rest of a variant stands by its
    totals. A pass then bounds, from how far mean and weight moved, whether any other barcode could have been the worst; such ones become candidates too. A variant with more than
    ``held`` candidates is worked through under a higher limit first, which removes the same ones in the same order. The number of jobs does not depend on
    the number of outliers below ``held`` a variant. An outlier's z is the one it was removed for; where fewer than three barcodes are left, they have none.
    """
    group = list(group)
    w = 1 / (F.col("se") * F.col("se"))
    alive = cut(barcode_disagreement(rows.select(*group, "barcode", "score", "se"), group).select(*group, "barcode", "score", "se", "k", "phi", "z"))
    far = F.abs("z")
    gone = None

    @F.pandas_udf("z array<double>, alive long, sw double, swy double, low double, high double, least double, most double")
    def settle(y: pd.Series, se: pd.Series, phi: pd.Series, lim: pd.Series, n: pd.Series, sw: pd.Series, swy: pd.Series) -> pd.DataFrame:
        got = [
            _set_aside(np.asarray(a, float), np.square(np.asarray(s, float)), float(np.sqrt(p)) if p == p and p else 1.0, x, int(k), t, u)
            for a, s, p, x, k, t, u in zip(y, se, phi.astype(float), lim, n, sw, swy)
        ]
        return pd.DataFrame(got, columns=["z", "alive", "sw", "swy", "low", "high", "least", "most"])

    todo = alive.where("k >= 3")
    while True:
        n_parts = 1000
        near = todo.groupBy(*group).agg(
            F.max(far).alias("_top"), F.count_if(far > limit - MARGIN).alias("_n"), F.percentile_approx(F.when(far > limit - MARGIN, far), [i / n_parts for i in range(n_parts)], 10_000).alias("_q"),
            F.count(F.lit(1)).alias("_alive"), F.sum(w).alias("_sw"), F.sum(w * F.col("score")).alias("_swy"), F.max("phi").alias("_phi"),
        ).where(F.col("_top") > limit)
        many = F.col("_n") > held
        cut_at = F.get("_q", F.ceil(n_parts * (1 - held / F.col("_n"))).cast("int"))
        wave = cut(near.withColumn("_floor", F.when(many, F.coalesce(cut_at, F.lit(limit - MARGIN))).otherwise(limit - MARGIN)).withColumn("_lim", F.when(many, F.col("_floor") + MARGIN).otherwise(limit)).drop("_q"))
        if wave.isEmpty():
            break
        both = todo.join(wave, group)
        while True:
            chosen = both.where(far > F.col("_floor"))
            arrays = chosen.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("barcode", "score", "se"))).alias("m"), *[F.max(c).alias(c) for c in ("_floor", "_lim", "_alive", "_sw", "_swy", "_phi")])
            part = lambda c: F.transform("m", lambda r: r[c])
            settled = cut(arrays.withColumn("s", settle(part("score"), part("se"), "_phi", "_lim", "_alive", "_sw", "_swy")).select(*group, "m", "_floor", "_lim", "s.*"))
            # Beyond what any mean and weight on the way could give: |y - mean| W / (W - w) over the root of v + 1 / (W - w).
            moved = both.drop("_floor", "_lim").join(settled.drop("m").withColumnRenamed("z", "_zs"), group).where(far <= F.col("_floor"))
            reach = F.greatest(F.abs(F.col("score") - F.col("low")), F.abs(F.col("score") - F.col("high"))) * F.col("least") / (F.col("least") - w)
            bound = reach / F.sqrt(1 / w + 1 / (F.col("most") - w)) / F.sqrt(F.coalesce("phi", F.lit(1.0)))
            missed = cut(moved.where((F.col("least") <= w) | (bound > F.col("_lim"))).groupBy(*group).agg(F.min(far).alias("_low")))
            if missed.isEmpty():
                break
            both = both.join(missed, group, "left").withColumn("_floor", F.least(F.col("_floor"), F.coalesce(F.col("_low") * (1 - 1e-9) - 1e-12, F.col("_floor")))).drop("_low")
        out = settled.select(*group, F.explode(F.arrays_zip("m", F.col("z"))).alias("r")).select(*group, "r.m.barcode", F.col("r.z").alias("_z")).where(F.col("_z").isNotNull() & ~F.isnan("_z"))
        out = cut(out)
        gone = out if gone is None else gone.unionByName(out)
        # Variants whose limit was raised go on from what is left of them.
        left = settled.where(F.col("_lim") > limit).select(*group, F.col("alive").alias("k2"), F.col("sw").alias("_w"), F.col("swy").alias("_wy"))
        if left.isEmpty():
            break
        rest = todo.join(left, group).join(out, [*group, "barcode"], "left_anti")
        others = F.col("_w") - w
        dev = (F.col("score") - (F.col("_wy") - w * F.col("score")) / others) / F.sqrt(1 / w + 1 / others)
        todo = cut(rest.where("k2 >= 3").select(*group, "barcode", "score", "se", F.col("k2").alias("k"), "phi", (dev / F.sqrt(F.coalesce("phi", F.lit(1.0)))).alias("z")))
    if gone is None:
        return alive.select(*group, "barcode", "score", "se", "phi", "z", F.lit(False).alias("outlier"))
    gone = cut(gone)
    sums = gone.join(alive.select(*group, "barcode", "score", "se"), [*group, "barcode"]).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_gw"), F.sum(w * F.col("score")).alias("_gwy"))
    totals = alive.join(sums.select(*group), group, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("_k"), F.sum(w).alias("_sw"), F.sum(w * F.col("score")).alias("_swy")).join(sums, group)
    totals = totals.select(*group, (F.col("_k") - F.col("_n")).alias("_left"), (F.col("_sw") - F.col("_gw")).alias("_w"), (F.col("_swy") - F.col("_gwy")).alias("_wy"))
    marked = alive.join(totals, group, "left").join(gone, [*group, "barcode"], "left")
    others = F.col("_w") - w
    again = (F.col("score") - (F.col("_wy") - w * F.col("score")) / others) / F.sqrt(1 / w + 1 / others) / F.sqrt(F.coalesce("phi", F.lit(1.0)))
    z = F.when(F.col("_z").isNotNull(), F.col("_z")).when(F.col("_left").isNull(), F.col("z")).when(F.col("_left") >= 3, again)
    return marked.select(*group, "barcode", "score", "se", "phi", z.alias("z"), F.col("_z").isNotNull().alias("outlier"))


def combine_barcodes(rows: DataFrame, how: str = "reml", group: Sequence[str] = GROUP) -> DataFrame:
    """A variant's used barcodes combined within a replicate: ``k, score, se``."""
    if how == "fixed":
        return combine_fixed(rows, group)
    if how == "mean":
        return combine_mean(rows, group)
    return combine_reml_large(rows, group)


def variant_states(barcodes: DataFrame, min_barcodes: int = 1, group: Sequence[str] = GROUP) -> DataFrame:
    """A variant's state in a replicate from its barcodes': used with enough, else the furthest any got."""
    # How far each state is along the stages.
    rank = F.create_map(*[F.lit(x) for p in {"few barcodes": 4.5, "total count": 4.0, "input count": 3.0, "few points": 2.0, "not counted": 1.0, "not estimable": 0.0}.items() for x in p])
    seen = F.when(F.col("state") == "used", "few barcodes").otherwise(F.col("state"))
    return (
        barcodes.withColumn("__s", seen)
        .groupBy(*group)
        .agg(F.count(F.when(F.col("state") == "used", 1)).alias("measured"), F.max_by("__s", rank[F.col("__s")]).alias("__best"))
        .select(*group, "measured", F.when(F.col("measured") >= min_barcodes, "used").otherwise(F.col("__best")).alias("state"))
    )
