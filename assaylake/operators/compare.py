"""Two score sets compared, and two runs of one experiment told apart."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import MEDIAN_CHI2_1, Z95
from assaylake.functions.kernels import normal_two_sided
from assaylake.functions.lineage import cut
from assaylake.functions.order import benjamini_hochberg, median, quantiles
from assaylake.operators.filters import rescale

Q = 0.05


def compare_filter(rows: DataFrame, low_confidence: bool = True, max_se: float | None = None, min_input: float | None = None) -> DataFrame:
    """Rows with ``keep``: not low confidence (``flags``), SE and input count within limits."""
    keep = F.col("score").isNotNull()
    if not low_confidence:
        keep = keep & (F.col("flags") == 0)
    if max_se is not None:
        keep = keep & F.coalesce(F.col("se") <= max_se, F.lit(False))
    if min_input is not None:
        keep = keep & F.coalesce(F.col("input") >= min_input, F.lit(False))
    return rows.withColumn("keep", keep)


def anchor_scale(side: DataFrame, preset: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """A side's scores on the anchors' scale, with the anchors' variance of each (``anchor_var``)."""
    return rescale(side, preset, by).withColumn("anchor_var", F.coalesce(F.col("se_scale") * F.col("se_scale"), F.lit(0.0)))


def discordance(both: DataFrame) -> DataFrame:
    """Matched scores with ``diff`` and ``z`` of their difference, the anchors' variances included."""
    extra = reduce(lambda a, c: a + F.coalesce(F.col(c), F.lit(0.0)), [c for c in ("anchor_var_a", "anchor_var_b") if c in both.columns], F.lit(0.0))
    v = F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b") + extra
    return both.withColumn("diff", F.col("score_a") - F.col("score_b")).withColumn("var", v).withColumn("z", F.when(v > 0, F.col("diff") / F.sqrt(v)))


def discordant(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    out = benjamini_hochberg(cut(rows.withColumn("p", F.when(F.col("z").isNotNull(), normal_two_sided("z")))), by)
    return out.withColumn("discordant", F.coalesce(F.col("q") < Q, F.lit(False)))


def dispersion(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Median z² over the median of χ²₁: about 1 when SEs describe the differences."""
    z2 = rows.where("z IS NOT NULL").withColumn("z2", F.col("z") * F.col("z"))
    return median(z2, by, "z2", "m", count="tested").select(*by, "tested", (F.col("m") / MEDIAN_CHI2_1).alias("dispersion"))


def position_disagreement(rows: DataFrame, by: Sequence[str] = ("dataset_id",), minimum: int = 3) -> DataFrame:
    """Per position: variants compared, mean and root mean square difference, and z of three or more."""
    out = rows.where("position IS NOT NULL AND diff IS NOT NULL").groupBy(*by, "position").agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rms"), F.sum("diff").alias("__s"), F.sum("var").alias("__v")
    )
    return out.withColumn("z", F.when((F.col("n") >= minimum) & (F.col("__v") > 0), F.col("__s") / F.sqrt("__v"))).drop("__s", "__v")


def by_predictor_class(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Measured scores by a predictor's class: how many, median and quartiles."""
    return quantiles(rows.where("cls IS NOT NULL"), [*by, "cls"], "score", {"low": 0.25, "median": 0.5, "high": 0.75}, count="n")


def difference_map(grid: DataFrame, a: DataFrame, b: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Two sides on the map: first less second where both are scored, else what is missing."""
    side = lambda df, s: df.where("kind <> 'wild type'").select(*by, "position", "alt", F.col("score").alias(f"score_{s}"), F.lit(1).alias(f"__{s}"))
    out = grid.join(side(a, "a"), [*by, "position", "alt"], "left").join(side(b, "b"), [*by, "position", "alt"], "left")
    state = F.when(F.col("alt") == F.col("ref_aa"), "reference").when(F.col("score_a").isNull(), "missing").when(F.col("score_b").isNull(), "filtered").otherwise("scored")
    return out.withColumn("state", state).withColumn("value", F.col("score_a") - F.col("score_b")).drop("__a", "__b")


# --- Two runs ----------------------------------------------------------------------------------------


def join_runs(a: DataFrame, b: DataFrame, factor: float = 1.0, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Two runs' calls variant by variant; the later effects in the earlier run's units.

    ``a, b(dataset_id, variant, call, effect, se)``, call NULL where not scored.
    """
    keys = [*by, "variant"]
    side = lambda df, s: df.select(*keys, F.col("call").alias(f"call_{s}"), F.col("effect").alias(f"effect_{s}"), F.col("se").alias(f"se_{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer").withColumn("effect_b", F.col("effect_b") * factor)
    z = F.when(F.col("call_a").isNotNull() & F.col("call_b").isNotNull() & (F.col("se_a") > 0), (F.col("effect_b") - F.col("effect_a")) / F.col("se_a"))
    out = both.withColumn("z", z)
    return out.withColumn("moved", F.coalesce(F.abs("z") > Z95, F.lit(False))).withColumn("crossed", F.coalesce(F.col("call_a") != F.col("call_b"), F.lit(False)))


def diff_runs(joined: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How many variants are in both, moved, crossed class, newly filtered, newly scored."""
    a, b = F.col("call_a").isNotNull(), F.col("call_b").isNotNull()
    n = lambda test: F.count(F.when(test, 1))
    return joined.groupBy(*by).agg(n(a & b).alias("both"), n(F.col("moved")).alias("moved"), n(F.col("crossed")).alias("crossed"), n(a & ~b).alias("filtered"), n(~a & b).alias("scored"))


def largest_changes(joined: DataFrame, top: int = 25, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The moved and crossed variants of each dataset, largest first."""
    size = F.round(F.abs(F.coalesce("z", F.lit(0.0))), 9)
    w = Window.partitionBy(*by).orderBy(size.desc(), "variant")
    return joined.where("moved OR crossed").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def crossings(joined: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return joined.where("crossed").groupBy(*by, F.col("call_a").alias("from_call"), F.col("call_b").alias("to_call")).agg(F.count(F.lit(1)).alias("n"))


def change_map(joined: DataFrame, cells: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """After less before on the map, where both runs score the variant."""
    ok = joined.where("call_a IS NOT NULL AND call_b IS NOT NULL").select(*by, "variant", (F.col("effect_b") - F.col("effect_a")).alias("change"))
    return cells.join(ok, [*by, "variant"], "left")


def finding_changes(a: DataFrame, b: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Findings whose verdict differs between two runs."""
    x = a.select(*by, "finding", F.col("status").alias("before"))
    y = b.select(*by, "finding", F.col("status").alias("after"))
    both = x.join(y, [*by, "finding"], "full_outer").na.fill("not assessed", ["before", "after"])
    return both.where("before <> after")


def row_changes(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two tables of parameters or design, and which columns."""
    values = [c for c in a.columns if c in b.columns and c not in keys]
    x = a.select(*keys, *[F.col(c).alias(f"{c}__a") for c in values], F.lit(1).alias("__a"))
    y = b.select(*keys, *[F.col(c).alias(f"{c}__b") for c in values], F.lit(1).alias("__b"))
    both = x.join(y, list(keys), "full_outer")
    names = F.filter(F.array(*[F.when(~F.col(f"{c}__a").eqNullSafe(F.col(f"{c}__b")), F.lit(c)) for c in values]), lambda n: n.isNotNull())
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(names) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", F.array_join(names, ",")).alias("columns")).where("change IS NOT NULL")


def run_digest(table: DataFrame, parameters: dict, by: Sequence[str] = ("dataset_id",), digits: int = 9) -> DataFrame:
    """A run's id from its parameters, and per dataset a digest that any order of rows shares.

    Doubles are rounded first. The digest is the number of rows and two sums over row hashes.
    """
    run_id = F.sha2(F.lit(json.dumps(parameters, sort_keys=True)), 256)
    cells = [F.coalesce((F.round(c, digits) + 0.0 if t == "double" else F.col(c)).cast("string"), F.lit("\u0000")) for c, t in sorted(table.dtypes) if c not in by]
    text = F.concat_ws("\u0001", *cells)
    h = F.xxhash64(text)
    sums = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    return sums.select(*by, run_id.alias("run_id"), F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("digest"), "n")


def reproduced(a: DataFrame, b: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Whether two runs' digests agree, dataset by dataset."""
    x, y = a.select(*by, F.col("digest").alias("__a")), b.select(*by, F.col("digest").alias("__b"))
    return x.join(y, list(by), "full_outer").select(*by, F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)).alias("reproduced"))
