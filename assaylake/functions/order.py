"""Order statistics over groups of any size: ranks, quantiles, running sums, q-values.

A plain window over ``partitionBy(dataset)`` puts a whole dataset in one task, and ``percentile``
holds every distinct value of a group in one buffer. Both fail when one dataset holds a third of
all rows. Here rows are summed per distinct value first (map-side combined), so ties never travel, and written once.
Where every group has at most ``HELD`` distinct values, a window runs over a group. Otherwise groups are ordered in two levels:

1. each value of a larger group falls in one of 256 buckets between its group's own approximate quantiles, so buckets hold about equally many
   distinct values however these lie, and running sums are taken inside a bucket; a smaller group is one bucket;
2. what comes before a bucket is read from a table of bucket totals, at most 256 rows per group.

The results are exact. Buckets only decide how the work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.lineage import cut

_BUCKET = "__bucket"


BUCKETS = 256
#: Distinct values of a group that one window runs over.
HELD = 100_000


def _bucketed(steps: DataFrame, large: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``steps`` with the number of its group's quantiles below each value, found by halving; 0 in groups that are not ``large``."""
    inside = steps.join(large, list(keys), "left_semi") if keys else steps
    cuts = inside.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("__cuts"))
    halves = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])
    v = F.col(value).cast("double")
    below = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get("__cuts", at + half - 1) < v, half).otherwise(0))
    joined = steps.join(cuts, list(keys), "left") if keys else steps.join(cuts, F.lit(True))
    return joined.withColumn(_BUCKET, below).drop("__cuts")


def value_steps(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    *,
    ties: Sequence[str] = (),
    weight: Column | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """One row per (keys, distinct value), in order of value, with running counts and sums.

    Columns: keys, value, ``n`` (rows with the value), ``n_before`` (rows below it), ``n_total``
    (rows of the group), and for each name in ``sums``: the sum at the value, ``<name>_before``
    and ``<name>_total``. NULL and NaN values take no part. ``ties`` are further columns in the
    order (then a step is a distinct combination); ``weight`` counts a row several times. With ``keep_bucket``
    the bucket stays, as ``__bucket``.
    """
    keys, order = list(keys), [value, *ties]
    sums = dict(sums or {})
    names = ["n", *sums]
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    steps = cut(
        clean.groupBy(*keys, *order)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )
    large = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > HELD).select(*keys)
    if large.isEmpty():
        whole = Window.partitionBy(*keys)
        before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return steps.select(
            *keys,
            *([F.lit(0).alias(_BUCKET)] if keep_bucket else []),
            *order,
            *names,
            *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in names],
            *[F.sum(k).over(whole).alias(f"{k}_total") for k in names],
        )
    steps = _bucketed(steps, large, keys, value)
    per_bucket = steps.groupBy(*keys, _BUCKET).agg(*[F.sum(k).alias(f"__b_{k}") for k in names])
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"__b_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in names],
        *[F.sum(f"__b_{k}").over(whole).alias(f"{k}_total") for k in names],
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = steps.select(
        *keys,
        _BUCKET,
        *order,
        *names,
        *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"__l_{k}") for k in names],
    )
    return local.join(offsets, [*keys, _BUCKET]).select(
        *keys,
        *([_BUCKET] if keep_bucket else []),
        *order,
        *names,
        *[(F.col(f"__o_{k}") + F.col(f"__l_{k}")).alias(f"{k}_before") for k in names],
        *[f"{k}_total" for k in names],
    )


def small_groups(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group has more than ``HELD`` rows. It reads ``df`` once, which should be written."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > HELD).isEmpty()


def _row_steps(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """As ``value_steps``, a step a row, for groups known to be small: one shuffle by group, nothing summed or written before."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = clean.select(*keys, value, *ties, (F.lit(1) if weight is None else weight).cast("long").alias("n"))
    return rows.select(*rows.columns, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("n").over(whole).alias("n_total"))


def pick_order_statistics(
    steps: DataFrame, keys: Sequence[str], value: str, index: Mapping[str, Column]
) -> DataFrame:
    """The values at zero-based positions; each position is an expression of ``n_total``."""
    at = [
        F.max(
            F.when((F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n")), F.col(value))
        ).alias(name)
        for name, i in index.items()
    ]
    return steps.groupBy(*keys).agg(F.max("n_total").alias("n_total"), *at)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    count: str | None = None,
    weight: Column | None = None,
    small: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles (type 7) per group, and the group's size as ``count``; ``small`` where all groups are (``small_groups``)."""
    steps = _row_steps(df, keys, value, weight=weight) if small else value_steps(df, keys, value, weight=weight)
    last = F.col("n_total") - 1
    index: dict[str, Column] = {}
    for name, p in probs.items():
        low = F.floor(last * F.lit(float(p)))
        index[f"__lo_{name}"] = low
        index[f"__hi_{name}"] = F.least(low + 1, last)
    picked = pick_order_statistics(steps, keys, value, index)
    out = []
    for name, p in probs.items():
        h = last * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    counted = [F.col("n_total").alias(count)] if count else []
    return picked.select(*keys, *counted, *out)


def _known(value: Column) -> Column:
    """NULL for NaN: what takes no part in an order statistic."""
    return F.when(~F.isnan(value.cast("double")), value)


def with_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", count: str | None = None) -> DataFrame:
    """Every row with its group's median, and how many values it is of, for groups known to be small (``small_groups``): windows over one shuffle by group."""
    whole = Window.partitionBy(*keys)
    v = _known(F.col(value))
    rows = df.select("*", (F.row_number().over(whole.orderBy(v.asc_nulls_last())) - 1).alias("__at"), F.count(v).over(whole).alias("__n"))
    low = F.floor((F.col("__n") - 1) * 0.5)
    at = lambda i: F.max(F.when(F.col("__at") == i, v)).over(whole)
    lo, hi = at(low), at(F.least(low + 1, F.col("__n") - 1))
    h = (F.col("__n") - 1) * 0.5
    counted = [F.col("__n").alias(count)] if count else []
    return rows.select(*df.columns, *counted, (lo + (h - low) * (hi - lo)).alias(name))


def medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], count: str | None = None) -> DataFrame:
    """Medians of several columns per group of a ``df`` known to have small groups (``small_groups``), by one shuffle; ``count``: values of the first column."""
    for name, value in values.items():
        df = with_median(df, keys, value, f"__m_{name}", f"__c_{name}")
    first = next(iter(values))
    counted = [F.max(f"__c_{first}").alias(count)] if count else []
    return df.groupBy(*keys).agg(*counted, *[F.max(f"__m_{name}").alias(name) for name in values])


def row_ranks(value: Column, keys: Sequence[str]) -> Column:
    """A row's rank from 1 in its group, ties sharing their mean rank, NULL without a value; for groups known to be small."""
    v = _known(value)
    order = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    up_to = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(v.isNotNull(), (F.rank().over(order) + up_to) / 2.0)


def median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", count: str | None = None, weight: Column | None = None, small: bool = False
) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, count, weight, small)


def auc(df: DataFrame, keys: Sequence[str], value: str, first: Column, name: str = "auc") -> DataFrame:
    """P(a > b) + ½ P(a = b) of the rows where ``first`` holds (a) against the others (b)."""
    steps = value_steps(df, keys, value, {"__a": F.when(first, 1).otherwise(0), "__b": F.when(first, 0).otherwise(1)})
    wins = F.sum(F.col("__a") * (F.col("__b_before") + F.col("__b") / 2.0))
    n_a, n_b = F.max("__a_total"), F.max("__b_total")
    return steps.groupBy(*keys).agg(
        F.when((n_a > 0) & (n_b > 0), wins / n_a / n_b).alias(name), n_a.alias(f"{name}_n1"), n_b.alias(f"{name}_n2")
    )


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", small: bool = False) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean rank, and the group's size ``<name>_n``; ``small`` where all groups are (``small_groups``)."""
    if small:
        whole = Window.partitionBy(*keys)
        up_to = F.count(F.lit(1)).over(whole.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rank = ((F.rank().over(whole.orderBy(value)) + up_to) / 2.0).alias(name)
        return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("*", rank, F.count(F.lit(1)).over(whole).alias(f"{name}_n"))
    steps = value_steps(df, keys, value).select(
        *keys,
        value,
        (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(name),
        F.col("n_total").alias(f"{name}_n"),
    )
    return df.join(steps, [*keys, value])


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str = "p", name: str = "q") -> DataFrame:
    """Adds Benjamini–Hochberg adjusted p-values per family; missing p stays missing."""
    keys = list(keys)
    steps = value_steps(df, keys, p, keep_bucket=True).select(
        *keys,
        p,
        _BUCKET,
        (F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n"))).alias("__c"),
    )
    later = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(1, Window.unboundedFollowing)
    beyond = steps.groupBy(*keys, _BUCKET).agg(F.min("__c").alias("__m")).select(
        *keys, _BUCKET, F.min("__m").over(later).alias("__later")
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    adjusted = (
        steps.withColumn("__here", F.min("__c").over(inside))
        .join(beyond, [*keys, _BUCKET])
        .select(*keys, p, F.least(F.lit(1.0), "__here", "__later").alias(name))
    )
    return df.join(adjusted, [*keys, p], "left")


def equal_bins(
    df: DataFrame, keys: Sequence[str], value: str, bins: Column, ties: Sequence[str] = (), name: str = "bin", small: bool = False
) -> DataFrame:
    """Rows in ``bins`` groups of equal count by value, then ``ties``; ``bins`` may use ``n_total``.

    One row per distinct (value, ties) and bin, with the number of rows as ``weight``; equal rows
    on a border are divided between the bins they reach. With ``small`` (``small_groups``) equal rows stay apart.
    """
    steps = (_row_steps(df, keys, value, ties) if small else value_steps(df, keys, value, ties=ties)).withColumn("__bins", bins)
    bin_of = lambda i: F.ceil((i + 1) * F.col("__bins") / F.col("n_total")) - 1
    first, last = bin_of(F.col("n_before")), bin_of(F.col("n_before") + F.col("n") - 1)
    spread = steps.withColumn(name, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    start = F.greatest("n_before", F.floor(F.col(name) * F.col("n_total") / F.col("__bins")))
    end = F.least(F.col("n_before") + F.col("n"), F.floor((F.col(name) + 1) * F.col("n_total") / F.col("__bins")))
    return spread.select(*keys, value, *ties, "n_total", name, (end - start).alias("weight")).where("weight > 0")
