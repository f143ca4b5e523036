"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The median of a chi-square with one degree of freedom, the normal 97.5% quantile,
# the factor from a median absolute deviation to a normal SD.
MEDIAN_CHI2_1 = 0.454936423119572
Z95 = 1.959963984540054
MAD_TO_SD = 1.482602218505602


def finite(c: Column) -> Column:
    """NULL unless the value is a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def inverse(c: Column) -> Column:
    return F.when(c != 0, F.lit(1.0) / c)


def atanh(c: Column) -> Column:
    return F.when(F.abs(c) < 1, 0.5 * F.log((1 + c) / (1 - c)))


def tanh(c: Column) -> Column:
    return 1 - 2 / (F.exp(2 * c) + 1)


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Proportion with its Wilson score interval: (estimate, low, high); NULL for n = 0."""
    p = divide(x, n)
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return (
        p,
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)),
    )


def strict_sum(c: Column, expected: Column) -> Column:
    """A sum that is missing when any of the ``expected`` parts is."""
    return F.when(F.count(c) >= expected, F.sum(c))


def weighted_mean_parts(y: Column, v: Column) -> dict[str, Column]:
    """Aggregates for an inverse-variance mean, exact values (variance 0) kept apart."""
    return {
        "k": F.count(y),
        "k_exact": F.count(F.when(v == 0, y)),
        "sum_exact": F.sum(F.when(v == 0, y)),
        "sw": F.sum(F.when(v > 0, 1 / v)),
        "swy": F.sum(F.when(v > 0, y / v)),
        "swyy": F.sum(F.when(v > 0, y * y / v)),
        "sy": F.sum(y),
        "syy": F.sum(y * y),
        "v_any": F.max(v),
    }


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions and filters read instead of repeating their formulas.

    A chain of ``withColumn`` is one expression to the optimizer, copied wherever a name is used;
    columns out of a generator are not.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
