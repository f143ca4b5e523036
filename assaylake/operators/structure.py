"""Effects on a structure: classes of positions, their tests, and spatial clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.kernels import normal_upper_tail
from assaylake.functions.lineage import cut
from assaylake.functions.order import benjamini_hochberg, quantiles, value_steps
from assaylake.operators.assemble import neighbor_pairs

BURIED = 0.25
CLASSES = ("disordered", "interface", "buried", "exposed")


def structure_class(residues: DataFrame, contact: float = 4.0) -> DataFrame:
    """disordered, interface, buried (accessibility below 0.25) or exposed, from a residue table."""
    cls = (
        F.when(F.coalesce("disordered", F.lit(False)), "disordered").when(F.col("partner_distance") <= contact, "interface").when(F.col("rsa") < BURIED, "buried").when(F.col("rsa").isNotNull(), "exposed")
    )
    return residues.withColumn("class", cls)


def effects_by_class(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Each class's quartiles and its Mann–Whitney test against the rest (ties, continuity): ``u, z``.

    One ordering serves every class: running counts of each class per distinct value.
    """
    by = list(by)
    have = cut(rows.where("class IS NOT NULL AND value IS NOT NULL").select(*by, "class", "value"))
    steps = value_steps(have, by, "value", {f"c{i}": F.when(F.col("class") == c, 1).otherwise(0) for i, c in enumerate(CLASSES)})

    def u(i: int):
        rest, before = F.col("n") - F.col(f"c{i}"), F.col("n_before") - F.col(f"c{i}_before")
        return F.sum(F.col(f"c{i}") * (before + rest / 2.0)).alias(f"u{i}")

    sums = steps.groupBy(*by).agg(
        *[u(i) for i in range(len(CLASSES))], *[F.max(f"c{i}_total").alias(f"n{i}") for i in range(len(CLASSES))], F.max("n_total").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    tests = sums.select(*by, "n", "ties", F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"u{i}").alias("u"), F.col(f"n{i}").alias("n1")) for i, c in enumerate(CLASSES)])))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    tested = (n1 >= 3) & (n2 >= 3)
    z = (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2.0 - 0.5) / sigma
    tests = tests.where("n1 > 0").select(*by, "class", F.when(tested, F.col("u")).alias("u"), F.when(tested & (sigma > 0), z).alias("z"), F.when(tested, 1 - F.col("u") / (n1 * n2)).alias("below"))
    spread = quantiles(have, [*by, "class"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, count="n")
    return spread.join(tests, [*by, "class"])


def effects_p_values(effects: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    p = effects.withColumn("p", F.least(F.lit(1.0), 2 * normal_upper_tail("z")))
    return benjamini_hochberg(p, by)


#: Draws of the cluster test, the share of positions called least tolerant, and the fewest and most strata.
PERMUTATIONS, LEAST_TOLERANT, STRATA = 1000, 0.2, (4, 16)


def cluster_strata(n: int) -> int:
    """Strata of accessibility for ``n`` positions: about twelve positions each, from 4 to 16."""
    return int(min(STRATA[1], max(STRATA[0], np.floor(n / 12 + 0.5))))


def _clustered(positions: pd.DataFrame, pairs: pd.DataFrame, permutations: int, fraction: float, strata: int | None, seed: list[int]) -> tuple:
    """Observed pairs of one protein; their mean, and how many draws reached them, within strata and over all positions."""
    positions = positions.sort_values("position")
    name, n = positions["position"].to_numpy(), len(positions)
    k = max(2, int(np.floor(fraction * n + 0.5)))
    chosen = np.lexsort((name, positions["value"].to_numpy()))[:k]
    s = strata or cluster_strata(n)
    stratum = np.empty(n, int)
    stratum[np.lexsort((name, positions["rsa"].to_numpy()))] = np.minimum(s - 1, np.arange(n) * s // n)
    a, b = (np.searchsorted(name, pairs[c].to_numpy()) for c in ("a", "b"))
    wanted = np.bincount(stratum[chosen], minlength=s)
    rng = np.random.default_rng(seed)

    def counted(taken: np.ndarray) -> np.ndarray:
        return (taken[:, a] & taken[:, b]).sum(axis=1)

    mask = np.zeros((1, n), bool)
    mask[0, chosen] = True
    observed = int(counted(mask)[0])
    within, anywhere = [], []
    for start in range(0, permutations, 100):
        luck = rng.random((min(100, permutations - start), n))
        taken = np.zeros(luck.shape, bool)
        for i in np.flatnonzero(wanted):
            members = np.flatnonzero(stratum == i)
            picked = members[np.argsort(luck[:, members], axis=1)[:, : wanted[i]]]
            np.put_along_axis(taken, picked, True, axis=1)
        within.append(counted(taken))
        taken = np.zeros(luck.shape, bool)
        np.put_along_axis(taken, np.argsort(rng.random(luck.shape), axis=1)[:, :k], True, axis=1)
        anywhere.append(counted(taken))
    within, anywhere = np.concatenate(within), np.concatenate(anywhere)
    return n, k, s, observed, float(within.mean()), int((within >= observed).sum()), float(anywhere.mean()), int((anywhere >= observed).sum())


def cluster_test(coords: DataFrame, distance: float, permutations: int = PERMUTATIONS, fraction: float = LEAST_TOLERANT, strata: int | None = None, seed: int = 1, by: Sequence[str] = ("dataset_id",), least: int = 10) -> DataFrame:
    """Pairs of least tolerant positions within a distance, against draws stratified by accessibility and against draws from all positions.

    ``coords(dataset_id, position, x, y, z, rsa, value)``: a protein's positions; fewer than ``least`` give no row. Neighbour pairs are found by cells of space, and the draws of a protein, bounded by its length,
    are made in one task. ``expected, exceeded, p`` are of the stratified draws, ``any_…`` of the others: what burial alone would explain lies between the two.
    """
    by = list(by)
    rows = coords.where("value IS NOT NULL AND rsa IS NOT NULL AND x IS NOT NULL").select(*by, "position", "x", "y", "z", "rsa", "value")
    enough = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*by)
    placed = cut(rows.join(enough, by))
    pairs = cut(neighbor_pairs(placed, distance, by).select(*by, "a", "b"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def test(key, positions: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        got = _clustered(positions, near, permutations, fraction, strata, [seed, *"|".join(map(str, key)).encode()])
        return pd.DataFrame([[*key, *got]], columns=[*by, "n", "k", "strata", "observed", "expected", "exceeded", "any_expected", "any_exceeded"])

    out = placed.groupBy(*by).cogroup(pairs.groupBy(*by)).applyInPandas(test, f"{kinds}, n long, k long, strata long, observed long, expected double, exceeded long, any_expected double, any_exceeded long")
    share = lambda c: (1 + F.col(c)) / (permutations + 1.0)
    return out.withColumn("p", share("exceeded")).withColumn("any_p", share("any_exceeded"))
