"""Quality control: metrics of samples, replicates, coverage, barcodes and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import MAD_TO_SD, MEDIAN_CHI2_1, settle
from assaylake.functions.lineage import cut
from assaylake.functions.order import auc, equal_bins, median, medians, pick_order_statistics, quantiles, row_ranks, small_groups, value_steps, with_average_rank, with_median
from assaylake.operators.agreement import robust_variance_line

# Counts below LOW are low, replicates are compared above AGREEMENT_INPUT reads.
LOW, AGREEMENT_INPUT, PSEUDOCOUNT = 10, 10, 0.5
# Residue order, and the genetic code with bases in the order T, C, A, G.
RESIDUES = "ARNDCQEGHILKMFPSTWYV*"
BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def variant_totals(counts: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How many variants each dataset lists."""
    return counts.select(*by, "variant").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_variants"))


def sample_metrics(counts: DataFrame, low: float = LOW, by: Sequence[str] = ("dataset_id", "sample_id"), small: bool = False) -> DataFrame:
    """Per sample: counted, missing, total, zeros, low counts, reads per variant and five quantiles; ``small`` where all samples are (``small_groups``)."""
    c = F.col("cnt")
    sums = counts.groupBy(*by).agg(
        F.count(c).alias("counted"), F.coalesce(F.sum(c), F.lit(0.0)).alias("total"), F.count(F.when(c == 0, 1)).alias("zeros"), F.count(F.when(c < low, 1)).alias("low")
    )
    spread = quantiles(counts, by, "cnt", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}, small=small)
    n = F.col("counted")
    return (
        sums.join(variant_totals(counts, by[:-1]), list(by[:-1]))
        .join(spread, list(by), "left")
        .withColumn("missing", F.col("n_variants") - n)
        .withColumn("missing_fraction", F.col("missing") / F.col("n_variants"))
        .withColumn("zero_fraction", F.when(n > 0, F.col("zeros") / n))
        .withColumn("low_fraction", F.when(n > 0, F.col("low") / n))
        .withColumn("reads_per_variant", F.when(n > 0, F.col("total") / n).otherwise(0.0))
    )


def count_histogram(counts: DataFrame, by: Sequence[str] = ("dataset_id", "sample_id")) -> DataFrame:
    """Counts in quarter-decade bins of log10(count + 1), as fractions of the variants counted."""
    binned = counts.where("cnt IS NOT NULL").withColumn("bin", F.floor(F.log10(F.col("cnt") + 1) * 4).cast("int"))
    hist = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = hist.groupBy(*by).agg(F.sum("n").alias("counted"))
    return hist.join(totals, list(by)).withColumn("fraction", F.col("n") / F.col("counted"))


def rank_abundance(counts: DataFrame, by: Sequence[str] = ("dataset_id", "sample_id"), points: int = 64) -> DataFrame:
    """Counts from the most to the least abundant, at about ``points`` geometric ranks."""
    steps = value_steps(counts, by, "cnt")
    top = points - 1
    ranks = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(top)),
            lambda k: F.least(F.col("n_total"), F.greatest(F.lit(1), F.floor(F.pow(F.col("n_total").cast("double"), k / top) + 0.5).cast("long"))),
        )
    )
    # A rank r from the top is position n_total − r from the bottom.
    inside = F.filter(
        "ranks", lambda r: (F.col("n_before") <= F.col("n_total") - r) & (F.col("n_total") - r < F.col("n_before") + F.col("n"))
    )
    return steps.withColumn("ranks", ranks).withColumn("rank", F.explode(inside)).select(*by, "rank", "cnt")


def coverage(grid: DataFrame, observed: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Designed substitutions, in the table, and seen before selection, by class.

    ``grid(dataset_id, position, ref_aa, alt)`` is every residue of every designed position;
    ``observed(dataset_id, position, alt, seen)`` the substitutions of the table.
    """
    seen = observed.groupBy(*by, "position", "alt").agg(F.max(F.col("seen").cast("int")).alias("seen"))
    cells = grid.where("ref_aa <> alt").join(seen, [*by, "position", "alt"], "left")
    cls = F.when(F.col("alt") == "*", "nonsense").otherwise("missense")
    out = cells.withColumn("class", cls).groupBy(*by, "class").agg(
        F.count(F.lit(1)).alias("designed"), F.count("seen").alias("in_table"), F.coalesce(F.sum("seen"), F.lit(0)).alias("observed")
    )
    return out.withColumn("fraction", F.col("observed") / F.col("designed"))


def translated(codon: Column) -> Column:
    """The residue of a codon, NULL when it holds a letter other than A, C, G, T."""
    digit = lambda i: F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1
    at = digit(1) * 16 + digit(2) * 4 + digit(3)
    return F.when(codon.rlike("^[TCAG]{3}$"), F.lit(GENETIC_CODE).substr(at + 1, F.lit(1)))


def reachable_substitutions(codons: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The residues one base change away from each codon: ``codons(dataset_id, position, codon)``."""
    codon = F.col("codon")
    edits = F.array(
        *[F.concat(codon.substr(1, i), F.lit(b), codon.substr(i + 2, 3)) for i in range(3) for b in BASES]
    )
    one = codons.select(*by, "position", "codon", F.explode(edits).alias("edited")).where("edited <> codon")
    return (
        one.withColumn("alt", translated(F.col("edited")))
        .where(F.col("alt") != translated(F.col("codon")))
        .select(*by, "position", "alt")
        .distinct()
    )


def coverage_snv(codons: DataFrame, observed: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Coverage of the substitutions one base change makes."""
    seen = observed.groupBy(*by, "position", "alt").agg(F.max(F.col("seen").cast("int")).alias("seen"))
    out = reachable_substitutions(codons, by).join(seen, [*by, "position", "alt"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("designed"), F.coalesce(F.sum("seen"), F.lit(0)).alias("observed")
    )
    return out.withColumn("fraction", F.col("observed") / F.col("designed"))


def stretches(positions: DataFrame, gap: int = 16, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Runs of positions at most ``gap`` apart: ``start, end, n``.

    Positions meet as bits of words of 64 before any shuffle; only the runs within a word, few where positions are dense, are put in order. Groups are as long as a protein.
    """
    kind = positions.schema["position"].dataType
    bit = F.expr("shiftleft(1L, cast(pmod(__p, 64) as int))")
    words = positions.select(*by, F.col("position").cast("long").alias("__p")).groupBy(*by, F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    words = settle(words, __at=F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("__bits", i) == 1))
    words = settle(words, __from=F.filter("__at", lambda x, i: F.coalesce(x - F.get("__at", i - 1) > gap, F.lit(True))))
    inside = lambda s, i: F.filter("__at", lambda x: (x >= s) & F.coalesce(x < F.get("__from", i + 1), F.lit(True)))
    whole = lambda x: F.shiftleft("__w", 6) + x
    pieces = F.transform("__from", lambda s, i: F.struct(whole(s).alias("start"), whole(F.array_max(inside(s, i))).alias("end"), F.size(inside(s, i)).cast("long").alias("n")))
    missing = F.expr("array(named_struct('start', cast(null as bigint), 'end', cast(null as bigint), 'n', 1L))")
    order = Window.partitionBy(*by).orderBy("start")
    marked = words.select(*by, F.inline(F.when(F.col("__w").isNull(), missing).otherwise(pieces))).withColumn(
        "__new", F.coalesce(F.col("start") - F.lag("end").over(order) > gap, F.lit(True)).cast("int")
    )
    runs = marked.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("start").cast(kind).alias("start"), F.max("end").cast(kind).alias("end"), F.sum("n").alias("n"))


def raw_ratios(pairs: DataFrame, agreement_input: float = AGREEMENT_INPUT) -> DataFrame:
    """Raw log ratio ``y`` and counting variance ``v`` of every replicate, and whether it is usable."""
    c0, ct = F.col("c0") + PSEUDOCOUNT, F.col("ct") + PSEUDOCOUNT
    return (
        pairs.where("c0 IS NOT NULL AND ct IS NOT NULL")
        .withColumn("y", F.log(ct) - F.log(c0))
        .withColumn("v", 1 / c0 + 1 / ct)
        .withColumn("usable", F.col("c0") >= agreement_input)
    )


def replicate_pairs(raw: DataFrame, keys: Sequence[str] = ("dataset_id", "variant")) -> DataFrame:
    """Every pair of a variant's usable replicates: ``rep_a, rep_b, ya, yb, va, vb``.

    Replicates of a variant are few by design; they meet as an array, after one shuffle.
    """
    reps = F.array_sort(F.collect_list(F.struct(F.col("replicate_id").alias("r"), "y", "v")))
    arrays = raw.where("usable").groupBy(*keys).agg(reps.alias("reps"))
    combos = F.flatten(
        F.transform("reps", lambda a, i: F.transform(F.slice("reps", i + 2, F.size("reps")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return arrays.select(*keys, F.explode(combos).alias("p")).select(
        *keys,
        F.col("p.a.r").alias("rep_a"),
        F.col("p.b.r").alias("rep_b"),
        F.col("p.a.y").alias("ya"),
        F.col("p.b.y").alias("yb"),
        F.col("p.a.v").alias("va"),
        F.col("p.b.v").alias("vb"),
    )


PAIR = ("dataset_id", "rep_a", "rep_b")


def pair_metrics(raw: DataFrame, min_pairs: int = 20) -> DataFrame:
    """Agreement of replicate pairs: n, Pearson, Spearman, variance ratio, fitted multiplier and additive."""
    keys = list(PAIR)
    pairs = cut(replicate_pairs(raw).withColumn("d", F.col("ya") - F.col("yb")).withColumn("pv", F.col("va") + F.col("vb")))
    small = small_groups(pairs, keys)
    if small:
        # Ranks and medians of a pair of replicates by windows over one shuffle.
        both = F.col("ya").isNotNull() & ~F.isnan("ya") & F.col("yb").isNotNull() & ~F.isnan("yb")
        ranks = with_median(pairs, keys, "d", "offset").withColumn("ra", row_ranks(F.col("ya"), keys)).withColumn("rb", row_ranks(F.when(both, F.col("yb")), keys))
        pairs = cut(ranks.select(*keys, "ya", "yb", "ra", "rb", "d", "pv", "offset"))
        ranked, centre = pairs.where("ra IS NOT NULL AND rb IS NOT NULL"), None
    else:
        ranked = with_average_rank(with_average_rank(pairs, keys, "ya", "ra"), keys, "yb", "rb")
        centre = median(pairs, keys, "d", "offset")
    base = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("ya", "yb").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
    base = cut(base.withColumn("pearson", F.when(F.col("n") >= 3, F.col("pearson"))).withColumn("spearman", F.when(F.col("n") >= 3, F.col("spearman"))))
    many = pairs.join(base.where(F.col("n") >= min_pairs).select(*keys), keys, "left_semi")
    r2 = (F.col("d") - F.col("offset")) * (F.col("d") - F.col("offset"))
    centred = (many if centre is None else many.join(centre, keys)).select(*keys, "pv", r2.alias("r2"), (r2 / F.col("pv")).alias("z2"))
    centred = centred if small else cut(centred)
    ratio = median(centred, keys, "z2", "__m", small=small).select(*keys, (F.col("__m") / MEDIAN_CHI2_1).alias("ratio"))
    line = robust_variance_line(centred, keys, "r2", "pv", small)
    return base.join(ratio, keys, "left").join(line, keys, "left")


def leave_one_replicate_out(raw: DataFrame, n_replicates: DataFrame, min_common: int = 20) -> DataFrame:
    """Each replicate against the others' weighted mean on variants usable in all of them.

    ``n_replicates(dataset_id, n_replicates)``: how many replicates the design has. Returns
    dispersion, bias (median z) and the ratio to the other replicates' median dispersion.
    """
    reps = F.collect_list(F.struct(F.col("replicate_id").alias("r"), "y", "v"))
    common = cut(
        raw.where("usable")
        .groupBy("dataset_id", "variant")
        .agg(reps.alias("reps"))
        .join(n_replicates, "dataset_id")
        .where("size(reps) = n_replicates AND n_replicates >= 3")
        .select("dataset_id", "variant", F.inline("reps"))
    )
    by = ["dataset_id", "r"]
    small = small_groups(common, by)
    centred = with_median(common, by, "y", "center", "n") if small else common.join(median(common, by, "y", "center", count="n"), by)
    centred = centred.where(F.col("n") >= min_common).withColumn("yc", F.col("y") - F.col("center"))
    w = 1 / F.col("v")
    # A variant's replicates are few by design.
    of_variant = Window.partitionBy("dataset_id", "variant")
    summed = centred.select(*by, "v", "yc", F.sum(w).over(of_variant).alias("sw"), F.sum(w * F.col("yc")).over(of_variant).alias("swy"))
    z = (F.col("yc") - (F.col("swy") - w * F.col("yc")) / (F.col("sw") - w)) / F.sqrt(F.col("v") + 1 / (F.col("sw") - w))
    scored = cut(summed.select(*by, z.alias("z"), (z * z).alias("z2")))
    if small:
        out = medians(scored, by, {"__m": "z2", "bias": "z"}, "n")
    else:
        out = median(scored, by, "z2", "__m", count="n").join(median(scored, by, "z", "bias"), by)
    out = out.select("dataset_id", F.col("r").alias("replicate_id"), "n", (F.col("__m") / MEDIAN_CHI2_1).alias("dispersion"), "bias")
    # The others' median: replicates of a dataset are few, so its dispersions fit in one array.
    all_of = Window.partitionBy("dataset_id")
    others = F.array_sort(F.filter(F.collect_list(F.struct("replicate_id", "dispersion")).over(all_of), lambda o: o["replicate_id"] != F.col("replicate_id")), lambda a, b: F.when(a["dispersion"] < b["dispersion"], -1).when(a["dispersion"] > b["dispersion"], 1).otherwise(0))
    out = out.withColumn("__o", others)
    k = F.size("__o")
    mid = (F.get("__o", F.floor((k - 1) / 2).cast("int"))["dispersion"] + F.get("__o", F.floor(k / 2).cast("int"))["dispersion"]) / 2
    return out.withColumn("ratio", F.col("dispersion") / mid).drop("__o")


def bin_metrics(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Share of each bin in its replicate's cells (or reads), cells per variant, reads per cell."""
    by = ["dataset_id", "replicate_id"]
    reads = rows.groupBy(*by, "bin_order").agg(F.sum("cnt").alias("reads"))
    variants = rows.where("cnt > 0").select(*by, "variant").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("variants"))
    out = reads.join(variants, by)
    out = out.join(cells, [*by, "bin_order"], "left") if cells is not None else out.withColumn("cells", F.lit(None).cast("double"))
    whole = Window.partitionBy(*by)
    known = F.sum(F.when(F.col("cells").isNull(), 1).otherwise(0)).over(whole) == 0
    share = F.when(known, F.col("cells") / F.sum("cells").over(whole)).otherwise(F.col("reads") / F.sum("reads").over(whole))
    return out.select(
        *by, "bin_order", "reads", "variants", "cells", share.alias("share"),
        F.when(known, F.col("cells") / F.col("variants")).alias("cells_per_variant"),
        F.when(known & (F.col("cells") > 0), F.col("reads") / F.col("cells")).alias("reads_per_cell"),
    )


def dropout(trends: DataFrame, minimum: float = AGREEMENT_INPUT, by: Sequence[str] = ("dataset_id", "replicate_id"), small: bool = False) -> DataFrame:
    """Of variants counted well before selection, those missing and zero after it, and their trends.

    ``trends(…, c0, prev, ct)``: the first, second-to-last (NULL column with two samples) and last
    count. The trend is prev/c0, or the input count itself.
    """
    base = trends.where(F.col("c0") >= minimum)
    trend = F.col("prev") / F.col("c0") if "prev" in trends.columns else F.col("c0")
    base = base.withColumn("trend", trend).withColumn("gone", F.col("ct").isNull())
    sums = base.groupBy(*by).agg(F.count(F.lit(1)).alias("counted"), F.count(F.when(F.col("gone"), 1)).alias("missing"), F.count(F.when(F.col("ct") == 0, 1)).alias("zeros"))
    mid = median(base, [*by, "gone"], "trend", "m", small=small).groupBy(*by).agg(
        F.max(F.when(F.col("gone"), F.col("m"))).alias("missing_trend"), F.max(F.when(~F.col("gone"), F.col("m"))).alias("counted_trend")
    )
    return sums.join(mid, list(by), "left")


def recorded_cells(totals: DataFrame, pairs_of: DataFrame) -> DataFrame:
    """The bottleneck recorded cells predict for a pair of replicates, as a multiple of counting.

    ``totals(dataset_id, replicate_id, reads_in, reads_out, cells_in, cells_out)``.
    """
    one = totals.where("cells_in > 0 AND reads_in > 0 AND reads_out > 0").select(
        "dataset_id", "replicate_id", (1 / F.col("reads_in") + 1 / F.col("reads_out")).alias("counting"),
        (1 / F.col("cells_in") + F.coalesce(F.when(F.col("cells_out") > 0, 1 / F.col("cells_out")), F.lit(0.0))).alias("cells"),
    )
    side = lambda s: one.select("dataset_id", *[F.col(c).alias(f"{c}_{s}") for c in ("counting", "cells")], F.col("replicate_id").alias(f"rep_{s}"))
    return (
        pairs_of.select(*PAIR)
        .join(side("a"), ["dataset_id", "rep_a"])
        .join(side("b"), ["dataset_id", "rep_b"])
        .select(*PAIR, (1 + (F.col("cells_a") + F.col("cells_b")) / (F.col("counting_a") + F.col("counting_b"))).alias("predicted"))
    )


def synonymous_check(raw: DataFrame, by: Sequence[str] = ("dataset_id", "replicate_id")) -> DataFrame:
    """Variance of synonymous log ratios over what counting predicts."""
    s = raw.where("usable AND kind = 'synonymous'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp("y").alias("observed"), F.avg("v").alias("expected"))
    return s.withColumn("ratio", F.when(F.col("n") >= 2, F.col("observed") / F.col("expected")))


def nonsense_change(scores: DataFrame, reference: DataFrame, by: Sequence[str] = ("dataset_id",), min_points: int = 8) -> DataFrame:
    """Where stops stop losing function: the split of positions with the least squared error.

    ``scores(dataset_id, position, score)`` of nonsense variants, ``reference(dataset_id,
    reference_median)``. At least three on each side, R² ≥ 0.5, and the later median nearer the
    reference than half the earlier one's distance. Sums are taken per position first, so the
    windows run over the length of a protein.
    """
    by = list(by)
    at = scores.where("score IS NOT NULL").groupBy(*by, "position").agg(
        F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss")
    )
    order = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    whole, next_ = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("position")
    run = at.select(
        *by, "position", *[F.sum(c).over(order).alias(f"{c}1") for c in ("n", "s", "ss")], *[F.sum(c).over(whole).alias(f"{c}t") for c in ("n", "s", "ss")],
        F.lead("position").over(next_).alias("first_after"),
    )
    cost1 = F.col("ss1") - F.col("s1") * F.col("s1") / F.col("n1")
    n2, s2, ss2 = F.col("nt") - F.col("n1"), F.col("st") - F.col("s1"), F.col("sst") - F.col("ss1")
    split = run.where((F.col("nt") >= min_points) & (F.col("n1") >= 3) & (F.col("nt") - F.col("n1") >= 3))
    split = split.withColumn("cost", cost1 + ss2 - s2 * s2 / n2).withColumn("total", F.col("sst") - F.col("st") * F.col("st") / F.col("nt"))
    best = split.groupBy(*by).agg(F.min(F.struct("cost", "position", "first_after", "total", F.col("n1").alias("n_before"), n2.alias("n_after"))).alias("b")).select(*by, "b.*")
    best = best.where((F.col("total") > 0) & (1 - F.col("cost") / F.col("total") >= 0.5)).withColumnRenamed("position", "last_control")
    sides = scores.where("score IS NOT NULL").join(best.select(*by, "last_control"), by).withColumn("late", F.col("position") > F.col("last_control"))
    mid = median(sides, [*by, "late"], "score", "m").groupBy(*by).agg(
        F.max(F.when(~F.col("late"), F.col("m"))).alias("before_median"), F.max(F.when(F.col("late"), F.col("m"))).alias("after_median")
    )
    near = F.abs(F.col("after_median") - F.col("reference_median")) < 0.5 * F.abs(F.col("before_median") - F.col("reference_median"))
    return best.join(mid, by).join(reference, by).where(near).select(*by, "last_control", "first_after", "n_before", "before_median", "n_after", "after_median")


def _mad(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    centre = median(df, by, value, "__m")
    dev = df.join(centre, list(by)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return median(dev, by, "__d", name).withColumn(name, F.col(name) * MAD_TO_SD)


def separation(scores: DataFrame, side: str = "below", by: Sequence[str] = ("dataset_id",), minimum: int = 5) -> DataFrame:
    """Synonymous against nonsense scores: AUC, standardized gap, share beyond the 5th percentile.

    ``side``: where loss of function scores ('below', 'above' or 'either').
    """
    by = list(by)
    both = cut(scores.where(F.col("kind").isin("synonymous", "nonsense") & F.col("score").isNotNull()).select(*by, "kind", "score"))
    syn, non = both.where("kind = 'synonymous'"), both.where("kind = 'nonsense'")
    ref = quantiles(syn, by, "score", {"reference_median": 0.5, "__q05": 0.05, "__q95": 0.95}, count="n_reference")
    nonq = median(non, by, "score", "nonsense_median", count="n_nonsense")
    spread = _mad(syn, by, "score", "__mr").join(_mad(non, by, "score", "__mn"), by)
    area = auc(both, by, "score", F.col("kind") == "synonymous", "below").select(*by, "below")
    out = ref.join(nonq, by).join(spread, by).join(area, by).where((F.col("n_reference") >= minimum) & (F.col("n_nonsense") >= minimum))
    gap = F.col("reference_median") - F.col("nonsense_median")
    toward = {"below": F.lit(1.0), "above": F.lit(-1.0), "either": F.when(gap < 0, -1.0).otherwise(1.0)}[side]
    value = {"below": F.col("below"), "above": 1 - F.col("below"), "either": F.greatest(F.col("below"), 1 - F.col("below"))}[side]
    out = out.withColumn("auc", value).withColumn("__t", toward)
    beyond = non.join(out.select(*by, "__q05", "__q95", "__t"), by).groupBy(*by).agg(
        F.avg(F.when(F.when(F.col("__t") > 0, F.col("score") > F.col("__q05")).otherwise(F.col("score") < F.col("__q95")), 1.0).otherwise(0.0)).alias("nonsense_beyond")
    )
    return out.join(beyond, by).select(
        *by, "n_reference", "n_nonsense", "auc", (F.lit(side != "either") & (F.col("auc") < 0.25)).alias("reversed"), "reference_median", "nonsense_median",
        (F.col("__t") * gap / F.sqrt((F.col("__mr") * F.col("__mr") + F.col("__mn") * F.col("__mn")) / 2)).alias("standardized"), "nonsense_beyond",
    )


def resolution(scores: DataFrame, by: Sequence[str] = ("dataset_id",), small: bool = False) -> DataFrame:
    """Median SE, and its size against the gap between the control medians."""
    by = list(by)
    se = median(scores.where("se IS NOT NULL"), by, "se", "median_se", count="n", small=small)
    mids = median(scores.where("kind IN ('synonymous', 'nonsense') AND score IS NOT NULL"), [*by, "kind"], "score", "m", small=small).groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "synonymous", F.col("m"))).alias("__s"), F.max(F.when(F.col("kind") == "nonsense", F.col("m"))).alias("__n")
    )
    return se.join(mids, by, "left").select(*by, "n", "median_se", (F.col("median_se") / F.abs(F.col("__s") - F.col("__n"))).alias("resolution"))


def uncertainty_by_input(scores: DataFrame, by: Sequence[str] = ("dataset_id",), bins: int = 5) -> DataFrame:
    """Median input count and SE in fifths of the input count."""
    by = list(by)
    rows = scores.where("se IS NOT NULL AND input IS NOT NULL").select(*by, "input", "se")
    binned = cut(equal_bins(rows, by, "input", F.lit(bins), ties=["se"]).where("n_total >= 25"))
    inner = [*by, "bin"]
    w = F.col("weight")
    return median(binned, inner, "input", "input", count="n", weight=w).join(median(binned, inner, "se", "se", weight=w), inner)


def _chi2_over_df(z: float, df: Column) -> Column:
    """The chi-square quantile over its df at normal quantile z (Wilson and Hilferty)."""
    a = F.when(df > 0, 2 / (9 * df))
    c = 1 - a + z * F.sqrt(a)
    return c * c * c


def time_fit(slopes: DataFrame, by: Sequence[str] = ("dataset_id", "replicate_id")) -> DataFrame:
    """Departure of time courses from a line: χ²/df over its median, and the share beyond 99.9%."""
    df = F.col("points") - 2
    slopes = cut(slopes.select(*by, "state", "points", "n_times", "fit"))
    # Normal quantiles at one half and at 99.9%.
    judged = slopes.where("state = 'used' AND points >= 3 AND fit IS NOT NULL").withColumn("__r", F.col("fit") / _chi2_over_df(0.0, df)).withColumn(
        "__b", (F.col("fit") > _chi2_over_df(3.0902, df)).cast("double")
    )
    counts = slopes.groupBy(*by).agg(
        F.count(F.when(F.col("state") == "used", 1)).alias("fits"),
        F.count(F.when((F.col("state") == "used") & (F.col("points") < F.col("n_times")), 1)).alias("fewer"),
        F.count(F.when(F.col("state") == "few points", 1)).alias("excluded"),
    )
    return counts.join(median(judged, by, "__r", "departure", count="assessed"), list(by), "left").join(
        judged.groupBy(*by).agg(F.avg("__b").alias("beyond")), list(by), "left"
    )


def missing_patterns(counts: DataFrame, samples: Sequence[str], top: int = 8) -> DataFrame:
    """The commonest patterns of missing samples (1 missing, 0 counted), the ``top`` per dataset."""
    mask = F.concat(*[F.max(F.when((F.col("sample_id") == s) & F.col("cnt").isNotNull(), 1).otherwise(0)).cast("string") for s in samples])
    pattern = F.translate(mask, "01", "10")
    rows = counts.groupBy("dataset_id", "variant").agg(pattern.alias("pattern"))
    n = rows.groupBy("dataset_id", "pattern").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("dataset_id").orderBy(F.desc("n"), "pattern")
    return n.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def barcodes_per_variant(seen: DataFrame, by: Sequence[str] = ("dataset_id", "replicate_id")) -> DataFrame:
    """How many barcodes measure a variant in a replicate: quartiles, single ones, totals."""
    per = seen.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("k"))
    q = quantiles(per, by, "k", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, count="variants")
    s = per.groupBy(*by).agg(F.sum("k").alias("barcodes"), F.count(F.when(F.col("k") == 1, 1)).alias("single"))
    return q.join(s, list(by))


def barcode_histogram(seen: DataFrame, by: Sequence[str] = ("dataset_id", "replicate_id")) -> DataFrame:
    """Variants by their number of barcodes, ten or more together."""
    per = seen.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*by, F.least(F.lit(10), F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("variants"))


def unmapped_share(counts: DataFrame) -> DataFrame:
    """Share of reads in barcodes that name no variant, and how many of these were read at all."""
    unnamed = F.col("variant").isNull()
    s = counts.where("cnt > 0").groupBy("dataset_id").agg(
        F.sum("cnt").alias("reads"), F.sum(F.when(unnamed, F.col("cnt"))).alias("unmapped_reads"), F.count_distinct(F.when(unnamed, F.col("barcode"))).alias("unmapped")
    )
    return s.select("dataset_id", "reads", "unmapped", (F.coalesce("unmapped_reads", F.lit(0.0)) / F.col("reads")).alias("unmapped_share"))


def split_half(barcodes: DataFrame, minimum: float = AGREEMENT_INPUT, by: Sequence[str] = ("dataset_id", "replicate_id")) -> DataFrame:
    """Agreement of each variant's two halves of barcodes, alternating in order of identifier.

    A variant may carry any number of barcodes: their places are counted in two levels, by ranges of
    identifiers and then within them, not in one window over the variant.
    """
    keys = [*by, "variant"]
    placed = _alternating(barcodes, keys)
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(F.when(F.col("half") == h, F.col(c))).alias(f"{c}_{h}") for h in (0, 1) for c in ("c0", "ct")]
    )
    ok = sums.where(F.col("k") >= 2).where((F.col("c0_0") >= minimum) & (F.col("c0_1") >= minimum))
    y = lambda h: F.log(F.col(f"ct_{h}") + PSEUDOCOUNT) - F.log(F.col(f"c0_{h}") + PSEUDOCOUNT)
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(y(0), y(1)).alias("r")).where("n >= 10")


#: Ranges of (variant, identifier) at least; more where the session shuffles to more partitions.
RANGES = 128


def _ranged(barcodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``__p``: the range of (keys, barcode) a row lies in. Ranges follow the data, so identifiers that begin alike, or one variant with most of them, are spread too."""
    n = max(RANGES, int(barcodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(barcodes.repartitionByRange(n, *keys, "barcode").withColumn("__p", F.spark_partition_id()))


def _alternating(barcodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``half``: the parity of a barcode's place in its variant, by identifier.

    Two levels: a window inside a range of identifiers, and an offset per range from a small table of counts.
    """
    rows = _ranged(barcodes, keys)
    inside = Window.partitionBy(*keys, "__p").orderBy("barcode")
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        rows.withColumn("__i", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "__p"])
        .withColumn("half", ((F.col("__i") + F.col("__off")) % 2).cast("int"))
        .drop("__p", "__i", "__off")
    )
