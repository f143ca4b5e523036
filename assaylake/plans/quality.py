"""Queries for quality control and findings."""

from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.functions.order import small_groups
from assaylake.operators import barcodes as bc
from assaylake.operators import findings as fd
from assaylake.operators import qc
from assaylake.operators import slope as sl
from assaylake.plans.facts import RESIDUES, SHARED_SQL, Facts
from assaylake.plans.registry import query
from assaylake.plans.scoring import barcode_rows, bin_rows, time_rows, used_barcodes

MED = 0.454936423119572
# The first codon of each residue in the order of the genetic code.
CODON = (
    f"concat(substr('{qc.BASES}', CAST(1 + floor((instr('{qc.GENETIC_CODE}', ref_aa) - 1) / 16) AS INT), 1), "
    f"substr('{qc.BASES}', CAST(1 + floor((instr('{qc.GENETIC_CODE}', ref_aa) - 1) / 4) % 4 AS INT), 1), "
    f"substr('{qc.BASES}', CAST(1 + (instr('{qc.GENETIC_CODE}', ref_aa) - 1) % 4 AS INT), 1))"
)

SHARED_SQL.update(
    {
        "n_variants": "SELECT dataset_id, count(DISTINCT variant) AS n_variants FROM counts GROUP BY ALL",
        "sample_stats": """SELECT dataset_id, sample_id, count(cnt) AS counted, n_variants - count(cnt) AS missing, sum(cnt) AS total, count(*) FILTER (cnt = 0) AS zeros, count(*) FILTER (cnt < 10) AS low,
            sum(cnt) / count(cnt) AS reads_per_variant, count(*) FILTER (cnt < 10) / count(cnt) AS low_fraction, (n_variants - count(cnt)) / n_variants AS missing_fraction,
            quantile_cont(cnt, 0.05) AS q05, quantile_cont(cnt, 0.25) AS q25, median(cnt) AS q50, quantile_cont(cnt, 0.75) AS q75, quantile_cont(cnt, 0.95) AS q95
            FROM counts JOIN n_variants USING (dataset_id) GROUP BY dataset_id, sample_id, n_variants""",
        "cov_seen": "SELECT dataset_id, position, alt, max(CASE WHEN c0 > 0 THEN 1 ELSE 0 END) AS seen FROM pairs WHERE kind IN ('missense', 'nonsense') GROUP BY ALL",
        "raw": "SELECT *, round(ln(ct + 0.5) - ln(c0 + 0.5), 9) AS y, 1 / (c0 + 0.5) + 1 / (ct + 0.5) AS vv FROM pairs WHERE c0 >= 10 AND ct IS NOT NULL",
        "rep_pairs": """SELECT a.dataset_id, a.variant, a.replicate_id AS rep_a, b.replicate_id AS rep_b, a.y AS ya, b.y AS yb, a.y - b.y AS d, a.vv + b.vv AS pv
            FROM raw a JOIN raw b ON a.dataset_id = b.dataset_id AND a.variant = b.variant AND a.replicate_id < b.replicate_id""",
        "rep_ranks": """SELECT *, rank() OVER (PARTITION BY dataset_id, rep_a, rep_b ORDER BY ya) + (count(*) OVER (PARTITION BY dataset_id, rep_a, rep_b, ya) - 1) / 2 AS ra,
            rank() OVER (PARTITION BY dataset_id, rep_a, rep_b ORDER BY yb) + (count(*) OVER (PARTITION BY dataset_id, rep_a, rep_b, yb) - 1) / 2 AS rb FROM rep_pairs""",
        "rep_centred": "SELECT *, pow(d - (median(d) OVER (PARTITION BY dataset_id, rep_a, rep_b)), 2) AS r2, count(*) OVER (PARTITION BY dataset_id, rep_a, rep_b) AS n FROM rep_pairs",
        "rep_binned": """SELECT *, CAST(ceil(rn * greatest(1, least(10, floor(n / 40))) / n) AS BIGINT) - 1 AS bin FROM (
            SELECT *, row_number() OVER (PARTITION BY dataset_id, rep_a, rep_b ORDER BY pv, r2) AS rn FROM rep_centred WHERE n >= 20)""",
        "rep_bins": f"SELECT dataset_id, rep_a, rep_b, bin, count(*) AS m, avg(pv) AS x, median(r2) / {MED} AS y, count(*) / (avg(pv) * avg(pv)) AS w FROM rep_binned GROUP BY ALL",
        "rep_line": """SELECT dataset_id, rep_a, rep_b, CASE WHEN nb = 1 THEN a0 WHEN NOT (coalesce(e2, -1) >= 0) THEN a1 ELSE a2 END AS au, CASE WHEN nb = 1 OR NOT (coalesce(e2, -1) >= 0) THEN 0 ELSE e2 END AS eu, sy / sw AS flat FROM (
            SELECT *, CASE WHEN sw * sxx - sx * sx <> 0 THEN (sw * sxy - sx * sy) / (sw * sxx - sx * sx) END AS a2, CASE WHEN sw * sxx - sx * sx <> 0 THEN (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) END AS e2, sxy / sxx AS a1 FROM (
            SELECT dataset_id, rep_a, rep_b, count(*) AS nb, max(y / x) AS a0, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM rep_bins GROUP BY ALL))""",
        "pair_stats": f"""SELECT p.*, ratio, CASE WHEN au >= 0 THEN au WHEN au IS NOT NULL THEN 0 END AS multiplier, CASE WHEN au >= 0 THEN eu WHEN au IS NOT NULL THEN flat END AS additive FROM (
            SELECT dataset_id, rep_a, rep_b, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(ya, yb) END AS pearson, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS spearman FROM rep_ranks GROUP BY ALL) p
            LEFT JOIN (SELECT dataset_id, rep_a, rep_b, median(r2 / pv) / {MED} AS ratio FROM rep_centred WHERE n >= 20 GROUP BY ALL) USING (dataset_id, rep_a, rep_b) LEFT JOIN rep_line USING (dataset_id, rep_a, rep_b)""",
        "common_reps": "SELECT * FROM raw JOIN (SELECT dataset_id, variant FROM raw GROUP BY ALL HAVING count(*) = 3) USING (dataset_id, variant)",
        "loo_centred": """SELECT *, y - median(y) OVER (PARTITION BY dataset_id, replicate_id) AS yc, count(*) OVER (PARTITION BY dataset_id, replicate_id) AS m FROM common_reps""",
        "loo_z": """SELECT dataset_id, replicate_id, (yc - (swy - yc / vv) / (sw - 1 / vv)) / sqrt(vv + 1 / (sw - 1 / vv)) AS z FROM loo_centred
            JOIN (SELECT dataset_id, variant, sum(1 / vv) AS sw, sum(yc / vv) AS swy FROM loo_centred GROUP BY ALL) USING (dataset_id, variant) WHERE m >= 20""",
        "loo_stats": f"SELECT dataset_id, replicate_id, count(*) AS n, median(z * z) / {MED} AS dispersion, median(z) AS bias FROM loo_z GROUP BY ALL",
        "control_medians": "SELECT dataset_id, median(score) FILTER (kind = 'synonymous') AS mr, median(score) FILTER (kind = 'nonsense') AS mn FROM cond_score GROUP BY ALL",
        "separations": """WITH c AS (SELECT dataset_id, kind, score FROM cond_score WHERE kind IN ('synonymous', 'nonsense')),
            q AS (SELECT dataset_id, count(*) FILTER (kind = 'synonymous') AS nr, count(*) FILTER (kind = 'nonsense') AS nn, median(score) FILTER (kind = 'synonymous') AS mr, median(score) FILTER (kind = 'nonsense') AS mn,
              quantile_cont(score, 0.05) FILTER (kind = 'synonymous') AS q05 FROM c GROUP BY ALL),
            s AS (SELECT dataset_id, 1.482602218505602 * median(abs(score - mr)) FILTER (kind = 'synonymous') AS sr, 1.482602218505602 * median(abs(score - mn)) FILTER (kind = 'nonsense') AS sn,
              avg(CASE WHEN score > q05 THEN 1 ELSE 0 END) FILTER (kind = 'nonsense') AS beyond FROM c JOIN q USING (dataset_id) GROUP BY ALL),
            u AS (SELECT a.dataset_id, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM c a JOIN c b ON a.dataset_id = b.dataset_id AND a.kind = 'synonymous' AND b.kind = 'nonsense' GROUP BY ALL)
            SELECT dataset_id, nr AS n_reference, nn AS n_nonsense, auc, mr AS reference_median, mn AS nonsense_median, (mr - mn) / sqrt((sr * sr + sn * sn) / 2) AS standardized, beyond AS nonsense_beyond
            FROM q JOIN s USING (dataset_id) JOIN u USING (dataset_id) WHERE nr >= 5 AND nn >= 5""",
        "resolutions": "SELECT dataset_id, n, median_se, median_se / abs(mr - mn) AS resolution FROM (SELECT dataset_id, count(se) AS n, median(se) AS median_se FROM cond_score GROUP BY ALL) JOIN control_medians USING (dataset_id)",
    }
)


def ratios(t: Facts):
    # Rounded, so that ties do not depend on the last bit of a logarithm.
    return qc.raw_ratios(t.pairs).withColumn("y", F.round("y", 9))


@query(
    "q1_sample_metrics",
    "dataset_id:s sample_id:s counted:i missing:i total:d zeros:i low:i reads_per_variant:d q05:d q25:d q50:d q75:d q95:d",
    "SELECT * FROM sample_stats",
)
def q1(t: Facts):
    return qc.sample_metrics(t.counts)


@query(
    "q2_count_histogram",
    "dataset_id:s sample_id:s bin:i n:i fraction:d",
    """SELECT dataset_id, sample_id, bin, n, n / sum(n) OVER (PARTITION BY dataset_id, sample_id) AS fraction FROM (
       SELECT dataset_id, sample_id, CAST(floor(log10(cnt + 1) * 4) AS BIGINT) AS bin, count(*) AS n FROM counts GROUP BY ALL)""",
)
def q2(t: Facts):
    return qc.count_histogram(t.counts)


@query(
    "q3_rank_abundance",
    "dataset_id:s sample_id:s rank:i cnt:d",
    """WITH o AS (SELECT dataset_id, sample_id, cnt, row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY cnt DESC) AS rn, count(*) OVER (PARTITION BY dataset_id, sample_id) AS n FROM counts),
       k AS (SELECT DISTINCT dataset_id, sample_id, CAST(least(n, greatest(1, floor(pow(n, k / 63) + 0.5))) AS BIGINT) AS rn FROM o, range(64) t(k))
       SELECT dataset_id, sample_id, rn AS rank, cnt FROM o JOIN k USING (dataset_id, sample_id, rn)""",
)
def q3(t: Facts):
    return qc.rank_abundance(t.counts)


def design_grid(t: Facts):
    return t.targets.select("dataset_id", "position", "ref_aa", F.explode(F.split(F.lit(RESIDUES), "")).alias("alt")).where("alt <> ''")


def seen(t: Facts):
    return t.pairs.where("kind IN ('missense', 'nonsense')").select("dataset_id", "position", "alt", (F.coalesce("c0", F.lit(0.0)) > 0).alias("seen"))


@query(
    "q4_coverage",
    "dataset_id:s class:s designed:i in_table:i observed:i fraction:d",
    """SELECT dataset_id, CASE WHEN alt = '*' THEN 'nonsense' ELSE 'missense' END AS class, count(*) AS designed, count(seen) AS in_table, coalesce(sum(seen), 0) AS observed, coalesce(sum(seen), 0) / count(*) AS fraction
       FROM grid LEFT JOIN cov_seen USING (dataset_id, position, alt) WHERE ref_aa <> alt GROUP BY ALL""",
)
def q4(t: Facts):
    return qc.coverage(design_grid(t), seen(t))


@query(
    "q5_coverage_snv",
    "dataset_id:s designed:i observed:i fraction:d",
    f"""WITH c AS (SELECT dataset_id, position, ref_aa, {CODON} AS codon FROM targets),
       e AS (SELECT DISTINCT dataset_id, position, ref_aa, substr('{qc.GENETIC_CODE}', CAST(1 + 16 * (instr('{qc.BASES}', CASE WHEN i = 1 THEN b ELSE substr(codon, 1, 1) END) - 1)
             + 4 * (instr('{qc.BASES}', CASE WHEN i = 2 THEN b ELSE substr(codon, 2, 1) END) - 1) + instr('{qc.BASES}', CASE WHEN i = 3 THEN b ELSE substr(codon, 3, 1) END) - 1 AS INT), 1) AS alt
             FROM c, (VALUES (1), (2), (3)) p(i), (VALUES ('A'), ('C'), ('G'), ('T')) q(b))
       SELECT dataset_id, count(*) AS designed, coalesce(sum(seen), 0) AS observed, coalesce(sum(seen), 0) / count(*) AS fraction FROM e LEFT JOIN cov_seen USING (dataset_id, position, alt) WHERE alt <> ref_aa GROUP BY ALL""",
)
def q5(t: Facts):
    return qc.coverage_snv(t.targets.selectExpr("dataset_id", "position", f"{CODON} AS codon"), seen(t))


@query(
    "q6_stretches",
    "dataset_id:s start:i stop:i n:i",
    """SELECT dataset_id, min(p) AS start, max(p) AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN g IS NULL OR g > 16 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY p) AS run FROM (
       SELECT dataset_id, p, p - lag(p) OVER (PARTITION BY dataset_id ORDER BY p) AS g FROM (SELECT DISTINCT concat('D', CAST(CAST(floor(l_suppkey / 25) AS BIGINT) AS STRING)) AS dataset_id, l_orderkey AS p FROM lineitem))) GROUP BY dataset_id, run""",
)
def q6(t: Facts):
    positions = t.table("lineitem").selectExpr("concat('D', CAST(CAST(floor(l_suppkey / 25) AS BIGINT) AS STRING)) AS dataset_id", "l_orderkey AS position")
    return qc.stretches(positions).withColumnRenamed("end", "stop")


@query("q7_pair_metrics", "dataset_id:s rep_a:s rep_b:s n:i pearson:d spearman:d ratio:d multiplier:d additive:d", "SELECT * FROM pair_stats")
def q7(t: Facts):
    return qc.pair_metrics(ratios(t))


_RATIO = "SELECT a.*, dispersion / (SELECT median(b.dispersion) FROM loo_stats b WHERE b.dataset_id = a.dataset_id AND b.replicate_id <> a.replicate_id) AS ratio FROM loo_stats a"


def loo(t: Facts):
    return qc.leave_one_replicate_out(ratios(t), t.datasets.withColumn("n_replicates", F.lit(3)))


@query("q8_leave_one_replicate_out", "dataset_id:s replicate_id:s n:i dispersion:d bias:d ratio:d", _RATIO)
def q8(t: Facts):
    return loo(t)


@query(
    "q9_bin_metrics",
    "dataset_id:s replicate_id:s bin_order:i reads:d variants:i share:d cells_per_variant:d reads_per_cell:d",
    """SELECT dataset_id, replicate_id, bin_order, total AS reads, variants, cells / sum(cells) OVER (PARTITION BY dataset_id, replicate_id) AS share, cells / variants AS cells_per_variant, total / cells AS reads_per_cell
       FROM (SELECT *, 5000.0 * (bin_order + 1) AS cells FROM bin_sums) JOIN (SELECT dataset_id, replicate_id, count(DISTINCT variant) AS variants FROM bin_counts WHERE cnt > 0 GROUP BY ALL) USING (dataset_id, replicate_id)""",
)
def q9(t: Facts):
    cells = t.datasets.selectExpr("dataset_id", "explode(array('r1', 'r2', 'r3')) AS replicate_id").selectExpr("*", "explode(sequence(0, 3)) AS bin_order").selectExpr("*", "5000D * (bin_order + 1) AS cells")
    return qc.bin_metrics(bin_rows(t), cells)


@query(
    "q10_dropout",
    "dataset_id:s replicate_id:s counted:i missing:i zeros:i missing_trend:d counted_trend:d",
    """SELECT dataset_id, replicate_id, count(*) AS counted, count(*) FILTER (ct IS NULL) AS missing, count(*) FILTER (ct = 0) AS zeros,
       median(prev / c0) FILTER (ct IS NULL) AS missing_trend, median(prev / c0) FILTER (ct IS NOT NULL) AS counted_trend FROM (
       SELECT dataset_id, replicate_id, variant, sum(CASE WHEN time = 0 THEN cnt END) AS c0, sum(CASE WHEN time = 5 THEN cnt END) AS prev, sum(CASE WHEN time = 6 THEN cnt END) AS ct FROM time_counts GROUP BY ALL)
       WHERE c0 >= 10 GROUP BY ALL""",
)
def q10(t: Facts):
    at = lambda k: F.sum(F.when(F.col("time") == k, F.col("cnt")))
    ends = time_rows(t).groupBy("dataset_id", "replicate_id", "variant").agg(at(0).alias("c0"), at(5).alias("prev"), at(6).alias("ct"))
    return qc.dropout(ends)


@query(
    "q11_recorded_cells",
    "dataset_id:s rep_a:s rep_b:s predicted:d",
    """WITH t AS (SELECT dataset_id, replicate_id, 1 / sum(c0) + 1 / sum(ct) AS counting, 1 / 20000.0 + 1 / 50000.0 AS cells FROM pairs GROUP BY ALL)
       SELECT a.dataset_id, a.replicate_id AS rep_a, b.replicate_id AS rep_b, 1 + (a.cells + b.cells) / (a.counting + b.counting) AS predicted FROM t a JOIN t b ON a.dataset_id = b.dataset_id AND a.replicate_id < b.replicate_id""",
)
def q11(t: Facts):
    totals = t.pairs.groupBy("dataset_id", "replicate_id").agg(F.sum("c0").alias("reads_in"), F.sum("ct").alias("reads_out")).withColumn("cells_in", F.lit(20000.0)).withColumn("cells_out", F.lit(50000.0))
    ids = totals.select("dataset_id", F.col("replicate_id").alias("rep_a")).join(totals.select("dataset_id", F.col("replicate_id").alias("rep_b")), "dataset_id").where("rep_a < rep_b")
    return qc.recorded_cells(totals, ids)


@query(
    "q12_synonymous_check",
    "dataset_id:s replicate_id:s n:i observed:d expected:d ratio:d",
    "SELECT dataset_id, replicate_id, count(*) AS n, var_samp(y) AS observed, avg(vv) AS expected, CASE WHEN count(*) >= 2 THEN var_samp(y) / avg(vv) END AS ratio FROM raw WHERE kind = 'synonymous' GROUP BY ALL",
)
def q12(t: Facts):
    return qc.synonymous_check(ratios(t))


SHARED_SQL["stop_scores"] = "SELECT dataset_id, position, score + CASE WHEN position > 17 THEN 3.0 ELSE 0 END AS score FROM cond_score WHERE kind = 'nonsense'"


@query(
    "q13_nonsense_change",
    "dataset_id:s last_control:i first_after:i n_before:i before_median:d n_after:i after_median:d",
    """WITH o AS (SELECT dataset_id, position, score, row_number() OVER w AS k, sum(score) OVER w AS s1, sum(score * score) OVER w AS q1, count(*) OVER p AS n, sum(score) OVER p AS s, sum(score * score) OVER p AS q,
         lead(position) OVER w AS first_after FROM stop_scores WINDOW w AS (PARTITION BY dataset_id ORDER BY position), p AS (PARTITION BY dataset_id)),
       c AS (SELECT *, q1 - s1 * s1 / k + (q - q1) - (s - s1) * (s - s1) / (n - k) AS cost, q - s * s / n AS total FROM o WHERE n >= 8 AND k >= 3 AND n - k >= 3),
       b AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cost, position) AS place FROM c)
       SELECT b.dataset_id, b.position AS last_control, b.first_after, b.k AS n_before, median(x.score) FILTER (x.position <= b.position) AS before_median, b.n - b.k AS n_after, median(x.score) FILTER (x.position > b.position) AS after_median
       FROM b JOIN stop_scores x ON x.dataset_id = b.dataset_id JOIN control_medians m ON m.dataset_id = b.dataset_id WHERE place = 1 AND total > 0 AND 1 - cost / total >= 0.5
       GROUP BY b.dataset_id, b.position, b.first_after, b.k, b.n, m.mr HAVING abs(median(x.score) FILTER (x.position > b.position) - m.mr - 3) < 0.5 * abs(median(x.score) FILTER (x.position <= b.position) - m.mr - 3)""",
)
def q13(t: Facts):
    stops = t.cond_score.where("kind = 'nonsense'").selectExpr("dataset_id", "position", "score + CASE WHEN position > 17 THEN 3.0D ELSE 0 END AS score")
    ref = qc.median(t.cond_score.where("kind = 'synonymous'"), ["dataset_id"], "score", "m").selectExpr("dataset_id", "m + 3 AS reference_median")
    return qc.nonsense_change(stops, ref)


@query(
    "q14_separation",
    "dataset_id:s n_reference:i n_nonsense:i auc:d reference_median:d nonsense_median:d standardized:d nonsense_beyond:d",
    "SELECT * FROM separations",
)
def q14(t: Facts):
    return qc.separation(t.cond_score)


@query("q15_resolution", "dataset_id:s n:i median_se:d resolution:d", "SELECT * FROM resolutions")
def q15(t: Facts):
    return qc.resolution(t.cond_score)


@query(
    "q15_uncertainty_by_input",
    "dataset_id:s bin:i n:i input:d se:d",
    """SELECT dataset_id, bin, count(*) AS n, median(input) AS input, median(se) AS se FROM (SELECT *, CAST(ceil(rn * 5 / m) AS BIGINT) - 1 AS bin FROM (
       SELECT dataset_id, input, se, row_number() OVER (PARTITION BY dataset_id ORDER BY input, se) AS rn, count(*) OVER (PARTITION BY dataset_id) AS m FROM cond_score) WHERE m >= 25) GROUP BY ALL""",
)
def q15_input(t: Facts):
    return qc.uncertainty_by_input(t.cond_score)


_CHI = "pow(1 - 2 / (9 * (n - 2)) + {z} * sqrt(2 / (9 * (n - 2))), 3)"


def time_slopes(t: Facts):
    rows = cut(time_rows(t))
    return sl.slope_scores(rows, cut(sl.time_normalizers(rows, "full")))


@query(
    "q16_time_fit",
    "dataset_id:s replicate_id:s assessed:i departure:d beyond:d",
    f"""SELECT dataset_id, replicate_id, count(*) AS assessed, median(rss / (n - 2) / {_CHI.format(z=0)}) AS departure, avg(CASE WHEN rss / (n - 2) > {_CHI.format(z=3.0902)} THEN 1 ELSE 0 END) AS beyond
        FROM slopes WHERE state = 'used' AND n >= 3 GROUP BY ALL""",
)
def q16(t: Facts):
    return qc.time_fit(time_slopes(t))


SAMPLES = [f"r{r}_{role}" for r in (1, 2, 3) for role in ("input", "output")]


@query(
    "q17_missing_patterns",
    "dataset_id:s pattern:s n:i place:i",
    "SELECT * FROM (SELECT dataset_id, pattern, n, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, pattern) AS place FROM (SELECT dataset_id, pattern, count(*) AS n FROM (SELECT dataset_id, variant, concat("
    + ", ".join(f"CASE WHEN count(cnt) FILTER (sample_id = '{s}') > 0 THEN '0' ELSE '1' END" for s in SAMPLES)
    + ") AS pattern FROM counts GROUP BY ALL) GROUP BY ALL)) WHERE place <= 8",
)
def q17(t: Facts):
    return qc.missing_patterns(t.counts, SAMPLES)


@query(
    "q18_barcodes_per_variant",
    "dataset_id:s replicate_id:s variants:i barcodes:i single:i q25:d q50:d q75:d",
    """SELECT dataset_id, replicate_id, count(*) AS variants, sum(k) AS barcodes, count(*) FILTER (k = 1) AS single, quantile_cont(k, 0.25) AS q25, median(k) AS q50, quantile_cont(k, 0.75) AS q75 FROM (
       SELECT dataset_id, replicate_id, variant, count(*) AS k FROM barcode_pairs WHERE c0 > 0 AND ct IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
)
def q18(t: Facts):
    return qc.barcodes_per_variant(barcode_rows(t).where("c0 > 0 AND ct IS NOT NULL"))


@query(
    "q18_barcode_histogram",
    "dataset_id:s replicate_id:s k:i variants:i",
    """SELECT dataset_id, replicate_id, least(10, k) AS k, count(*) AS variants FROM (SELECT dataset_id, replicate_id, variant, count(*) AS k FROM barcode_pairs WHERE c0 > 0 AND ct IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
)
def q18_hist(t: Facts):
    return qc.barcode_histogram(barcode_rows(t).where("c0 > 0 AND ct IS NOT NULL"))


@query(
    "q18_unmapped_share",
    "dataset_id:s reads:d unmapped:i unmapped_share:d",
    """SELECT dataset_id, sum(cnt) AS reads, count(DISTINCT CASE WHEN partkey % 97 = 0 THEN barcode END) AS unmapped, coalesce(sum(CASE WHEN partkey % 97 = 0 THEN cnt END), 0) / sum(cnt) AS unmapped_share FROM reads WHERE cnt > 0 GROUP BY ALL""",
)
def q18_unmapped(t: Facts):
    return qc.unmapped_share(t.reads.selectExpr("dataset_id", "barcode", "cnt", "CASE WHEN partkey % 97 <> 0 THEN v END AS variant"))


@query(
    "q19_split_half",
    "dataset_id:s replicate_id:s n:i r:d",
    """SELECT dataset_id, replicate_id, count(*) AS n, corr(ln(t0 + 0.5) - ln(i0 + 0.5), ln(t1 + 0.5) - ln(i1 + 0.5)) AS r FROM (
       SELECT dataset_id, replicate_id, variant, count(*) AS k, sum(c0) FILTER (h = 0) AS i0, sum(ct) FILTER (h = 0) AS t0, sum(c0) FILTER (h = 1) AS i1, sum(ct) FILTER (h = 1) AS t1 FROM (
         SELECT *, (row_number() OVER (PARTITION BY dataset_id, replicate_id, variant ORDER BY barcode) - 1) % 2 AS h FROM barcode_pairs WHERE c0 > 0 AND ct IS NOT NULL) GROUP BY ALL)
       WHERE k >= 2 AND i0 >= 10 AND i1 >= 10 GROUP BY ALL HAVING count(*) >= 10""",
)
def q19(t: Facts):
    return qc.split_half(barcode_rows(t).where("c0 > 0 AND ct IS NOT NULL"))


def count_findings(t: Facts):
    # Reads are summed once; counts and pairs are read from the sums.
    samples = cut(t.samples)
    t.pairs, t.counts = samples.drop("rows_input", "rows_output"), t.counts_of(samples)
    small = small_groups(samples, ["dataset_id"])
    pairs = cut(qc.pair_metrics(ratios(t)).where("n >= 20").withColumn("pair", F.concat_ws("-", "rep_a", "rep_b")))
    cover = qc.coverage(design_grid(t), seen(t)).groupBy("dataset_id").agg((F.sum("observed") / F.sum("designed")).alias("fraction"))
    t.cond_score = cut(t.cond_score)
    scored = qc.separation(t.cond_score)
    parts = [
        fd.sample_findings(cut(qc.sample_metrics(t.counts, small=small)), F.col("sample_id").endswith("input")),
        fd.dropout_finding(qc.dropout(t.pairs, small=small)),
        fd.metric(cover, "coverage", None, F.col("fraction")),
        fd.metric(pairs, "agreement", "pair", F.col("pearson")),
        fd.metric(pairs, "excess-variance", "pair", F.col("ratio")),
        fd.metric(loo(t), "outlier-replicate", "replicate_id", F.col("ratio")),
        fd.metric(scored, "separation", None, F.col("auc")),
        fd.metric(qc.resolution(t.cond_score, small=small), "resolution", None, F.col("resolution")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SHARED_SQL["finding_metrics"] = f"""SELECT dataset_id, 'missing-sample' AS finding, CASE WHEN counted > 0 AND total > 0 THEN 1 ELSE 0 END AS value FROM sample_stats
    UNION ALL SELECT dataset_id, 'depth', reads_per_variant FROM sample_stats WHERE counted > 0 AND total > 0
    UNION ALL SELECT dataset_id, 'low-count', low_fraction FROM sample_stats WHERE counted > 0 AND total > 0 AND sample_id LIKE '%input'
    UNION ALL SELECT dataset_id, 'missingness', missing_fraction - (SELECT quantile_disc(b.missing_fraction, 0.5) FROM sample_stats b WHERE b.dataset_id = a.dataset_id) FROM sample_stats a WHERE counted > 0 AND total > 0
    UNION ALL SELECT dataset_id, 'dropout', CASE WHEN count(*) FILTER (ct IS NULL) / count(*) >= 0.05 AND count(*) FILTER (ct = 0) = 0 AND coalesce(median(c0) FILTER (ct IS NULL) < 0.25 * median(c0) FILTER (ct IS NOT NULL), false) THEN 1 ELSE 0 END
      FROM pairs WHERE c0 >= 10 GROUP BY dataset_id, replicate_id HAVING count(*) >= 20
    UNION ALL SELECT dataset_id, 'coverage', coalesce(sum(seen), 0) / count(*) FROM grid LEFT JOIN cov_seen USING (dataset_id, position, alt) WHERE ref_aa <> alt GROUP BY dataset_id
    UNION ALL SELECT dataset_id, 'agreement', pearson FROM pair_stats WHERE n >= 20 UNION ALL SELECT dataset_id, 'excess-variance', ratio FROM pair_stats WHERE n >= 20
    UNION ALL SELECT dataset_id, 'outlier-replicate', ratio FROM ({_RATIO})
    UNION ALL SELECT dataset_id, 'separation', auc FROM separations UNION ALL SELECT dataset_id, 'resolution', resolution FROM resolutions"""
SHARED_SQL["finding_levels"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{b}', {r}, {f})" for k, (b, r, f) in fd.THRESHOLDS.items()) + ") x(finding, bad, review, fail)"
SHARED_SQL["verdicts_of"] = """SELECT dataset_id, finding, count(*) FILTER (st = 'na') AS n_na, count(*) FILTER (st = 'pass') AS n_pass, count(*) FILTER (st = 'review') AS n_review, count(*) FILTER (st = 'fail') AS n_fail,
    CASE WHEN count(*) FILTER (st = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (st = 'review') > 0 THEN 'review' WHEN count(*) FILTER (st = 'pass') > 0 THEN 'pass' ELSE 'na' END AS status,
    CASE WHEN max(bad) = 'above' THEN max(value) ELSE min(value) END AS worst_value FROM (
    SELECT *, CASE WHEN value IS NULL THEN 'na' WHEN bad = 'above' AND value > fail OR bad = 'below' AND value < fail THEN 'fail' WHEN bad = 'above' AND value > review OR bad = 'below' AND value < review THEN 'review' ELSE 'pass' END AS st
    FROM finding_metrics JOIN finding_levels USING (finding)) GROUP BY ALL"""


@query("q21_findings", "dataset_id:s finding:s status:s n_na:i n_pass:i n_review:i n_fail:i worst_value:d", "SELECT * FROM verdicts_of")
def q21(t: Facts):
    return fd.findings(count_findings(t))


@query(
    "q21_overall",
    "dataset_id:s status:s n_na:i n_pass:i n_review:i n_fail:i blocked:b",
    """SELECT dataset_id, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'review') > 0 THEN 'review' ELSE 'pass' END AS status, count(*) FILTER (status = 'na') AS n_na,
       count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'review') AS n_review, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'fail' AND finding = 'missing-sample') > 0 AS blocked FROM verdicts_of GROUP BY ALL""",
)
def q21_overall(t: Facts):
    return fd.overall(fd.findings(count_findings(t)))


@query("q21_barcode_time_bin_findings", "dataset_id:s finding:s status:s n_na:i n_pass:i n_review:i n_fail:i worst_value:d")
def q21_more(t: Facts):
    seen_bc = cut(barcode_rows(t).where("c0 > 0 AND ct IS NOT NULL"))
    outliers = bc.barcode_outliers(used_barcodes(t), 4.0)
    by = cut(outliers.groupBy("dataset_id", "replicate_id").agg(F.avg(F.col("outlier").cast("double")).alias("share"), F.max("phi").alias("phi")))
    fit = cut(qc.time_fit(time_slopes(t)))
    gates = cut(qc.bin_metrics(cut(bin_rows(t))))
    shares = gates.groupBy("dataset_id", "replicate_id").agg(F.min("share").alias("smallest"))
    flow = t.rep_score.groupBy("dataset_id", "variant").agg(F.max((F.col("state") == "used").cast("int")).alias("ok"), F.max((F.col("state") != "not counted").cast("int")).alias("measured"))
    scored = flow.where("measured = 1").groupBy("dataset_id").agg(F.avg("ok").alias("fraction"))
    parts = [
        fd.metric(scored, "scored-fraction", None, F.col("fraction")),
        fd.metric(qc.unmapped_share(t.reads.selectExpr("dataset_id", "barcode", "cnt", "CASE WHEN partkey % 97 <> 0 THEN v END AS variant")), "barcode-map", None, F.col("unmapped_share")),
        fd.metric(qc.barcodes_per_variant(seen_bc), "barcodes-per-variant", "replicate_id", F.col("single") / F.col("variants")),
        fd.metric(by, "barcode-agreement", "replicate_id", F.col("phi")),
        fd.metric(by, "outlier-barcodes", "replicate_id", F.col("share")),
        fd.metric(qc.split_half(seen_bc), "split-half", "replicate_id", F.col("r")),
        fd.metric(fit, "time-points", "replicate_id", F.col("fewer") / F.col("fits")),
        fd.metric(fit, "time-fit", "replicate_id", F.col("departure")),
        fd.metric(shares, "bin-occupancy", "replicate_id", F.col("smallest")),
        fd.metric(gates, "cells-per-bin", "replicate_id", F.col("cells_per_variant")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return fd.findings(out)
