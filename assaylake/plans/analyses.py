"""Queries that score experiments end to end: refusals, the default analysis, rescaling, bins.

Here a dataset is five suppliers with two replicates: small experiments, of which many must be refused.
"""

from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.operators import analysis as an
from assaylake.plans.facts import SHARED_SQL, Facts
from assaylake.plans.registry import query

LAB = "concat('S', CAST(CAST(floor(l_suppkey / 5) AS BIGINT) AS STRING))"
# Raw counts after a blank is subtracted, which leaves some below zero.
RAW = "l_quantity - CASE WHEN l_tax > 0.075 AND l_discount > 0.095 THEN 2 ELSE 1 END"

SHARED_SQL.update(
    {
        "lab_lines": f"SELECT {LAB} AS dataset_id, CAST(l_partkey % 500 AS INT) AS v, concat('r', CAST(l_linenumber % 2 + 1 AS STRING)) AS replicate_id, CASE WHEN l_linestatus = 'O' THEN 'input' ELSE 'output' END AS role, l_shipdate, l_discount, {RAW} AS raw, greatest(l_quantity - 10, 0) AS cnt FROM lineitem",
        "lab_pairs": """SELECT dataset_id, variant, kind, replicate_id, sum(CASE WHEN role = 'input' THEN cnt END) AS c0, sum(CASE WHEN role = 'output' THEN cnt END) AS ct
            FROM lab_lines JOIN names USING (v) GROUP BY ALL""",
        "lab_cells": "SELECT dataset_id, v, replicate_id, l_shipdate, l_discount, count(*) AS n, count(*) FILTER (raw < 0) AS negative FROM lab_lines GROUP BY ALL",
        "lab_wt": "SELECT dataset_id, replicate_id, max(CASE WHEN kind = 'wild type' THEN 1 ELSE 0 END) AS wt, max(CASE WHEN kind = 'wild type' AND c0 IS NOT NULL AND ct IS NOT NULL THEN least(c0, ct) END) AS least_reads FROM lab_pairs GROUP BY ALL",
        "lab_refused": """SELECT dataset_id, CAST(NULL AS VARCHAR) AS place, 'negative-count' AS code, CAST(sum(negative) AS BIGINT) AS n FROM lab_cells GROUP BY dataset_id HAVING sum(negative) > 0
            UNION ALL SELECT dataset_id, NULL, 'duplicate-variant', count(*) FILTER (n > 1) FROM lab_cells GROUP BY dataset_id HAVING count(*) FILTER (n > 1) > 0
            UNION ALL SELECT dataset_id, NULL, 'wild-type-absent', 1 FROM lab_wt GROUP BY dataset_id HAVING max(wt) = 0
            UNION ALL SELECT dataset_id, replicate_id, CASE WHEN least_reads IS NULL THEN 'wild-type-uncounted' ELSE 'wild-type-no-reads' END, 1 FROM lab_wt WHERE coalesce(least_reads, 0) <= 0 AND dataset_id IN (SELECT dataset_id FROM lab_wt WHERE wt = 1)""",
        "lab_wt_refused": "SELECT DISTINCT dataset_id FROM lab_refused WHERE code LIKE 'wild-type%'",
    }
)


def lab_lines(t: Facts):
    return t.table("lineitem").selectExpr(
        f"{LAB} AS dataset_id", "CAST(l_partkey % 500 AS INT) AS v", "concat('r', CAST(l_linenumber % 2 + 1 AS STRING)) AS replicate_id",
        "CASE WHEN l_linestatus = 'O' THEN 'input' ELSE 'output' END AS role", "l_shipdate", "l_discount", f"{RAW} AS raw", "greatest(l_quantity - 10, 0) AS cnt",
    )


def lab_pairs(t: Facts):
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("cnt")))
    sums = lab_lines(t).groupBy("dataset_id", "v", "replicate_id").agg(of("input").alias("c0"), of("output").alias("ct"))
    return Facts.named(sums).select("dataset_id", "variant", "kind", "replicate_id", "c0", "ct")


def lab_counts(t: Facts):
    # A variant's number stands for its name, and a sample's parts for its: every read is a key, and short keys travel.
    return lab_lines(t).select("dataset_id", F.struct("replicate_id", "l_shipdate", "l_discount").alias("sample_id"), F.col("v").alias("variant"), F.col("raw").alias("cnt"))


@query("refused_datasets", "dataset_id:s place:s code:s n:i", "SELECT * FROM lab_refused")
def refused(t: Facts):
    return an.refusals(an.count_refusals(lab_counts(t)), an.wild_type_refusals(lab_pairs(t)))


def _expected(normalization: str, refused: str, least: int, centred: bool = False) -> str:
    """SQL of a fixed-effects analysis of the labs that ``refused`` does not hold, refused ones listed."""
    library = {
        "wt": "SELECT dataset_id, replicate_id, max(CASE WHEN kind = 'wild type' THEN c0 END) + 0.5 AS r0, max(CASE WHEN kind = 'wild type' THEN ct END) + 0.5 AS rt FROM lab_pairs GROUP BY ALL",
        "synonymous": "SELECT DISTINCT dataset_id, replicate_id, 1.0 AS r0, 1.0 AS rt FROM lab_pairs",
    }[normalization]
    shared = "0" if normalization == "synonymous" else "1 / r0 + 1 / rt"
    return f"""WITH m AS (SELECT p.*, CASE WHEN c0 IS NULL OR ct IS NULL THEN 'not counted' WHEN c0 < 1 THEN 'input count' ELSE 'used' END AS state,
          (ln(ct + 0.5) - ln(rt)) - (ln(c0 + 0.5) - ln(r0)) AS y0, 1 / (c0 + 0.5) + 1 / (ct + 0.5) + {shared} AS v FROM lab_pairs p JOIN ({library}) USING (dataset_id, replicate_id) WHERE dataset_id NOT IN (SELECT dataset_id FROM {refused})),
        c AS (SELECT dataset_id, replicate_id, median(y0) AS middle FROM m WHERE kind = 'synonymous' AND state = 'used' GROUP BY ALL),
        y AS (SELECT m.*, y0 - {"middle" if centred else "0"} AS y FROM m LEFT JOIN c USING (dataset_id, replicate_id)),
        g AS (SELECT dataset_id, variant, kind, count(*) FILTER (state = 'used') AS k, count(*) AS expected,
          CASE WHEN count(*) FILTER (state <> 'not counted') = 0 THEN 'measured' WHEN count(*) FILTER (state = 'used') = 0 THEN 'input-count' WHEN count(*) FILTER (state = 'used') < {least} THEN 'replicates' END AS reason,
          max(CASE WHEN state = 'used' AND ct = 0 THEN 1 ELSE 0 END) + max(CASE WHEN state = 'used' AND c0 = 0 THEN 2 ELSE 0 END) AS bits,
          sum(CASE WHEN state = 'used' THEN y / v END) / sum(CASE WHEN state = 'used' THEN 1 / v END) AS s, sqrt(1 / sum(CASE WHEN state = 'used' THEN 1 / v END)) AS e FROM y GROUP BY ALL),
        a AS (SELECT dataset_id, variant, kind, k, expected, reason, CASE WHEN reason IS NULL THEN bits + CASE WHEN k < expected THEN 4 ELSE 0 END ELSE 0 END AS flags, CASE WHEN reason IS NULL THEN s END AS score, CASE WHEN reason IS NULL THEN e END AS se FROM g)"""


@query(
    "analysis_fixed",
    "dataset_id:s variant:s k:i expected:i reason:s flags:i score:d se:d",
    f"""{_expected("wt", "lab_wt_refused", 2)} SELECT dataset_id, variant, k, expected, reason, flags, score, se FROM a
        UNION ALL SELECT dataset_id, NULL, NULL, NULL, 'refused', NULL, NULL, NULL FROM lab_wt_refused""",
)
def analysis_fixed(t: Facts):
    return an.analyse(lab_pairs(t), an.Settings(combination="fixed", min_replicates=2))[0]


# The default analysis: its reasons, counts and flags do not depend on the fitted model.
@query(
    "analysis_default_reasons",
    "dataset_id:s variant:s k:i expected:i reason:s flags:i scored:b",
    f"""{_expected("wt", "(SELECT DISTINCT dataset_id FROM lab_refused)", 1)} SELECT dataset_id, variant, k, expected, reason, flags, score IS NOT NULL AS scored FROM a
        UNION ALL SELECT DISTINCT dataset_id, NULL, NULL, NULL, 'refused', NULL, false FROM lab_refused""",
)
def analysis_default_reasons(t: Facts):
    known = an.count_refusals(lab_counts(t))
    return an.analyse(lab_pairs(t), known=known)[0].withColumn("scored", F.col("score").isNotNull())


@query("analysis_default", "dataset_id:s variant:s k:i reason:s score:d se:d df:d")
def analysis_default(t: Facts):
    return an.analyse(lab_pairs(t))[0]


SYN_REFUSED = """(SELECT DISTINCT dataset_id FROM (SELECT dataset_id, replicate_id, count(*) FILTER (kind = 'synonymous' AND c0 >= 1 AND ct IS NOT NULL) AS n FROM lab_pairs GROUP BY ALL) WHERE n = 0)"""
_ANCHORS = "SELECT dataset_id, median(score) FILTER (kind = 'synonymous') AS z, median(score) FILTER (kind = 'nonsense') AS o FROM a GROUP BY ALL"


@query(
    "analysis_rescaled",
    "dataset_id:s variant:s k:i reason:s score:d se:d",
    f"""{_expected("synonymous", SYN_REFUSED, 1, True)}, w AS ({_ANCHORS}) SELECT dataset_id, variant, k, reason, -(score - z) / (o - z) AS score, se / abs(o - z) AS se FROM a JOIN w USING (dataset_id) WHERE o <> z
        UNION ALL SELECT dataset_id, NULL, NULL, 'refused', NULL, NULL FROM {SYN_REFUSED} UNION ALL SELECT dataset_id, NULL, NULL, 'refused', NULL, NULL FROM w WHERE o IS NULL OR z IS NULL OR o = z""",
)
def analysis_rescaled(t: Facts):
    return an.analyse(lab_pairs(t), an.Settings("synonymous", combination="fixed", rescale="synonymous-nonsense"))[0]


@query(
    "analysis_rescale_refusals",
    "dataset_id:s place:s code:s n:i",
    f"""{_expected("synonymous", SYN_REFUSED, 1, True)}, w AS ({_ANCHORS}) SELECT dataset_id, NULL AS place, CASE WHEN o IS NULL OR z IS NULL THEN 'anchor-absent' ELSE 'anchors-equal' END AS code, 1 AS n FROM w WHERE o IS NULL OR z IS NULL OR o = z
        UNION ALL SELECT dataset_id, replicate_id, 'no-synonymous', 1 FROM (SELECT dataset_id, replicate_id, count(*) FILTER (kind = 'synonymous' AND c0 >= 1 AND ct IS NOT NULL) AS n FROM lab_pairs GROUP BY ALL) WHERE n = 0""",
)
def analysis_rescale_refusals(t: Facts):
    return an.analyse(lab_pairs(t), an.Settings("synonymous", combination="fixed", rescale="synonymous-nonsense"))[1]


@query(
    "regression_refusals",
    "dataset_id:s place:s code:s n:i",
    """SELECT dataset_id, replicate_id AS place, CASE WHEN n < 3 THEN 'few-time-points' ELSE 'no-later-time' END AS code, n FROM (
       SELECT dataset_id, replicate_id, count(DISTINCT year(l_shipdate)) AS n, max(year(l_shipdate) - 1996) AS latest FROM lab_lines JOIN names USING (v) WHERE kind = 'wild type' GROUP BY ALL) WHERE n < 3 OR latest <= 0""",
)
def regression_refusals(t: Facts):
    wt = Facts.named(lab_lines(t)).where("kind = 'wild type'")
    return an.regression_refusals(wt.select("dataset_id", "replicate_id", (F.year("l_shipdate") - 1996).alias("time")))


@query(
    "bin_scale_refusals",
    "dataset_id:s place:s code:s n:i",
    """SELECT dataset_id, replicate_id AS place, CASE WHEN one IS NULL OR zero IS NULL THEN 'bin-unscaled' ELSE 'bin-flat' END AS code, 1 AS n FROM (
       SELECT dataset_id, replicate_id, max(CASE WHEN kind = 'wild type' AND c0 >= 1 THEN c0 END) AS one, median(CASE WHEN kind = 'nonsense' AND c0 >= 1 THEN c0 END) AS zero FROM lab_pairs GROUP BY ALL) WHERE one IS NULL OR zero IS NULL OR one = zero""",
)
def bin_scale_refusals(t: Facts):
    rows = lab_pairs(t).withColumn("state", F.when(F.col("c0") >= 1, "used").otherwise("input count")).withColumn("score", F.col("c0"))
    return an.bin_refusals(cut(rows))


@query(
    "barcode_refusals",
    "dataset_id:s place:s code:s n:i",
    """SELECT dataset_id, NULL AS place, 'barcode-repeated' AS code, count(*) AS n FROM (SELECT dataset_id, barcode FROM lab_barcodes WHERE barcode <> 'NA' GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset_id
       UNION ALL SELECT dataset_id, NULL, 'barcode-blank', count(*) FROM lab_barcodes WHERE barcode = 'NA' GROUP BY dataset_id""",
)
def barcode_refusals(t: Facts):
    return an.barcode_refusals(t.table("lineitem").selectExpr(f"{LAB} AS dataset_id", f"{BARCODE} AS barcode"))


BARCODE = "CASE WHEN l_orderkey % 997 = 0 THEN 'NA' ELSE concat(CAST(l_partkey AS STRING), '-', CAST(l_shipdate AS STRING)) END"
SHARED_SQL["lab_barcodes"] = f"SELECT {LAB} AS dataset_id, {BARCODE} AS barcode FROM lineitem"
