"""Queries for research calibration."""

from pyspark.sql import functions as F

from assaylake.functions.order import quantiles
from assaylake.operators import calibration as cal
from assaylake.plans.facts import SHARED_SQL, Facts
from assaylake.plans.registry import query

# A document's length is its score, its quality label its side, its language its control set.
SHARED_SQL.update(
    {
        "controls": "SELECT lang AS set_id, CAST(d.doc_id AS STRING) AS key, CASE WHEN quality = 0 THEN 'P' ELSE 'B' END AS side, CAST(n_chars AS DOUBLE) AS score, d.source, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        "control_totals": "SELECT set_id, count(*) FILTER (side = 'P') AS n_p, count(*) FILTER (side = 'B') AS n_b FROM controls GROUP BY ALL HAVING count(*) FILTER (side = 'P') > 0 AND count(*) FILTER (side = 'B') > 0",
        "csteps": """SELECT set_id, u, p, b, sum(p) OVER w AS tp, sum(b) OVER w AS fp, n_p, n_b, lead(u) OVER w AS below FROM (SELECT set_id, -score AS u, count(*) FILTER (side = 'P') AS p, count(*) FILTER (side = 'B') AS b FROM controls GROUP BY ALL) JOIN control_totals USING (set_id)
            WINDOW w AS (PARTITION BY set_id ORDER BY u DESC)""",
        "croc": """SELECT *, tp / n_p AS sensitivity, (n_b - fp) / n_b AS specificity FROM (SELECT set_id, (u + below) / 2 AS threshold, tp, fp, n_p, n_b, false AS top FROM csteps UNION ALL SELECT set_id, NULL, 0, 0, n_p, n_b, true FROM control_totals)""",
        "climits": """SELECT set_id, CASE WHEN a < n THEN (a + n) / 2 ELSE a END AS ath, CASE WHEN a < n THEN (a + n) / 2 ELSE n END AS nth, a < n AS crossed FROM (
            SELECT set_id, arg_max(t, tp * 1000000 - fp) FILTER (fp <= floor(0.05 * n_b + 1e-9)) AS a, arg_max(t, -fp * 1000000 + tp) FILTER (n_p - tp <= floor(0.05 * n_p + 1e-9)) AS n FROM (
              SELECT *, CASE WHEN threshold IS NOT NULL THEN threshold WHEN top THEN 1e300 ELSE -1e300 END AS t FROM croc) GROUP BY ALL)""",
        "limits_of": "SELECT set_id, CASE WHEN abs(ath) < 1e299 THEN -ath END AS abnormal, CASE WHEN abs(nth) < 1e299 THEN -nth END AS normal, crossed FROM climits",
        "class_table": """SELECT set_id, class, p, b, sum(p) OVER (PARTITION BY set_id) AS n_p, sum(b) OVER (PARTITION BY set_id) AS n_b FROM (
            SELECT set_id, CASE WHEN score <= abnormal THEN 'abnormal-like' WHEN normal IS NOT NULL AND score > normal THEN 'WT-like' ELSE 'intermediate' END AS class, count(*) FILTER (side = 'P') AS p, count(*) FILTER (side = 'B') AS b FROM controls JOIN limits_of USING (set_id) GROUP BY ALL)""",
    }
)


def controls(t: Facts):
    docs = t.table("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.table("labels"), "doc_id").selectExpr(
        "lang AS set_id", "CAST(doc_id AS STRING) AS key", "CASE WHEN quality = 0 THEN 'P' ELSE 'B' END AS side", "CAST(n_chars AS DOUBLE) AS score", "source", "toxic"
    )


def steps(t: Facts):
    return cal.control_steps(controls(t))


def limits(t: Facts):
    return cal.thresholds(cal.roc(steps(t)))


# Classification records from the order book: priority as classification, status as review status.
RECORD = [
    "concat('D', CAST(o_custkey % 3 AS STRING)) AS set_id",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'NM_2' ELSE 'NM_1' END AS transcript",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('v', CAST(o_custkey AS STRING)) END AS key",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'nonsense' ELSE 'missense' END AS kind",
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Pathogenic' WHEN '2' THEN 'Likely pathogenic' WHEN '3' THEN 'Benign' WHEN '4' THEN 'Uncertain significance' ELSE 'Conflicting classifications' END AS classification",
    "CASE o_orderstatus WHEN 'F' THEN 'criteria provided, single submitter' WHEN 'O' THEN 'reviewed by expert panel' ELSE 'no assertion criteria provided' END AS review_status",
]
SHARED_SQL["records"] = f"SELECT {', '.join(RECORD)}, strftime(o_orderdate, '%Y-%m-%d') AS evaluated, o_orderkey FROM orders"
SHARED_SQL["classified"] = """SELECT r.*, CASE WHEN classification IN ('Pathogenic', 'Likely pathogenic') THEN 'P' WHEN classification = 'Benign' THEN 'B' END AS side, CASE review_status WHEN 'reviewed by expert panel' THEN 3 WHEN 'criteria provided, single submitter' THEN 1 ELSE 0 END AS stars,
    CASE WHEN transcript <> 'NM_1' THEN 'on another transcript' WHEN key IS NULL THEN 'not a single substitution' WHEN classification LIKE 'Uncertain%' THEN 'uncertain' WHEN classification LIKE 'Conf%' THEN 'conflicting' WHEN review_status LIKE 'no%' THEN 'too few review stars'
    WHEN kind <> 'missense' THEN 'class not chosen' WHEN evaluated >= '2000-01-01' THEN 'evaluated too late' END AS reason FROM records r"""
SHARED_SQL["merged_labels"] = "SELECT set_id, key, min(side) AS side, min(side) <> max(side) AS conflict, max(stars) AS stars, max(evaluated) AS evaluated, count(*) AS records FROM classified WHERE reason IS NULL GROUP BY ALL"


def records(t: Facts):
    return t.table("orders").selectExpr(*RECORD, "date_format(o_orderdate, 'yyyy-MM-dd') AS evaluated")


def classified(t: Facts):
    return cal.classified_controls(records(t), before=2000)


@query("k1_classified_controls", "set_id:s reason:s n:i", "SELECT set_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM classified GROUP BY ALL")
def k1(t: Facts):
    return classified(t).groupBy("set_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k2_label_controls",
    "word:s side:s date_text:s date:s",
    """SELECT DISTINCT lower(o_orderpriority) AS word, NULL AS side, strftime(o_orderdate, '%-d %b %Y') AS date_text, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0
       UNION SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'Benign; association' WHEN 'O' THEN 'Functionally_abnormal' ELSE 'LoF' END, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'P' END, strftime(o_orderdate, '%Y/%m/%d'), strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderkey % 2 = 1""",
)
def k2(t: Facts):
    rows = t.table("orders").selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) WHEN o_orderstatus = 'F' THEN 'Benign; association' WHEN o_orderstatus = 'O' THEN 'Functionally_abnormal' ELSE 'LoF' END AS word",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'yyyy/MM/dd') END AS date_text",
    ).distinct()
    return rows.withColumn("side", cal.side_from_words(F.col("word"))).withColumn("date", cal.read_date(F.col("date_text")))


@query("k3_merge_labels", "set_id:s key:s side:s conflict:b stars:i evaluated:s records:i", "SELECT * FROM merged_labels")
def k3(t: Facts):
    return cal.merge_labels(classified(t).where("reason IS NULL"))


@query("k4_composition", "set_id:s side:s kind:s n:i", "SELECT set_id, side, kind, count(*) AS n FROM classified WHERE side IS NOT NULL GROUP BY ALL")
def k4(t: Facts):
    return cal.composition(classified(t).where("side IS NOT NULL"))


@query(
    "k4_circularity",
    "set_id:s side:s n:i circular:i",
    "SELECT set_id, side, count(*) AS n, count(*) FILTER ((set_id, key) IN (SELECT (set_id, key) FROM classified WHERE transcript = 'NM_2' AND key IS NOT NULL)) AS circular FROM merged_labels GROUP BY ALL",
)
def k4_circular(t: Facts):
    rows = classified(t)
    return cal.circularity(cal.merge_labels(rows.where("reason IS NULL")), rows.where("transcript = 'NM_2' AND key IS NOT NULL"))


@query("k5_roc", "set_id:s threshold:d tp:i fp:i sensitivity:d specificity:d", "SELECT * FROM croc")
def k5(t: Facts):
    return cal.roc(steps(t))


@query(
    "k5_areas",
    "set_id:s n_p:i n_b:i auc:d pr_auc:d",
    """SELECT set_id, max(n_p) AS n_p, max(n_b) AS n_b, sum(b * (tp - p + p / 2)) / max(n_p) / max(n_b) AS auc, sum(CASE WHEN p > 0 THEN CASE WHEN (fp - b - b / p * (tp - p)) / n_p = 0 THEN p / n_p / (1 + b / p) ELSE
       (p / n_p - ((fp - b - b / p * (tp - p)) / n_p) / (1 + b / p) * (ln((1 + b / p) * tp / n_p + (fp - b - b / p * (tp - p)) / n_p) - ln((1 + b / p) * (tp - p) / n_p + (fp - b - b / p * (tp - p)) / n_p))) / (1 + b / p) END END) AS pr_auc FROM csteps GROUP BY ALL""",
)
def k5_areas(t: Facts):
    return cal.areas(steps(t))


@query("k6_pr_points", "set_id:s threshold:d recall:d precision:d", "SELECT set_id, u AS threshold, tp / n_p AS recall, tp / (tp + fp) AS precision FROM csteps")
def k6(t: Facts):
    return cal.pr_points(steps(t))


GRID = [round(k * 0.05, 2) for k in range(1, 20)]


@query(
    "k7_sensitivity_at",
    "set_id:s specificity:d sensitivity:d",
    f"""WITH g AS (SELECT unnest({GRID}) AS g), o AS (SELECT set_id, g, max(sensitivity) FILTER (specificity = g) AS own, min(specificity) FILTER (specificity > g) AS hs, max(specificity) FILTER (specificity < g) AS ls FROM croc, g GROUP BY ALL)
        SELECT set_id, g AS specificity, coalesce(own, h + (g - hs) / (ls - hs) * (l - h)) AS sensitivity FROM (SELECT o.*, (SELECT max(sensitivity) FROM croc c WHERE c.set_id = o.set_id AND c.specificity = hs) AS h, (SELECT min(sensitivity) FROM croc c WHERE c.set_id = o.set_id AND c.specificity = ls) AS l FROM o)""",
)
def k7(t: Facts):
    return cal.sensitivity_at(cal.roc(steps(t)), GRID)


@query(
    "k7_precision_at",
    "set_id:s recall:d precision:d",
    f"""WITH g AS (SELECT unnest({GRID}) AS g), o AS (SELECT set_id, g, min(tp) AS tp FROM csteps, g WHERE p > 0 AND tp >= g * n_p - 1e-9 GROUP BY ALL)
        SELECT set_id, g AS recall, (tp - p + x) / (tp - p + x + fp - b + b / p * x) AS precision FROM (SELECT s.*, g, greatest(0, least(p, g * n_p - (tp - p))) AS x FROM o JOIN csteps s USING (set_id, tp) WHERE p > 0)""",
)
def k7_precision(t: Facts):
    return cal.precision_at(steps(t), GRID)


@query("k8_thresholds", "set_id:s abnormal:d normal:d crossed:b", "SELECT * FROM limits_of")
def k8(t: Facts):
    return limits(t)


@query(
    "k8_youden",
    "set_id:s abnormal:d",
    "SELECT set_id, CASE WHEN abs(t) < 1e299 THEN -t END AS abnormal FROM (SELECT set_id, CASE WHEN threshold IS NOT NULL THEN threshold WHEN top THEN 1e300 ELSE -1e300 END AS t, row_number() OVER (PARTITION BY set_id ORDER BY sensitivity + specificity DESC, fp) AS i FROM croc) WHERE i = 1",
)
def k8_youden(t: Facts):
    return cal.thresholds(cal.roc(steps(t)), "youden")


@query("k9_functional_class", "set_id:s class:s p:i b:i n_p:i n_b:i", "SELECT * FROM class_table")
def k9(t: Facts):
    return cal.class_counts(controls(t), limits(t))


@query(
    "k10_wilson",
    "set_id:s class:s p_rate:d p_low:d p_high:d",
    """SELECT set_id, class, p / n_p AS p_rate, greatest(0, (p / n_p + 1.920729410347062 / n_p - 1.959963984540054 * sqrt((p / n_p * (1 - p / n_p) + 0.960364705173531 / n_p) / n_p)) / (1 + 3.841458820694124 / n_p)) AS p_low,
       least(1, (p / n_p + 1.920729410347062 / n_p + 1.959963984540054 * sqrt((p / n_p * (1 - p / n_p) + 0.960364705173531 / n_p) / n_p)) / (1 + 3.841458820694124 / n_p)) AS p_high FROM class_table""",
)
def k10(t: Facts):
    return cal.class_rates(cal.class_counts(controls(t), limits(t)))


@query("k11_bootstrap", "set_id:s metric:s at:d low:d median:d high:d samples:i")
def k11(t: Facts):
    return cal.bootstrap(controls(t))


SHARED_SQL["given_sets"] = "SELECT set_id, quantile_cont(score, 0.3) AS abnormal, CASE WHEN set_id = 'es' THEN quantile_cont(score, 0.1) ELSE quantile_cont(score, 0.6) END AS normal FROM controls GROUP BY set_id"


def given_sets(t: Facts):
    q = quantiles(controls(t), ["set_id"], "score", {"abnormal": 0.3, "n1": 0.1, "n6": 0.6})
    return q.select("set_id", "abnormal", F.when(F.col("set_id") == "es", F.col("n1")).otherwise(F.col("n6")).alias("normal"))


@query(
    "k8_given_thresholds",
    "set_id:s abnormal:d normal:d problem:s",
    "SELECT set_id, abnormal, normal, CASE WHEN abnormal > normal THEN 'abnormal beyond normal' END AS problem FROM given_sets",
)
def k8_given(t: Facts):
    return cal.given_thresholds(given_sets(t))


@query(
    "k9_given_classes",
    "set_id:s class:s p:i b:i n_p:i n_b:i",
    """SELECT set_id, class, count(*) FILTER (side = 'P') AS p, count(*) FILTER (side = 'B') AS b, any_value(n_p) AS n_p, any_value(n_b) AS n_b FROM (
       SELECT *, CASE WHEN score <= abnormal THEN 'abnormal-like' WHEN score > normal THEN 'WT-like' ELSE 'intermediate' END AS class, count(*) FILTER (side = 'P') OVER (PARTITION BY set_id) AS n_p, count(*) FILTER (side = 'B') OVER (PARTITION BY set_id) AS n_b
       FROM controls JOIN given_sets USING (set_id) WHERE abnormal <= normal) GROUP BY ALL""",
)
def k9_given(t: Facts):
    return cal.class_counts(controls(t), cal.given_thresholds(given_sets(t)).where("problem IS NULL").drop("problem"))


@query(
    "k12_odds_path",
    "set_id:s class:s odds_path:d strength:s contrary:b",
    """SELECT set_id, class, o AS odds_path, coalesce(CASE WHEN class = 'abnormal-like' THEN CASE WHEN o > 350 THEN 'PS3_very_strong' WHEN o > 18.7 THEN 'PS3' WHEN o > 4.3 THEN 'PS3_moderate' WHEN o > 2.1 THEN 'PS3_supporting' END
       ELSE CASE WHEN o < 0.053 THEN 'BS3' WHEN o < 0.23 THEN 'BS3_moderate' WHEN o < 0.48 THEN 'BS3_supporting' END END, 'Indeterminate') AS strength, CASE WHEN class = 'abnormal-like' THEN o < 1 ELSE o > 1 END AS contrary FROM (
       SELECT *, CASE WHEN post < 1 THEN post * (1 - prior) / ((1 - post) * prior) END AS o FROM (SELECT *, n_p / (n_p + n_b) AS prior, CASE WHEN class = 'abnormal-like' THEN p / (p + b + 1) ELSE (p + 1) / (p + b + 1) END AS post FROM class_table WHERE class <> 'intermediate' AND p + b > 0))""",
)
def k12(t: Facts):
    return cal.odds_path(cal.class_counts(controls(t), limits(t)))


@query(
    "k13_range_counts",
    "set_id:s label:s n:i p:i b:i",
    """SELECT s.set_id, x.label, count(c.score) AS n, count(*) FILTER (side = 'P') AS p, count(*) FILTER (side = 'B') AS b FROM (SELECT DISTINCT lang AS set_id FROM documents) s CROSS JOIN (VALUES ('low', NULL, 500, true), ('mid', 500, 2000, false), ('high', 2000, NULL, true)) x(label, lo, hi, closed)
       LEFT JOIN controls c ON c.set_id = s.set_id AND (lo IS NULL OR score > lo) AND (hi IS NULL OR score < hi OR (closed AND score = hi)) GROUP BY ALL""",
)
def k13(t: Facts):
    ranges = t.table("documents").selectExpr("lang AS set_id").distinct().selectExpr(
        "set_id", "stack(3, 'low', CAST(NULL AS DOUBLE), 500D, true, 'mid', 500D, 2000D, false, 'high', 2000D, CAST(NULL AS DOUBLE), true) AS (label, lo, hi, hi_closed)"
    ).withColumn("lo_closed", F.lit(False))
    return cal.range_counts(controls(t), ranges)


@query("k14_score_likelihood", "set_id:s score:d log_lr:d log_lr_low:d log_lr_high:d level:s")
def k14(t: Facts):
    return cal.score_likelihood(controls(t))
