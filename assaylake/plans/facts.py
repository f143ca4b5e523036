"""The given tables read as assays: which columns play dataset, variant, sample and count.

Order lines are reads. A dataset is 25 consecutive suppliers, a variant one of 500 names (24
positions, 21 residues), a replicate and a sample role follow from line number and status, a
sequencing lane from the return flag. The number of datasets grows with the tables; nothing is
left out. The same expressions serve the Spark plans and the SQL they are checked against.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Residue order of the map, and three-letter names in the same order.
RESIDUES = "ARNDCQEGHILKMFPSTWYV*"
THREE_LETTER = "AlaArgAsnAspCysGlnGluGlyHisIleLeuLysMetPheProSerThrTrpTyrValTer"
N_POSITIONS = 24

DATASET = "concat('D', CAST(CAST(floor(l_suppkey / 25) AS BIGINT) AS STRING))"
REPLICATE = "concat('r', CAST(l_linenumber % 3 + 1 AS STRING))"
ROLE = "CASE WHEN l_linestatus = 'O' THEN 'input' ELSE 'output' END"
COUNT = "greatest(l_quantity - 10, 0)"
VARIANT_NO = "CAST(l_partkey % 500 AS INT)"
POSITION = "CAST(1 + floor(v / 21) AS INT)"
REF = f"substr('{RESIDUES}', CAST(1 + ({POSITION} * 7) % 20 AS INT), 1)"
ALT = f"substr('{RESIDUES}', CAST(1 + v % 21 AS INT), 1)"
REF3 = f"substr('{THREE_LETTER}', CAST(1 + 3 * (({POSITION} * 7) % 20) AS INT), 3)"
ALT3 = f"substr('{THREE_LETTER}', CAST(1 + 3 * (v % 21) AS INT), 3)"
VARIANT = (
    f"CASE WHEN v = 0 THEN 'p.=' WHEN {REF} = {ALT} THEN concat('p.', {REF3}, CAST({POSITION} AS STRING), '=') "
    f"ELSE concat('p.', {REF3}, CAST({POSITION} AS STRING), {ALT3}) END"
)
KIND = f"CASE WHEN v = 0 THEN 'wild type' WHEN {REF} = {ALT} THEN 'synonymous' WHEN {ALT} = '*' THEN 'nonsense' ELSE 'missense' END"
CONDITION = "CASE WHEN month(l_shipdate) <= 6 THEN 'base' ELSE 'drug' END"
BIN = "CAST(least(3, floor(l_discount * 40)) AS INT)"

# The same tables for the SQL checks, by name; a query takes those it mentions.
SHARED_SQL: dict[str, str] = {
    "reads": f"""SELECT {DATASET} AS dataset_id, {VARIANT_NO} AS v, {REPLICATE} AS replicate_id, {ROLE} AS role,
        l_returnflag AS lane, {CONDITION} AS condition, CAST(year(l_shipdate) - 1995 AS DOUBLE) AS time, {BIN} AS bin_order,
        CAST(l_partkey AS STRING) AS barcode, l_partkey AS partkey, {COUNT} AS cnt FROM lineitem""",
    "names": f"SELECT v, {VARIANT} AS variant, {KIND} AS kind, CASE WHEN v = 0 THEN NULL ELSE {POSITION} END AS position, "
    f"CASE WHEN v = 0 THEN NULL ELSE {REF} END AS ref, CASE WHEN v = 0 THEN NULL ELSE {ALT} END AS alt FROM (SELECT CAST(range AS INT) AS v FROM range(500))",
    "counts": """SELECT dataset_id, variant, concat(replicate_id, '_', role) AS sample_id, replicate_id, role, sum(cnt) AS cnt
        FROM reads JOIN names USING (v) GROUP BY ALL""",
    "pairs": """SELECT dataset_id, variant, kind, position, alt, replicate_id,
        sum(CASE WHEN role = 'input' THEN cnt END) AS c0, sum(CASE WHEN role = 'output' THEN cnt END) AS ct
        FROM reads JOIN names USING (v) GROUP BY ALL""",
    "library": """SELECT dataset_id, replicate_id, sum(CASE WHEN ct IS NOT NULL THEN c0 END) + 0.5 AS r0,
        sum(CASE WHEN c0 IS NOT NULL THEN ct END) + 0.5 AS rt FROM pairs GROUP BY ALL""",
    "rep_score": """SELECT p.*, CASE WHEN c0 IS NULL OR ct IS NULL THEN 'not counted' WHEN c0 < 1 THEN 'input count' ELSE 'used' END AS state,
        (ln(ct + 0.5) - ln(rt)) - (ln(c0 + 0.5) - ln(r0)) AS score,
        sqrt(1 / (c0 + 0.5) + 1 / (ct + 0.5) + 1 / r0 + 1 / rt) AS se
        FROM pairs p JOIN library USING (dataset_id, replicate_id)""",
    "used": "SELECT * FROM rep_score WHERE state = 'used'",
    "cond_score": """SELECT dataset_id, variant, kind, position, alt, count(*) AS k, sum(score / (se * se)) / sum(1 / (se * se)) AS score,
        sqrt(1 / sum(1 / (se * se))) AS se, avg(c0) AS input FROM used GROUP BY ALL""",
    "targets": f"""SELECT dataset_id, CAST(pos AS INT) AS position, substr('{RESIDUES}', CAST(1 + (pos * 7) % 20 AS INT), 1) AS ref_aa
        FROM (SELECT DISTINCT concat('D', CAST(CAST(floor(s_suppkey / 25) AS BIGINT) AS STRING)) AS dataset_id FROM supplier), range(1, {N_POSITIONS + 1}) t(pos)""",
    "grid": f"""SELECT dataset_id, position, ref_aa, substr('{RESIDUES}', CAST(a AS INT), 1) AS alt FROM targets, range(1, 22) t(a)""",
}


class Facts:
    """Lazy frames over one directory of tables; nothing is computed until a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def reads(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            f"{DATASET} AS dataset_id",
            f"{VARIANT_NO} AS v",
            f"{REPLICATE} AS replicate_id",
            f"{ROLE} AS role",
            "l_returnflag AS lane",
            f"{CONDITION} AS condition",
            "CAST(year(l_shipdate) - 1995 AS DOUBLE) AS time",
            f"{BIN} AS bin_order",
            "CAST(l_partkey AS STRING) AS barcode",
            "l_partkey AS partkey",
            f"{COUNT} AS cnt",
        )

    @staticmethod
    def named(df: DataFrame) -> DataFrame:
        """Variant number to name, class, position and residues (a pure expression, no join)."""
        return df.selectExpr(
            "*",
            f"{VARIANT} AS variant",
            f"{KIND} AS kind",
            f"CASE WHEN v = 0 THEN NULL ELSE {POSITION} END AS position",
            f"CASE WHEN v = 0 THEN NULL ELSE {REF} END AS ref",
            f"CASE WHEN v = 0 THEN NULL ELSE {ALT} END AS alt",
        )

    @cached_property
    def counts(self) -> DataFrame:
        """counts(dataset_id, variant, sample_id, cnt), with the sample's replicate and role."""
        sums = self.reads.groupBy("dataset_id", "v", "replicate_id", "role").agg(F.sum("cnt").alias("cnt"))
        return self.named(sums).selectExpr(
            "dataset_id", "variant", "concat(replicate_id, '_', role) AS sample_id", "replicate_id", "role", "cnt"
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per variant and replicate: counts before (c0) and after (ct) selection."""
        sums = self.reads.groupBy("dataset_id", "v", "replicate_id").agg(
            F.sum(F.when(F.col("role") == "input", F.col("cnt"))).alias("c0"),
            F.sum(F.when(F.col("role") == "output", F.col("cnt"))).alias("ct"),
        )
        return self.named(sums).drop("v", "ref")

    @cached_property
    def samples(self) -> DataFrame:
        """``pairs`` with the rows behind each count, so that ``counts`` can be read from them: a row may be without a count."""
        of = lambda role, value: F.when(F.col("role") == role, value)
        sums = self.reads.groupBy("dataset_id", "v", "replicate_id").agg(
            F.sum(of("input", F.col("cnt"))).alias("c0"), F.sum(of("output", F.col("cnt"))).alias("ct"),
            F.count(of("input", F.lit(1))).alias("rows_input"), F.count(of("output", F.lit(1))).alias("rows_output"),
        )
        return self.named(sums).drop("v", "ref")

    @staticmethod
    def counts_of(samples: DataFrame) -> DataFrame:
        """``counts`` out of ``samples``."""
        one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("cnt"), F.col(f"rows_{role}").alias("rows"))
        two = samples.select("dataset_id", "variant", "replicate_id", F.inline(F.array(one("input", "c0"), one("output", "ct")))).where("rows > 0")
        return two.selectExpr("dataset_id", "variant", "concat(replicate_id, '_', role) AS sample_id", "replicate_id", "role", "cnt")

    @cached_property
    def rep_score(self) -> DataFrame:
        from assaylake.operators.ratio import log_ratio, normalizers, replicate_state

        states = replicate_state(self.pairs)
        return log_ratio(states, normalizers(self.pairs, "complete"), "complete")

    @cached_property
    def used(self) -> DataFrame:
        return self.rep_score.where("state = 'used'")

    @cached_property
    def cond_score(self) -> DataFrame:
        from assaylake.operators.combine import combine_fixed

        keys = ["dataset_id", "variant", "kind", "position", "alt"]
        return combine_fixed(self.used, keys, extra={"input": F.avg("c0")})

    @cached_property
    def datasets(self) -> DataFrame:
        return self.table("supplier").selectExpr("concat('D', CAST(CAST(floor(s_suppkey / 25) AS BIGINT) AS STRING)) AS dataset_id").distinct()

    @cached_property
    def targets(self) -> DataFrame:
        return self.datasets.selectExpr("dataset_id", f"explode(sequence(1, {N_POSITIONS})) AS position").selectExpr(
            "*", f"substr('{RESIDUES}', 1 + (position * 7) % 20, 1) AS ref_aa"
        )
