"""Mixing sources to target weights.

Words per source are summed, targets follow from weights, a document is taken floor(rate) times and
once more with the probability of the fraction, decided by a hash of its id and a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import numbered, table, word_count
from assaylake.llm.registry import query

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: a row per source, the null source among them.

    Sources in code point order, null last, take the weights in turn and share all words by them. A
    target stops at ``most`` times its source's words; what is left over is shared again by weight, until no target is above.
    A source without words has target 0. Every pass is one aggregate over the table of sources.
    """
    sums = docs.select("source", word_count("text").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    sources = cut(numbered(sums, [F.col("source").asc_nulls_last()], "_i").withColumn("_w", weight).drop("_i"))
    full = F.lit(most) * F.col("source_size")
    level, stopped = 0.0, -1
    while True:
        over = level * F.col("_w") > full
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(over, full)).alias("held"), F.sum(F.when(~over, F.col("_w"))).alias("open"), F.count_if(over).alias("stopped")
        ).first()
        if row.stopped == stopped or not row.open:
            break
        level, stopped = (row.total - (row.held or 0)) / row.open, row.stopped
    return sources.select("source", "source_size", F.least((level * F.col("_w")).cast("double"), full.cast("double")).alias("target"))


def _draw(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1), from 48 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` in ``doc`` (a struct), size, source_size, target and copies of every row.

    Repeated rows, and rows of equal id, draw alike. A null text has size 0 and is taken like others
    of its source; a null id draws as the text "null". An empty table gives no rows.
    """
    rates = targets(docs, weights, most).withColumnRenamed("source", "_source")
    rows = docs.select(F.struct("*").alias("doc"), word_count("text").alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once = (_draw(F.col("doc.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return rows.join(rates, F.col("doc.source").eqNullSafe(F.col("_source"))).select("doc", "size", "source_size", "target", (F.floor(rate) + once).alias("copies"))


def emit(planned: DataFrame) -> DataFrame:
    """Every row of the mix: a document as often as its copies, with the columns it came with."""
    return planned.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
q AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM w),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM q),
l AS (SELECT arg_min(CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE), k) AS level FROM o WHERE CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE) * w <= 3 * source_size),
t AS (SELECT source, source_size, least(level * w, CAST(3 * source_size AS DOUBLE)) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


@query("op10_mix_sources", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(table(spark, sf_dir, "documents"))
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
