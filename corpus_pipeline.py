"""The corpus pipeline: rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes the documents its predecessor kept; ``run`` writes and rereads them in between. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm import mixing, neardup, packing, passages, rules


def _counted(left: DataFrame, docs: DataFrame) -> DataFrame:
    """``left`` in the columns of ``docs``, n_chars renewed."""
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines their host shares; n_chars follows. Repeated rows and rows without an id are judged like others."""
    return _counted(rules.cleaned(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of smallest id; repeated rows of it once. Rows without an id stay."""
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has; n_chars follows. A document of which nothing is left stays, empty."""
    return _counted(passages.texts(passages.remove_repeats(docs)).select("doc_id", "text", "other.*"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two equal rows."""
    return mixing.emit(mixing.plan(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("pack", pack)]
#: The near-duplicate forest, tokens and packing have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
