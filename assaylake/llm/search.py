"""Nearest neighbours by an adaptive dimension scan over probed lists.

Unit vectors are rotated by a fixed random rotation, so that any few columns are a fair sample of a distance. Lists come from k-means
on a bounded sample. Inside a list, distances grow column block by column block; a candidate is abandoned as soon as
its partial distance, scaled up, exceeds the bound of the query by more than chance allows. What survives is scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm.common import longs, table
from assaylake.llm.registry import query

SAMPLE = 20_000
MOST_LISTS = 1_024
PER_BLOCK = 4_096
COLUMNS = 16
CHANCE = 2.1
AIM = 0.98
TRIALS = 300


@dataclass
class Index:
    """rotation, centers, how many rows each list has, how many lists a query probes, rows of a block."""

    rotation: np.ndarray
    centers: np.ndarray
    sizes: np.ndarray
    probes: int
    per_block: int = PER_BLOCK

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.linalg.norm(vectors, axis=1)[:, None] @ self.rotation

    def blocks(self) -> np.ndarray:
        """In how many parts a list's rows are scanned."""
        return np.maximum(1, -(-self.sizes // self.per_block))

    def probed(self, turned: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists for each query, nearest center first: ``probes`` of them, and more until they hold over ``k`` rows."""
        order = np.argsort(-(turned @ self.centers.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        enough = np.maximum(self.probes, (held <= k).sum(axis=1) + 1)
        return [o[:n] for o, n in zip(order, enough)]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def centers_of(turned: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Spherical k-means from different vectors, so that no two centers share equal rows; an empty list keeps its center."""
    draw = np.random.default_rng(seed)
    different = np.unique(turned.round(9), axis=0)
    centers = different[draw.choice(len(different), min(lists, len(different)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(turned @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, turned)
        norms = np.linalg.norm(sums, axis=1)
        centers = np.where((norms > 0)[:, None], sums / np.maximum(norms, 1e-12)[:, None], centers)
    return centers


def probes_for(turned: np.ndarray, centers: np.ndarray, k: int, aim: float = AIM) -> int:
    """The fewest probes that find ``aim`` of the sample's own nearest ``k``, for some of its rows."""
    some = turned[: min(TRIALS, len(turned))]
    near = some @ turned.T
    near[np.arange(len(some)), np.arange(len(some))] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    own = np.argmax(turned @ centers.T, axis=1)
    rank = np.argsort(np.argsort(-(some @ centers.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) if len(needed) else 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part.

    Not: null ids, null or zero vectors, vectors with null or non-finite components, and vectors of another length than the most frequent (the longest of several).
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (common.d if common else 0))


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, seed: int = 11) -> Index | None:
    """An index of usable rows; None when there are none. Only the sample (rows of smallest hash of the id) and one count per list reach the driver."""
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(picked):
        return None
    vectors = np.array([np.asarray(x, np.float64) for x in picked])
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(vectors.shape[1],) * 2))[0]
    turned = vectors / np.linalg.norm(vectors, axis=1)[:, None] @ rotation
    lists = int(min(MOST_LISTS, len(turned), max(1, round(np.sqrt(rows.count())))))
    centers = centers_of(turned, lists)
    index = Index(rotation, centers, np.zeros(len(centers), np.int64), probes_for(turned, centers, k))
    counts = assigned(rows, spark.sparkContext.broadcast(index)).groupBy("list").count().collect()
    for r in counts:
        index.sizes[r["list"]] = r["count"]
    return index


def assigned(rows: DataFrame, shared) -> DataFrame:
    """list, vec_id, embedding: every row in the list of its nearest center."""

    def run(batches):
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                own = np.argmax(index.turned(matrix(batch["embedding"])) @ index.centers.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch["vec_id"], batch["embedding"]], ["list", "vec_id", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"list int, vec_id long, embedding {kind}")


def scan(index: Index, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row and score of the nearest ``k`` rows of a block for each query; its own id is left out."""
    tq, tx = index.turned(q), index.turned(x)
    dims = tq.shape[1]
    edges = [*range(COLUMNS, dims, COLUMNS), dims]
    first = edges[0]
    part = (tq[:, :first] ** 2).sum(1)[:, None] + (tx[:, :first] ** 2).sum(1)[None] - 2 * tq[:, :first] @ tx[:, :first].T
    x_norm = np.sqrt((x * x).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        left = np.flatnonzero(x_id != q_id[i])
        if not len(left):
            continue
        dist = part[i, left]
        near = left[np.argpartition(dist, k - 1)[:k]] if len(left) > k else left
        bound = ((tx[near] - tq[i]) ** 2).sum(1).max()
        for a, b in zip(edges, edges[1:]):
            alive = dist <= bound * (a / dims) * (1 + CHANCE / np.sqrt(a)) ** 2
            if len(near) < k:
                alive[:] = True
            left, dist = left[alive], dist[alive]
            dist = dist + ((tx[left, a:b] - tq[i, a:b]) ** 2).sum(1)
        score = (x[left] * q[i]).sum(axis=1) / (x_norm[left] * np.sqrt((q[i] * q[i]).sum()))
        best = np.lexsort((x_id[left], -score))[:k]
        found.append((np.full(len(best), q_id[i]), x_id[left[best]], score[best]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def search(vectors: DataFrame, every: int = 50, k: int = 5, per_block: int = PER_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the ``k`` nearest found for ids divisible by ``every``.

    Rows that take no part (see ``usable``) are neither queries nor found. Repeated ids: a query does not find rows of
    its own id; each of several rows of one query id would be scanned, so one of them, of the smallest vector, asks. Lists are scanned in blocks of about
    ``per_block`` rows, dealt by a hash, so that a list with most of the rows is many tasks.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    index = fit(rows, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    index.per_block = per_block
    shared = spark.sparkContext.broadcast(index)
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in index.blocks()]), F.col("list") + 1)
    placed = assigned(rows, shared).withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))

    def ask(batches):
        own = shared.value
        parts = own.blocks()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = own.probed(own.turned(matrix(batch["embedding"])), k)
            at = np.array([(i, x, b) for i, some in enumerate(lists) for x in some for b in range(parts[x])], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2].astype(np.int32)), batch["vec_id"].take(pa.array(at[:, 0])), batch["embedding"].take(pa.array(at[:, 0]))], ["list", "block", "query_id", "query"])

    kind = rows.schema["embedding"].dataType.simpleString()
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = queries.mapInArrow(ask, f"list int, block int, query_id long, query {kind}")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            got = scan(shared.value, matrix(left["query"]), left["query_id"].to_numpy(), matrix(right["embedding"]), right["vec_id"].to_numpy(), k)
        else:
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_arrays([longs(got[0]), longs(got[1]), pa.array(got[2])], ["query_id", "vec_id", "score"])

    found = asked.groupBy("list", "block").cogroup(placed.groupBy("list", "block")).applyInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op2_adaptive_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
