"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first four and five bytes, lower-cased, as 64-bit hashes. Terms found among toxic rows more often
than by chance are kept; a score is a bias, a weight per term, and for every pair of terms the product of their factors, so that
two terms together can count for more, or less, than their sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import binary_of, slices, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.terms import LETTERS, LOWER, U, hashes, mixed, runs

FIT_ROWS = 20_000
MOST_CANDIDATES = 65_536
LEAST_ROWS = 4
LEAST_Z = 4.0
MOST_TERMS = 4_096
FACTORS = 8
EPOCHS = 30
STEP_BYTES = 1 << 19


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and hash of the terms of texts, repeats included."""
    data = LOWER[data]
    start, end, row = runs(LETTERS[data], at)
    whole = hashes(data, start, end)
    out, rows = [whole], [row]
    for n in (4, 5):
        long = end - start > n
        out.append(mixed(hashes(data, start[long], start[long] + n) + U(n)))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(out)


def _distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


@dataclass
class Machine:
    """terms (sorted), bias, weight per term, factors per term."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def matched(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """row and index of the distinct known terms of rows."""
        if not len(self.terms) or not len(term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.zeros(1 << 16, bool)
        near[(self.terms & U(0xFFFF)).astype(np.int64)] = True
        some = near[(term & U(0xFFFF)).astype(np.int64)]
        row, term = row[some], term[some]
        i = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[i] == term
        r, k = _distinct(row[known], i[known].astype(U))
        return r, k.astype(np.int64)

    def logits(self, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """The machine's value for ``n`` rows whose terms are sorted by row."""
        linear = np.bincount(row, self.weight[index], n) + self.bias
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f]
            pairs += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return linear + pairs


def train(terms: np.ndarray, row: np.ndarray, index: np.ndarray, label: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fits a machine by Adam on the logistic loss, with a penalty on weights and factors; weights start at half the log odds of
    their terms. ``row`` is sorted."""
    draw = np.random.default_rng(seed)
    n = len(label)
    share = (label.sum() + 1) / (n + 20)
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), draw.normal(0, 0.02, (len(terms), factors)))
    if not n or not len(terms):
        return machine
    hit, seen = np.bincount(index, label[row], len(terms)), np.bincount(index, minlength=len(terms))
    machine.weight += 0.5 * (np.log((hit + 0.5) / (seen - hit + 0.5)) - machine.bias)
    first = np.searchsorted(row, np.arange(n + 1))
    state = [np.zeros_like(x) for x in (machine.weight, machine.factors) for _ in range(2)] + [0.0, 0.0]
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(draw.permutation(n), max(1, n // 256)):
            sizes = first[batch + 1] - first[batch]
            r = np.repeat(np.arange(len(batch)), sizes)
            k = index[np.concatenate([np.arange(first[b], first[b + 1]) for b in batch])] if sizes.sum() else np.zeros(0, np.int64)
            z = np.clip(machine.logits(r, k, len(batch)), -30, 30)
            error = (1 / (1 + np.exp(-z)) - label[batch]) / len(batch)
            sums = np.stack([np.bincount(r, machine.factors[k, f], len(batch)) for f in range(factors)], 1)
            g_weight = np.bincount(k, error[r], len(terms)) + 1e-5 * machine.weight
            g_factors = np.stack([np.bincount(k, error[r] * (sums[r, f] - machine.factors[k, f]), len(terms)) for f in range(factors)], 1) + 1e-4 * machine.factors
            t += 1
            for i, (value, g, rate) in enumerate(((machine.weight, g_weight, 0.05), (machine.factors, g_factors, 0.01))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            machine.bias -= 0.05 * float(error.sum())
    return machine


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents outside the fold: those whose ids have the smallest hashes.

    The chosen ids are at most ``rows``, so they are broadcast; the sample's texts are written once.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    some = usable.select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return cut(small_batches(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` labelled documents.

    Spark counts terms, first among the sample's toxic rows, then the MOST_CANDIDATES most frequent of those among all
    sampled rows; the driver gets the at most MOST_TERMS chosen ones and which of them the sampled rows have. Without labelled rows the machine is its prior.
    """
    sample = labelled(docs, labels, label, folds, fold, rows)

    def count(only: np.ndarray | None):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", STEP_BYTES):
                    row, term = terms_of(*binary_of(part["text"]))
                    if only is not None:
                        row, index = Machine(only, 0.0, only, only).matched(row, term)
                        term = only[index]
                    else:
                        row, term = _distinct(row, term)
                    found, inverse = np.unique(term, return_inverse=True)
                    n, hit = np.bincount(inverse, minlength=len(found)), np.bincount(inverse, part["label"].to_numpy()[row], len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64))], ["term", "n", "hit"])

        return run

    def counted(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
        return rows.mapInArrow(count(only), "term long, n long, hit long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))

    def hashed(rows: DataFrame) -> np.ndarray:
        return np.sort(np.array([r.term for r in rows.select("term").collect()], np.int64).view(U))

    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("hit")).first()
    share = (totals.hit or 0) / max(1, totals.n)
    often = hashed(counted(sample.where("label = 1")).where(F.col("hit") >= LEAST_ROWS).orderBy(F.desc("hit"), "term").limit(MOST_CANDIDATES))
    z = (F.col("hit") - F.col("n") * share) / F.sqrt(F.col("n") * max(1e-9, share * (1 - share)))
    terms = hashed(counted(sample, often).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_TERMS))
    known = Machine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 1)))

    def match(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                row, index = known.matched(*terms_of(*binary_of(part["text"])))
                first = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["label"].cast(pa.int32()), pa.ListArray.from_arrays(first, index.astype(np.int32))], ["doc_id", "label", "index"])

    found = sample.mapInArrow(match, "doc_id long, label int, index array<int>").orderBy("doc_id").collect()
    label_of = np.array([r.label for r in found], float)
    row = np.repeat(np.arange(len(found)), [len(r["index"]) for r in found])
    index = np.array([i for r in found for i in r["index"]], np.int64)
    return train(terms, row, index, label_of)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of whole texts; a null or empty text has the bias alone. Repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                row, index = m.matched(*terms_of(*binary_of(part["text"])))
                z = np.clip(m.logits(row, index, part.num_rows), -30, 30)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


@query("op1_toxicity_machine")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
