"""Conservation of alignment columns: sequence weights, frequencies, divergence, smoothing, grades.

``alignments(aln_id, seq_no, residues)``: one row per aligned sequence, a letter per column; what is none of the
twenty residues is a gap. Sequences are counted by blocks of columns in Arrow batches: a task sums what it
reads to one row of twenty numbers per column, and only those rows and, for the weights, blocks of sequences are shuffled. No row per letter is made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.order import with_average_rank

# The background frequency of each residue, and the pseudocount of a column.
BACKGROUND = dict(zip("ARNDCQEGHILKMFPSTWYV", [0.078, 0.051, 0.041, 0.052, 0.024, 0.034, 0.059, 0.083, 0.025, 0.062, 0.092, 0.056, 0.024, 0.044, 0.043, 0.059, 0.055, 0.014, 0.034, 0.072]))
PSEUDOCOUNT = 1e-7

N = len(BACKGROUND)
#: Columns of a block, sequences of an alignment that meet in one task, letters tallied at once.
BLOCK, MOST_SEQUENCES, TALLY_LETTERS = 1024, 4096, 4 << 20
_CODE = np.full(256, -1, np.int8)
_CODE[[ord(a) for a in BACKGROUND]] = np.arange(N)
COUNTS = [f"n_{a}" for a in BACKGROUND]
WEIGHTS = [f"f_{a}" for a in BACKGROUND]


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (-1: gap) of all letters of a string column and where its rows begin and end; a null row has none."""
    texts = column.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return _CODE[data], ends - ends[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Rows of one alignment, of about ``TALLY_LETTERS`` letters at most; a longer sequence comes alone."""
    for batch in batches:
        names = batch["aln_id"].dictionary_encode()
        sizes = np.diff(_letters(batch["residues"])[1])
        of = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for name in np.unique(of).tolist():
            rows = np.flatnonzero(of == name)
            part = np.cumsum(sizes[rows]) // TALLY_LETTERS
            for k in np.unique(part).tolist():
                yield (names.dictionary[name].as_py() if name >= 0 else None), batch.take(pa.array(rows[part == k]))


def _tallied(name, codes: np.ndarray, ends: np.ndarray, weights: np.ndarray | None, names: list[str]) -> pa.RecordBatch:
    """One row per column that has a residue: the number, or the weights, of its sequences by residue."""
    size = np.diff(ends)
    column = np.arange(len(codes)) - np.repeat(ends[:-1], size)
    at = np.flatnonzero(codes >= 0)
    cell = column[at] * N + codes[at]
    if weights is not None:
        weights = np.repeat(weights, size)[at]
    columns = np.unique(column[at])
    place = np.searchsorted(columns, column[at]) * N + codes[at] if len(columns) * 2 < (cell.max(initial=0) // N) else cell
    sums = np.bincount(place, weights, minlength=N).reshape(-1) if len(at) else np.zeros(0)
    sums = np.pad(sums, (0, -len(sums) % N)).reshape(-1, N)
    if place is cell:
        sums = sums[columns] if len(columns) else sums
    kind = pa.int64() if weights is None else pa.float64()
    arrays = [pa.array([name] * len(columns), pa.string()), pa.array(columns + 1, pa.int64()), *[pa.array(np.ascontiguousarray(sums[: len(columns), i]), kind) for i in range(N)]]
    return pa.RecordBatch.from_arrays(arrays, ["aln_id", "col", *names])


def column_counts(alignments: DataFrame) -> DataFrame:
    """aln_id, col, n_A … n_V: sequences with each residue, for every column that has any; column 0 holds in n_A how many sequences have a residue at all."""

    def count(batches):
        for name, rows in _runs(batches):
            codes, ends = _letters(rows["residues"])
            yield _tallied(name, codes, ends, None, COUNTS)
            some = np.add.reduceat(np.append(codes >= 0, False), ends[:-1]) if len(ends) > 1 else np.zeros(0)
            some = np.where(np.diff(ends) > 0, some, 0)
            zero = [pa.array([0], pa.int64())] * (N - 1)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([0], pa.int64()), pa.array([int((some > 0).sum())], pa.int64()), *zero], ["aln_id", "col", *COUNTS])

    schema = "aln_id string, col long, " + ", ".join(f"{c} long" for c in COUNTS)
    told = alignments.select(F.col("aln_id").cast("string"), "residues").mapInArrow(count, schema)
    return told.groupBy("aln_id", "col").agg(*[F.sum(c).alias(c) for c in COUNTS])


def alignment_size(counts: DataFrame) -> DataFrame:
    """Sequences and width of each alignment; one without a residue has no row."""
    return counts.groupBy("aln_id").agg(F.max(F.when(F.col("col") == 0, F.col(COUNTS[0]))).alias("n_seq"), F.max("col").alias("width")).where("n_seq > 0")


def _blocks(alignments: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per sequence and block of columns, dealt over as many parts of its alignment as keep a part small."""
    rows = alignments.join(sizes.select("aln_id", F.ceil(F.col("n_seq") / MOST_SEQUENCES).alias("_parts")), "aln_id")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("residues") - 1), F.lit(BLOCK))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("seq_no"), "_parts")).withColumn("_from", F.explode(starts))
    return rows.select("aln_id", "seq_no", "_part", F.floor(F.col("_from") / BLOCK).alias("_block"), F.substr("residues", F.col("_from") + 1, F.lit(BLOCK)).alias("residues"))


def henikoff(alignments: DataFrame, counts: DataFrame) -> DataFrame:
    """Weight of each sequence: the mean over columns of 1 / (sequences with its residue × residues there); sequences without residues have none.

    A block of an alignment's sequences meets the counts of its columns; the counts, twenty numbers a column, are sent once to every part of the alignment.
    """
    sizes = alignment_size(counts)
    parts = sizes.select("aln_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_seq") / MOST_SEQUENCES) - 1)).alias("_part"))
    columns = counts.where("col > 0").join(parts, "aln_id").withColumn("_block", F.floor((F.col("col") - 1) / BLOCK))

    def weigh(sequences: pa.Table, columns: pa.Table) -> pa.Table:
        share = np.zeros((BLOCK, N))
        if columns.num_rows:
            n = np.stack([columns[c].to_numpy() for c in COUNTS], axis=1).astype(float)
            types = (n > 0).sum(axis=1, keepdims=True)
            share[(columns["col"].to_numpy() - 1) % BLOCK] = np.where(n > 0, 1 / np.maximum(n * types, 1), 0.0)
        codes, ends = _letters(sequences["residues"].combine_chunks()) if sequences.num_rows else (np.zeros(0, np.int8), np.zeros(1, np.int64))
        column = np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))
        sums = np.concatenate([[0.0], np.cumsum(np.where(codes >= 0, share[column, codes], 0.0))])
        has = np.concatenate([[0], np.cumsum(codes >= 0)])
        return pa.table({"aln_id": sequences["aln_id"], "seq_no": sequences["seq_no"], "s": pa.array(sums[ends[1:]] - sums[ends[:-1]]), "n": pa.array(has[ends[1:]] - has[ends[:-1]], pa.int64())})

    keys = ["aln_id", "_block", "_part"]
    kind = alignments.schema["seq_no"].dataType.simpleString()
    summed = _blocks(alignments, sizes).groupBy(*keys).cogroup(columns.groupBy(*keys)).applyInArrow(weigh, f"aln_id string, seq_no {kind}, s double, n long")
    sums = summed.groupBy("aln_id", "seq_no").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    return sums.join(sizes, "aln_id").select("aln_id", "seq_no", (F.col("s") / F.col("width")).alias("weight"))


def column_freq(alignments: DataFrame, counts: DataFrame, weights: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Weighted residue frequencies of each column (``freq``, in the order of BACKGROUND), their sum, its gap share, whether it is scored."""

    def tally(batches):
        for name, rows in _runs(batches):
            codes, ends = _letters(rows["residues"])
            yield _tallied(name, codes, ends, rows["weight"].to_numpy(zero_copy_only=False), WEIGHTS)

    schema = "aln_id string, col long, " + ", ".join(f"{c} double" for c in WEIGHTS)
    weighed = alignments.join(weights, ["aln_id", "seq_no"]).select("aln_id", "residues", "weight").mapInArrow(tally, schema)
    f = weighed.groupBy("aln_id", "col").agg(*[F.sum(c).alias(c) for c in WEIGHTS])
    columns = f.select("aln_id", "col", F.array(*WEIGHTS).alias("freq"), sum(map(F.col, WEIGHTS)).alias("residues"))
    n = counts.where("col > 0").select("aln_id", "col", sum(map(F.col, COUNTS)).alias("n"))
    total = weights.groupBy("aln_id").agg(F.sum("weight").alias("total"))
    out = columns.join(n, ["aln_id", "col"]).join(alignment_size(counts), "aln_id").join(total, "aln_id")
    return out.withColumn("gap_share", 1 - F.col("n") / F.col("n_seq")).withColumn("scored", F.col("gap_share") <= cutoff)


def _log2(c: Column) -> Column:
    return F.log(c) / 0.6931471805599453


def divergence(freq: Column, residues: Column, pseudocount: float = PSEUDOCOUNT) -> Column:
    """Jensen–Shannon divergence (bits) of residue frequencies, in the order of BACKGROUND, from the background."""
    scale = 1 / (residues + 20 * pseudocount)
    total = F.lit(0.0)
    for i, q in enumerate(BACKGROUND.values()):
        p = (F.get(freq, i) + pseudocount) * scale
        m = 0.5 * (p + q)
        total = total + F.when(p > 0, p * _log2(p / m)).otherwise(0.0) + q * _log2(q / m)
    return 0.5 * total


def conservation(columns: DataFrame, method: str = "divergence", gap_penalty: bool = True) -> DataFrame:
    """Raw score of every scored column: divergence, or 1 − entropy over its largest value."""
    if method == "divergence":
        score = divergence(F.col("freq"), F.col("residues"))
    else:
        scale = 1 / (F.col("total") + 21 * PSEUDOCOUNT)
        gaps = F.greatest(F.lit(0.0), F.col("total") - F.col("residues"))
        entropy = F.lit(0.0)
        for x in [*[F.get("freq", i) for i in range(N)], gaps]:
            p = (x + PSEUDOCOUNT) * scale
            entropy = entropy - p * F.log(p)
        score = F.greatest(F.lit(0.0), 1 - entropy / F.log(F.greatest(F.lit(2), F.least(F.lit(21), F.col("n_seq"))).cast("double")))
    if gap_penalty:
        score = score * (1 - (F.col("total") - F.col("residues")) / F.col("total"))
    return columns.where("scored").withColumn("raw", score)


def smooth(scores: DataFrame, window: int = 3, own: float = 0.5) -> DataFrame:
    """own·score + (1 − own)·mean of the scored neighbours within ±window; edges keep their score.

    The window runs over the columns of one alignment, as many as a protein has residues.
    """
    near = Window.partitionBy("aln_id").orderBy("col").rangeBetween(-window, window)
    n = F.count("raw").over(near) - 1
    mean = (F.sum("raw").over(near) - F.col("raw")) / F.when(n > 0, n)
    inner = (F.col("col") > window) & (F.col("col") <= F.col("width") - window)
    return scores.withColumn("score", F.when(inner & (n > 0), (1 - own) * mean + own * F.col("raw")).otherwise(F.col("raw")))


def neff(columns: DataFrame) -> DataFrame:
    """Effective number of residues of each column: exp of its entropy, gaps left out."""
    p = lambda v: v / F.col("residues")
    entropy = F.aggregate("freq", F.lit(0.0), lambda acc, v: acc - F.when(v > 0, p(v) * F.log(p(v))).otherwise(0.0))
    return columns.withColumn("neff", F.exp(entropy))


def profile_divergence(profile: DataFrame, by: Sequence[str]) -> DataFrame:
    """Divergence of given residue probabilities (``residue, p`` in long form), scaled to sum to 1."""
    of = lambda a: F.coalesce(F.sum(F.when(F.col("residue") == a, F.col("p"))), F.lit(0.0))
    rows = profile.where("p > 0 AND residue <> '*'").groupBy(*by).agg(F.array(*map(of, BACKGROUND)).alias("freq"), F.sum("p").alias("residues"))
    return rows.select(*by, divergence(F.col("freq"), F.col("residues"), 0.0).alias("divergence"))


def quantile_grades(scores: DataFrame, by: Sequence[str] = ("aln_id",), value: str = "score") -> DataFrame:
    """Grades 1–9, a ninth of the scored each, ties sharing one; all 5 when all are equal."""
    spread = scores.groupBy(*by).agg((F.min(value) == F.max(value)).alias("__flat"))
    ranked = with_average_rank(scores, by, value, "__r").join(spread, list(by))
    grade = F.least(F.lit(9), F.greatest(F.lit(1), F.ceil((F.col("__r") - 0.5) / F.col("__r_n") * 9)))
    return ranked.withColumn("grade", F.when(F.col("__flat"), 5).otherwise(grade).cast("int")).drop("__r", "__r_n", "__flat")


def consurf_grades(scores: DataFrame, by: Sequence[str] = ("aln_id",), value: str = "score") -> DataFrame:
    """Nine equal steps of the standardized score from the most conserved; all 5 when all are equal."""
    s = scores.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"), F.max(value).alias("__max"))
    c = (F.col("__m") - F.col(value)) / F.col("__sd")
    low = (F.col("__m") - F.col("__max")) / F.col("__sd")
    step = F.floor((c - low) / (-low / 4.5))
    flat = ~F.coalesce((F.col("__sd") > 0) & (F.col("__max") > F.col("__m")), F.lit(False))
    return scores.join(s, list(by)).withColumn("grade", F.when(flat, 5).otherwise(F.greatest(F.lit(1), 9 - step)).cast("int")).drop("__m", "__sd", "__max")
