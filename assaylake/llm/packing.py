"""Best-fit packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. The program over
configurations (multisets of lengths that fit a sequence) is solved there by multiplicative weights: lengths start with their share of the
volume, those still short of cover come to weigh more, and a knapsack table prices the configurations of most weight. It ends when every length is covered.
Rounded configurations become a table of places; every piece finds its place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import binary_of, give_back, longs, slices, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
#: How fast weights fall with the part covered, the part of its scarcest length that a step covers, configurations taken from one knapsack table, and the parts of a
#: sequence that the configurations kept may leave empty, tried in turn.
SPEED = 0.1
STEP = 0.25
COLUMNS = 64
WASTES = (0.0005, 0.002, 0.01)
STEP_BYTES = 1 << 20


def cut_pieces(docs: DataFrame, path: str, spaces: str = "kept", end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (unsigned) and ids (little-endian unsigned 32-bit): whole texts as pieces of at most ``capacity`` tokens.

    Without ``ids`` they stay in the task that made them, and only their digest travels.

    A document is its ids and ``end_id``; a null text is the end id alone. A longer document's first piece
    takes the remainder, all others are full. Repeated rows are pieces of their own.
    """

    def run(batches):
        coder = encoder(path, spaces, 4)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                data, at = binary_of(part["text"])
                raw = data.tobytes()
                texts = [x + end for x in coder.encode([raw[a:b] for a, b in zip(at, at[1:])])]
                which, piece, start, length, payload = [], [], [], [], []
                for i, x in enumerate(texts):
                    n = len(x) // 4
                    first = n if n <= capacity else (n - 1) % capacity + 1
                    begin, k = 0, 0
                    while begin < n:
                        size = first if k == 0 else capacity
                        which.append(i), piece.append(k), start.append(begin), length.append(size), payload.append(x[4 * begin : 4 * (begin + size)])
                        begin, k = begin + size, k + 1
                doc = part["doc_id"].take(pa.array(which, pa.int64()))
                columns = [doc.cast(pa.int64()), pa.array(piece, pa.int32()), longs(start), longs(length), longs([zlib.crc32(x) for x in payload])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(payload, pa.binary())] if ids else []), names)
        coder.rest()
        give_back(keep="tokens")

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# ---- the program over the histogram -------------------------------------------------------------


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack by dynamic programming: for every room, the length last put into the most valuable filling, and the room that this filling uses."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    known = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(int(lengths[0]), capacity + 1):
        gain = value[: known[w]] + best[w - lengths[: known[w]]]
        i = gain.argmax()
        if gain[i] >= best[w - 1]:
            best[w], taken[w] = gain[i], i
        else:
            best[w] = best[w - 1]
    return taken, np.maximum.accumulate(np.where(taken >= 0, np.arange(capacity + 1), 0))


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used: a fractional cover of ``need``, met exactly, by multiplicative weights.

    A length weighs its volume, times a factor that falls exponentially in the part of its need already covered. One knapsack table prices, for each of
    the ``COLUMNS`` least covered lengths, the best configuration with it. A configuration is used as far as a quarter of its scarcest need, in whole numbers where that leaves any, and
    never beyond a need; so lengths are covered evenly, and the sum exceeds the bound by volume only by what configurations leave empty.
    """
    left, used = need.astype(float).copy(), {}
    while True:
        share = 1 - left / need
        short = np.flatnonzero(left > 1e-9 * need)
        if not len(short):
            break
        inner = lengths[short]
        taken, reach = price(inner / capacity * np.exp(-SPEED * (share[short] - share[short].min())), inner, capacity)
        for start in short[np.argsort(share[short], kind="stable")[:COLUMNS]].tolist():
            if left[start] <= 1e-9 * need[start]:
                continue
            items, room = {start: 1}, capacity - int(lengths[start])
            while (room := int(reach[room])) > 0:
                i = int(short[taken[room]])
                items[i] = items.get(i, 0) + 1
                room -= int(lengths[i])
            amount, most = STEP * min(need[i] / k for i, k in items.items()), min(left[i] / k for i, k in items.items())
            amount = min(most, np.floor(amount) if amount >= 1 else 1.0 if most >= 1 else amount)
            if amount <= 1e-12:
                continue
            key = tuple(sorted(items.items()))
            used[key] = used.get(key, 0.0) + amount
            for i, k in items.items():
                left[i] -= amount * k
    out = []
    for key, amount in used.items():
        counts = np.zeros(len(lengths), np.int64)
        counts[[i for i, _ in key]] = [k for _, k in key]
        out.append((counts, float(amount)))
    return out


def _best_fit(rest: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Sequences filled from the longest piece left, each time with the longest that still fits; equal ones at once."""
    out = []
    rest = rest.copy()
    while rest.any():
        counts, space = np.zeros(len(lengths), np.int64), capacity
        i = int(np.flatnonzero(rest)[-1])
        while i >= 0:
            n = int(min(rest[i] - counts[i], space // lengths[i]))
            counts[i] += n
            space -= n * int(lengths[i])
            fits = np.flatnonzero((rest - counts > 0) & (lengths <= space))
            i = int(fits[-1]) if len(fits) else -1
        inside = counts > 0
        times = max(1, int((rest[inside] // counts[inside]).min()))
        out.append((counts, times))
        rest -= times * counts
    return out


def _rounded(solved: list[tuple[np.ndarray, float]], need: np.ndarray, lengths: np.ndarray, capacity: int, waste: float) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Whole uses of the configurations that leave at most ``waste`` of a sequence empty, then best fit for the rest; and how many sequences are the program's."""
    out, rest = [], need.astype(np.int64)
    good = sorted([(c, x) for c, x in solved if c @ lengths >= capacity * (1 - waste)], key=lambda c: -int(c[0] @ lengths))
    for up in (False, True):
        for counts, x in good:
            inside = np.flatnonzero(counts)
            times = min(int(x % 1 >= 0.5) if up else int(x + 1e-9), int((rest[inside] // counts[inside]).min()))
            if times > 0:
                out.append((counts, times))
                rest[inside] -= times * counts[inside]
    return out + _best_fit(rest, lengths, capacity), sum(n for _, n in out)


def layouts(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((length, count), ...) and in how many sequences it is laid out; together they hold the histogram exactly.

    Full lengths are sequences of their own. The fractional solution is rounded at several tolerances of waste, each completed by best fit. The rounding with
    the fewest sequences is taken, of equal ones that with most from the program; best fit alone is a last rounding, so that the result is never worse.
    """
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if left.get(capacity):
        out.append((((capacity, 1),), left.pop(capacity)))
    if not left:
        return out
    lengths = np.array(sorted(left), np.int64)
    need = np.array([left[int(x)] for x in lengths], np.int64)
    solved = solve(lengths, need, capacity)
    tried = [_rounded(solved, need, lengths, capacity, waste) for waste in WASTES] + [(_best_fit(need, lengths, capacity), 0)]
    best, _ = min(tried, key=lambda r: (sum(n for _, n in r[0]), -r[1]))
    return out + [(tuple((int(lengths[i]), int(c[i])) for i in np.flatnonzero(c)[::-1]), n) for c, n in best]


def places(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, k, sequence, offset): pieces ``first`` to ``end`` of a length lie k a sequence, from there on."""
    rows, next_of, sequence = [], {}, 0
    for items, times in found:
        offset = 0
        for length, k in items:
            first = next_of.get(length, 0)
            rows.append((length, first, first + k * times, k, sequence, offset))
            next_of[length] = first + k * times
            offset += k * length
        sequence += times
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 5_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id and offset.

    Pieces of a length are numbered in buckets of a hash of (doc_id, piece), so that a length most pieces
    have is spread; the buckets are offset by the counts before. The order inside a bucket is by id and piece; equal rows may swap.
    The table of places grows with the configurations, a few for each length, of which there are at most ``capacity``; not with pieces.
    """
    spark = pieces.sparkSession
    frozen = cut(pieces)
    histogram = {r.length: r.n for r in frozen.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(layouts(histogram, capacity))
    by_length = {}
    for row in rows:
        by_length.setdefault(row[0], []).append(row[1:])
    buckets = max(1, sum(histogram.values()) // per_bucket)
    keyed = frozen.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = keyed.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    ranked = inside.join(before, ["length", "_bucket"]).withColumn("_rank", (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before")
    schema = ranked.schema
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def run(batches):
        found = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                t = found[int(x)]
                row = t[np.searchsorted(t[:, 1], rank[at], side="right")]
                inner = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + inner // row[:, 2]
                offset[at] = row[:, 4] + inner % row[:, 2] * x
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([batch[n] for n in keep] + [longs(sequence), longs(offset)], [*keep, "sequence_id", "offset"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{names}, sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of whole documents with the byte vocabulary."""
    import public_tokenizers

    return place(cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False))


@query("op6_configuration_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
