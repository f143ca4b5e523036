"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, over the code points of many texts at once, prefix sums of c · B^i modulo two primes. The hash of any span follows from two
entries, so spans are compared in constant time and longest common extensions found by binary search, for all pairs of a block together.
A fingerprint samples these hashes: the length, the hash of the whole text, and the hashes of its beginnings and ends at fixed, growing lengths. Two
fingerprints are alike by the longest beginning and end they share, found by binary search over the samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import spread
from assaylake.llm.common import KEPT, longs, slices, small_batches, table
from assaylake.llm.registry import query

#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003721, 1812433253)
#: Sampled lengths grow by this factor.
GROWTH = 1.2
BLOCK_BYTES = 2 << 20
_POWERS: dict[tuple[int, int], np.ndarray] = KEPT.setdefault("prefix_hashes", {})
_LENGTHS = np.zeros(0, np.int64)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 … base^(n - 1) modulo prime, by doubling; kept up to four million."""
    have = _POWERS.get((base, prime), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
    if len(have) <= 1 << 22:
        _POWERS[base, prime] = have
    return have[:n]


class Prefixes:
    """Modular prefix arrays over the code points of one or many texts laid end to end."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.n = n
        self.sums, self.inverse = [], []
        for base, prime in zip(BASES, PRIMES):
            terms = (points.astype(np.int64) + 1) * _powers(base, prime, n) % prime
            sums = np.zeros(n + 1, np.int64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % prime)
            self.inverse.append(_powers(pow(base, -1, prime), prime, n + 1))

    def spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, the same for equal spans wherever they stand."""
        first, second = ((sums[start + length] - sums[start]) % prime * inverse[start] % prime for sums, inverse, prime in zip(self.sums, self.inverse, PRIMES))
        return first << 31 | second

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.spans(a, length) == self.spans(b, length)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extensions, of at most ``most``: forward from places a and b, or back from the places a and b end at."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a - half, b - half, half) if back else self.equal(a, b, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def lengths(most: int) -> np.ndarray:
    """Sampled lengths up to ``most``: 1, 2, 3, … growing by a fifth; the same for all texts."""
    global _LENGTHS
    if not len(_LENGTHS) or _LENGTHS[-1] <= most:
        at, out = 1.0, []
        while not out or out[-1] <= most:
            step = int(at)
            if not out or step > out[-1]:
                out.append(step)
            at = max(at * GROWTH, at + 0.2)
        _LENGTHS = np.array(out, np.int64)
    return _LENGTHS[_LENGTHS <= most]


class Samples:
    """The sampled hashes of many texts: whole hash, length, and a row of 32-bit samples for beginnings and ends."""

    def __init__(self, prefixes: Prefixes, start: np.ndarray, n: np.ndarray):
        self.n = n
        self.whole = prefixes.spans(start, n)
        at = lengths(int(n.max()) if len(n) else 0)
        row, column = np.nonzero(at[None, :] < n[:, None])
        self.front = np.full((len(n), len(at)), -1, np.int64)
        self.back = self.front.copy()
        self.front[row, column] = prefixes.spans(start[row], at[column]) & 0xFFFFFFFF
        self.back[row, column] = prefixes.spans(start[row] + n[row] - at[column], at[column]) & 0xFFFFFFFF

    def strings(self) -> list[str]:
        """length : whole hash : beginnings : ends, hashes in hexadecimal."""
        used = (self.front >= 0).sum(axis=1)
        hexed = lambda m, i: m[i, : used[i]].astype(">u4").tobytes().hex()
        return [f"{n}:{whole:016x}:{hexed(self.front, i)}:{hexed(self.back, i)}" for i, (n, whole) in enumerate(zip(self.n.tolist(), self.whole.tolist()))]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _likeness(*[(self.n[x], self.whole[x], self.front[x], self.back[x]) for x in (a, b)])


def _agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples of each row agree, by binary search: the hash of a longer beginning cannot agree where a shorter one does not."""
    low = np.zeros(len(a), np.int64)
    high = np.minimum((a >= 0).sum(axis=1), (b >= 0).sum(axis=1))
    rows = np.arange(len(a))
    while (low < high).any():
        half = (low + high + 1) // 2
        place = np.maximum(half - 1, 0)
        same = (half == 0) | (a[rows, place] == b[rows, place]) if a.shape[1] else half == 0
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _likeness(a, b) -> np.ndarray:
    (na, wa, fa, ba), (nb, wb, fb, bb) = a, b
    known = np.concatenate([[0], lengths(int(max(na.max(initial=0), nb.max(initial=0))))])
    shared = known[_agreed(fa, fb)] + known[_agreed(ba, bb)]
    longer = np.maximum(np.maximum(na, nb), 1)
    part = np.minimum(np.minimum(shared, np.minimum(na, nb)), longer - 1) / longer
    return np.where((na == nb) & (wa == wb), 1.0, part)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from the strings alone.

    1 for equal texts. Else the shared beginning and end, rounded down to sampled lengths, as a part of the longer text; below 1.
    """

    def parsed(text):
        n, whole, front, back = text.split(":")
        row = lambda x: np.frombuffer(bytes.fromhex(x), ">u4").astype(np.int64)[None, :]
        return np.array([int(n)]), np.array([int(whole, 16)]), row(front), row(back)

    return float(_likeness(parsed(a), parsed(b))[0])


DEALT = "part long, doc_id long, following boolean, n_bytes long, text binary"
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, begins_alike long, ends_alike long"


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """The texts, compressed, in ``parts`` ranges of descending doc_id; the first row of each range once more, marked, at the end of the range before.

    Only ids are read to find the ranges. A range is a cut between ids, so equal ids stay together.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    shares = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("q")).first().q or [], np.int64)) if parts > 1 else np.zeros(0, np.int64)

    def part_of(keys: pa.Array) -> np.ndarray:
        """Range 0 has the largest ids; ids that are null come after all others."""
        part = len(cuts) - np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), len(cuts), part)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([longs(part_of(batch["doc_id"])), batch["doc_id"]], ["part", "doc_id"])

    found = docs.select(F.col("doc_id").cast("long")).mapInArrow(largest, "part long, doc_id long").groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = dict(found.collect())
    order = sorted(heads)
    before = {of: order[i - 1] for i, of in enumerate(order)}

    def deal(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                keys, texts = rows["doc_id"], rows["text"].to_pylist()
                columns: list[list] = [[], [], [], [], []]
                for key, of, text in zip(keys.to_pylist(), part_of(keys).tolist(), texts):
                    plain = (text or "").encode()
                    packed = codec.compress(plain, asbytes=True)
                    for place, following in [(of, False)] + [(before[of], True)] * (heads[of] == key):
                        for column, value in zip(columns, (place, key, following, len(plain), packed)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["part", "doc_id", "following", "n_bytes", "text"])

    return small_batches(spread(docs.select(F.col("doc_id").cast("long"), "text"))).mapInArrow(deal, DEALT)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows (part, doc_id, following, text) of about a block's bytes; the last row of a run is the first of the next."""
    held, size = [], 0
    codec = pa.Codec("zstd")
    for batch in batches:
        for part, key, following, n, packed in zip(*[batch[c].to_pylist() for c in ("part", "doc_id", "following", "n_bytes", "text")]):
            held.append((part, key, following, codec.decompress(packed, decompressed_size=n, asbytes=True).decode() if n else ""))
            size += n
            if size > BLOCK_BYTES and len(held) > 1:
                yield held
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield held


def _compared(block: list[tuple]) -> pa.RecordBatch | None:
    at = [i for i, (row, after) in enumerate(zip(block, block[1:])) if not row[2] and row[0] == after[0]]
    if not at:
        return None
    texts = [row[3] for row in block]
    edited = []
    for i in at:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    sizes = np.array([len(t) for t in texts + edited], np.int64)
    start = np.cumsum(sizes) - sizes
    prefixes = Prefixes(np.frombuffer("".join(texts + edited).encode("utf-32-le"), np.uint32))
    samples = Samples(prefixes, start, sizes)
    own, following, new = np.array(at), np.array(at) + 1, len(texts) + np.arange(len(at))
    least = np.minimum(sizes[own], sizes[following])
    begins = prefixes.extension(start[own], start[following], least)
    ends = prefixes.extension(start[own] + sizes[own], start[following] + sizes[following], least, back=True)
    prints = samples.strings()
    columns = [
        pa.array([block[i][1] for i in at], pa.int64()),
        longs(sizes[own]),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([prints[i] for i in own]),
        pa.array([prints[i] for i in new]),
        pa.array(samples.likeness(own, new)),
        pa.array(samples.likeness(own, following)),
        longs(begins),
        longs(ends),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, their likeness, and its likeness to the next document.

    Documents are in descending doc_id, null ids last, rows of equal id by their text; after the last comes the first again. The edited text has the last half of the code
    points (rounded down) replaced by as many first ones of the next document, or all it has. A null text is empty; a single row is its own next; an empty table gives no
    rows. Only doc_id and text are read. begins_alike and ends_alike are the exact longest common extensions with the next document, in code points.
    Every text travels once, compressed, to a range of ids and is streamed there in order; one text, its edit and the next are held at a time at least.
    """
    sc = docs.sparkSession.sparkContext
    parts = parts or max(sc.defaultParallelism * 4, docs.rdd.getNumPartitions())

    def compare(batches):
        for block in _blocks(batches):
            out = _compared(block)
            if out is not None:
                yield out

    order = ["part", "following", F.col("doc_id").desc_nulls_last(), "text"]
    return _dealt(docs, parts).repartition("part").sortWithinPartitions(*order).mapInArrow(compare, OUT)


@query("op12_prefix_hashes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
