"""Token ids as binary shards with a minimal perfect hash index over document keys.

A shard is one file: the raw ids of its documents in ascending doc_id order, little-endian unsigned 16-bit, each document closed
by the end id, and after them a footer of keys and lengths. Spark's text writer makes the files
with the end id as its line separator, so they appear by Spark's commit and in any store it can write.

The index holds, per bucket of hashed keys, a minimal perfect hash: levels of bit arrays place a key where no other
key of the level falls, its rank among the set bits is its slot, and the slot has a fingerprint, the shard, the offset and the length.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.lineage import _shared_folder, cut
from assaylake.llm.common import binary_of, longs, slices, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.tokens import encoder

END_ID = 2
MAGIC = b"IDSHARD1"
NULL_KEY = np.iinfo(np.int64).min
STEP_BYTES = 1 << 20


# ---- writing ------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, tokenizer: str, spaces: str = "dropped", end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as shards under ``path``; part numbers are in the order of doc_id, null first.

    Whole texts are encoded; a null or empty text is the end id alone. Rows of equal doc_id lie next to each other
    in one shard, in the order of a hash of their texts. An empty table writes no document.
    """
    separator = np.array([end_id], "<u2").tobytes()
    if max(separator) > 127:
        raise ValueError("the end id's bytes must be ASCII, they are the separator of a text file")

    def run(batches):
        coder = encoder(tokenizer, spaces, 2)
        keys, sizes = [], []
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                data, at = binary_of(part["text"])
                raw = data.tobytes()
                ids = coder.encode([raw[a:b] for a, b in zip(at, at[1:])])
                keys += [NULL_KEY if k is None else k for k in part["doc_id"].to_pylist()]
                sizes += [len(x) // 2 + 1 for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["row"])
        if keys:
            footer = np.array(keys, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + struct.pack("<Q", len(keys)) + MAGIC
            yield pa.RecordBatch.from_arrays([pa.array([footer], pa.binary())], ["row"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    ranged = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, "row binary").select(F.col("row").cast("string")).write.option("lineSep", separator.decode()).text(path)


# ---- reading ------------------------------------------------------------------------------------


def footer_of(content: bytes, separator: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lengths of a shard's documents, from its last bytes."""
    end = len(content) - separator
    n, magic = struct.unpack("<Q8s", content[end - 16 : end])
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    start = end - 16 - 12 * n
    return np.frombuffer(content, "<i8", n, start), np.frombuffer(content, "<u4", n, start + 8 * n)


def ids_at(content: bytes, offset: int, n: int) -> np.ndarray:
    """The ids of a document that begins ``offset`` ids into a shard."""
    return np.frombuffer(content, "<u2", n, 2 * offset)


def scan(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """shard, key (null ids as the least long), nth, offset, n and crc32 of the ids as 32-bit; with ``ids``, ids too. A row per document, whole shards read."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                content = content.as_py()
                if not content:
                    continue
                keys, sizes = footer_of(content)
                at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
                texts = [ids_at(content, int(o), int(n)).astype("<u4").tobytes() for o, n in zip(at, sizes)]
                out = [pa.array([name.rsplit("/", 1)[-1]] * len(keys)), longs(keys), longs(nth), longs(at[:-1]), longs(sizes), longs([zlib.crc32(x) for x in texts])]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(texts, pa.binary())] if ids else []), NAMES + (["ids"] if ids else []))

    files = spark.read.format("binaryFile").load(path).where(F.element_at(F.split("path", "/"), -1).startswith("part-")).select("path", "content")
    return files.mapInArrow(run, "shard string, key long, nth long, offset long, n long, crc32 long" + (", ids binary" if ids else ""))


NAMES = ["shard", "key", "nth", "offset", "n", "crc32"]


# ---- the index ----------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, nth: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of (key, nth) for a salt."""
    x = keys.astype(np.int64).view(np.uint64) ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(int.from_bytes(hashlib.sha256(str(salt).encode()).digest()[:8], "little"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray, nth: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and every key's slot. Keys must differ; slots are 0 to len(keys) - 1, each used once."""
    levels, slots = [], np.full(len(keys), -1, np.int64)
    left, taken = np.arange(len(keys)), 0
    while len(left):
        if len(levels) > 200:
            raise ValueError("equal keys cannot be told apart")
        size = max(64, int(gamma * len(left)))
        at = (_mixed(keys[left], nth[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = taken + (np.cumsum(bits) - 1)[at[alone]]
        levels.append(bits)
        taken, left = taken + int(bits.sum()), left[~alone]
    return levels, slots


def find(levels: list[np.ndarray], keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Slots of keys; a key that was never there gets some slot or -1, the fingerprint tells."""
    slots, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        if not len(left):
            break
        at = (_mixed(keys[left], nth[left], i) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before, left = before + int(bits.sum()), left[~hit]
    return slots


def _fingerprint(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (_mixed(keys, nth, -1) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key", "nth"), F.lit(buckets)).cast("int")


def build_index(documents: DataFrame, per_bucket: int = 50_000) -> tuple[DataFrame, int]:
    """The index of scanned documents and its number of buckets.

    A row per bucket: the levels as packed bits, and fingerprint, shard, offset and n per slot. A bucket holds about ``per_bucket`` keys, however many there are.
    """
    buckets = max(1, documents.count() // per_bucket)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, nth = group["key"].to_numpy(), group["nth"].to_numpy()
        levels, slots = build(keys, nth)
        order = np.argsort(slots)
        columns = {"fingerprint": _fingerprint(keys, nth)[order], "offset": group["offset"].to_numpy()[order], "n": group["n"].to_numpy()[order]}
        bits = [np.packbits(b).tobytes() for b in levels]
        return pd.DataFrame([{"bucket": int(group["bucket"].iloc[0]), "sizes": [len(b) for b in levels], "bits": bits, "shard": list(group["shard"].to_numpy()[order]), **{k: list(v) for k, v in columns.items()}}])

    schema = "bucket int, sizes array<long>, bits array<binary>, shard array<string>, fingerprint array<long>, offset array<long>, n array<long>"
    keyed = documents.select("key", "nth", "shard", "offset", "n", _bucket(buckets).alias("bucket"))
    return cut(keyed.groupBy("bucket").applyInPandas(run, schema)), buckets


def locate(index: DataFrame, buckets: int, wanted: DataFrame) -> DataFrame:
    """key, nth, shard, offset, n of ``wanted`` keys (key, nth); keys that the index lacks are left out."""

    def run(keys: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if keys.empty or rows.empty:
            return pd.DataFrame({"key": [], "nth": [], "shard": [], "offset": [], "n": []}).astype({"key": "int64", "nth": "int64", "shard": "str", "offset": "int64", "n": "int64"})
        row = rows.iloc[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(size)).astype(bool) for b, size in zip(row["bits"], row["sizes"])]
        key, nth = keys["key"].to_numpy(), keys["nth"].to_numpy()
        slots = find(levels, key, nth)
        same = slots >= 0
        same[same] = np.asarray(row["fingerprint"])[slots[same]] == _fingerprint(key[same], nth[same])
        at = slots[same]
        return pd.DataFrame({"key": key[same], "nth": nth[same], "shard": np.asarray(row["shard"], object)[at], "offset": np.asarray(row["offset"])[at], "n": np.asarray(row["n"])[at]})

    keyed = wanted.select("key", "nth", _bucket(buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(run, "key long, nth long, shard string, offset long, n long")


def starts(documents: DataFrame) -> DataFrame:
    """shard and the ids of all shards before it. One row per shard meets in a window."""
    sums = documents.groupBy("shard").agg(F.sum("n").alias("_n"))
    return sums.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("before"))


def keys_of(docs: DataFrame) -> DataFrame:
    """key and nth of every row: the doc_id, and its number among rows of that id."""
    counted = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_KEY))).alias("key")).agg(F.count("*").alias("_k"))
    return counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("nth"))


def round_trip(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, found by its key in the index over the files just written."""
    spark = docs.sparkSession
    write_shards(docs, path, tokenizer)
    documents = cut(scan(spark, path, ids=False))
    index, buckets = build_index(documents)
    found = locate(index, buckets, keys_of(docs))
    read = documents.select("shard", "offset", "n", "crc32").join(starts(documents), "shard")
    return found.join(read, ["shard", "offset", "n"]).select(
        F.when(F.col("key") != int(NULL_KEY), F.col("key")).alias("doc_id"), (F.col("before") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32")
    )


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), f"{_shared_folder(spark)}/ids-{uuid.uuid4().hex}")
