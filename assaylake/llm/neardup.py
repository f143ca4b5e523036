"""Near-duplicates by an LSH forest over word shingles, confirmed on full sets.

A document is the set of its five-word shingles. Equal sets are one class. Each tree of the forest orders the classes by a signature of
min-hashes; classes whose longest common prefix reaches the tree's depth lie next to each other and are a region. Where a region is too large
for a task, its classes get more and deeper trees, which keeps the chance to miss a link as small as before. In a region every class
that isn't linked to the region's middle is compared with all others, exactly, without writing pairs out; links of all regions give the components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import binary_of, give_back, longs, slices, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.terms import LOWER, SPACES, U, hashes, mixed, runs

WORDS = 5
PERCENT = 85
#: (trees, depth) of the forest and of what dense regions get in its place. At 85% a link is missed by all trees of a level with a chance under 10^-6.
LEVELS = ((16, 3), (32, 6), (64, 9), (128, 12))
MOST_CLASSES = 2_048
MOST_SHINGLES = 4_000_000
STEP_BYTES = 1 << 20
#: Bits of the marks of wanted documents, and how many documents they serve at most.
MARK_BITS = 1 << 25
MOST_MARKED = 1 << 22


# ---- sets and signatures ------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, joined, and where each text's begin.

    Only A-Z are lower-cased. A text of fewer words is one shingle of them all; one without words has none.
    """
    data = LOWER[data]
    n = len(at) - 1
    start, end, row = runs(~SPACES[data], at)
    word = hashes(data, start, end)
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    out, rows = [], []
    if len(word) >= words:
        whole = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :])
        value = np.zeros(len(whole), U)
        for j in range(words):
            value = mixed(value * U(3) + word[whole + j] + U(j + 1))
        out.append(value)
        rows.append(row[whole])
    for k in range(1, words):
        some = np.flatnonzero(counts == k)
        if len(some):
            value = np.zeros(len(some), U)
            for j in range(k):
                value = mixed(value * U(5) + word[first[some] + j] + U(100 * k + j))
            out.append(value)
            rows.append(some)
    value = np.concatenate(out) if out else np.zeros(0, U)
    of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], np.searchsorted(of[new], np.arange(n + 1))


def prefixes(value: np.ndarray, begin: np.ndarray, level: int) -> np.ndarray:
    """texts × trees: a hash of the first ``depth`` min-hashes of each tree of a level. Texts without shingles get zeros."""
    trees, depth = LEVELS[level]
    n = len(begin) - 1
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    out = np.zeros((n, trees), U)
    if not len(filled):
        return out
    draw = np.random.default_rng(1000 + level)
    for t in range(trees):
        key = np.full(len(filled), t + 1, U)
        for _ in range(depth):
            a, b = (int(x) for x in draw.integers(1, 1 << 62, 2))
            low = np.minimum.reduceat((value ^ U(b)) * U(2 * a + 1), begin[filled])
            key = mixed(key * U(7) + low)
        out[filled, t] = key
    return out


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bit for the hash of every wanted id: at most MARK_BITS / 8 bytes, however many ids."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)) + 1  # the bitmap functions count from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = np.zeros(MARK_BITS // 8 + 4096, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _of(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, object]:
    """Documents among which are all the wanted ones (doc_id), and marks that tell nearly all others apart.

    Up to MOST_MARKED wanted documents are told by broadcast marks, and texts stay where they are; more are joined.
    """
    if wanted.count() > MOST_MARKED:
        return docs.join(wanted, "doc_id", "left_semi"), None
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARK_BITS)).alias("spot")
    return docs.select("doc_id", "text", spot), docs.sparkSession.sparkContext.broadcast(_marks(wanted))


def _per_text(docs: DataFrame, level: int | None, sets: bool, marks=None) -> DataFrame:
    """doc_id, n, print (a 128-bit hash of the set), and the level's prefixes or the set; with ``marks``, of marked documents."""

    def run(batches):
        for batch in batches:
            if marks is not None:
                spot = batch["spot"].to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((marks.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, "text", STEP_BYTES):
                value, begin = shingle_sets(*binary_of(part["text"]))
                raw = value.tobytes()
                own = [raw[8 * a : 8 * b] for a, b in zip(begin, begin[1:])]
                out = [part["doc_id"].cast(pa.int64()), longs(np.diff(begin)), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary())]
                names = ["doc_id", "n", "print"]
                if sets:
                    out.append(pa.array(own, pa.binary()))
                    names.append("set")
                if level is not None:
                    keys = prefixes(value, begin, level)
                    out.append(pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], longs(keys.ravel().view(np.int64))))
                    names.append("prefixes")
                yield pa.RecordBatch.from_arrays(out, names)
        give_back()

    schema = "doc_id long, n long, print binary" + (", set binary" if sets else "") + (", prefixes array<long>" if level is not None else "")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *(["spot"] if marks is not None else [])]
    rows = small_batches(docs).where("doc_id is not null") if marks is not None else small_batches(docs)
    return rows.select(*columns).mapInArrow(run, schema)


# ---- regions ------------------------------------------------------------------------------------


def _regions(classes: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Members of regions (region, rep), each set of members once, and the classes of regions too large for a task.

    On the last level a large region is dealt into blocks, and every two of them are a region: exact, at a cost of
    as many copies of its classes as it has blocks.
    """
    keyed = classes.select("rep", "n", F.posexplode("prefixes").alias("tree", "key")).select("rep", "n", F.xxhash64("tree", "key").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_k"), F.sum("n").alias("_n")).where("_k > 1")
    large = (F.col("_k") > MOST_CLASSES) | (F.col("_n") > MOST_SHINGLES)
    found = cut(keyed.join(sizes.withColumn("_large", large), "key"))
    small = found.where(~F.col("_large")).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("members"))
    once = small.groupBy("members").agg(F.min("key").alias("region"))
    members = once.select("region", F.explode("members").alias("rep"))
    dense = found.where("_large")
    if last:
        blocks = F.greatest(F.lit(2), F.ceil(F.greatest(F.col("_k") / (MOST_CLASSES / 2), F.col("_n") / (MOST_SHINGLES / 2)))).cast("int")
        dealt = dense.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
        paired = dealt.select("key", "rep", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
        members = members.unionByName(paired.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("region"), "rep"))
    return members, dense.select("rep").distinct()


def linked(sizes: np.ndarray, value: np.ndarray, percent: int) -> np.ndarray:
    """Smallest index of the component of each of the sets that stand joined in ``value``.

    Every set not linked to the middle one is compared with all others by counting shared shingles along their lists.
    """
    g = len(sizes)
    owner = np.repeat(np.arange(g), sizes)
    _, token = np.unique(value, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    start = np.searchsorted(token[order], np.arange(token.max() + 2)) if len(token) else np.zeros(1, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    often = np.diff(start)[token]
    parent = np.arange(g)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def near(i: int) -> np.ndarray:
        own = token[begin[i] : begin[i + 1]]
        lengths = start[own + 1] - start[own]
        spots = np.repeat(start[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(holders[spots], minlength=g)
        return np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))

    middle = int(np.argmax(np.add.reduceat(often, begin[:-1]) / sizes)) if g else 0
    centre = near(middle)
    for i in centre:
        a, b = root(int(i)), root(middle)
        parent[max(a, b)] = min(a, b)
    for i in np.setdiff1d(np.arange(g), centre):
        for j in near(int(i)):
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(g)])


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that hold the components of every region together."""

    def run(group: pa.Table) -> pa.Table:
        rep = group["rep"].combine_chunks().to_numpy()
        data, at = binary_of(group["set"])
        order = np.argsort(rep, kind="stable")
        value = np.frombuffer(data.tobytes(), U)
        ends = at // 8
        own = [value[ends[i] : ends[i + 1]] for i in order]
        rep = rep[order]
        top = linked(np.array([len(x) for x in own], np.int64), np.concatenate(own), percent)
        some = np.flatnonzero(top != np.arange(len(rep)))
        if len(data) > 1 << 20:
            give_back()
        return pa.Table.from_arrays([longs(rep[top[some]]), longs(rep[some])], ["a", "b"])

    return members.join(sets, "rep").groupBy("region").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root: the smallest node reachable, for every node of ``links`` (a, b).

    Every round points nodes to their smallest neighbour, follows the pointers to their ends, doubling steps, and carries the
    links there, until none is left. Every tree of pointers becomes one node, so nodes at least halve each round.
    """
    total = None
    while True:
        links = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if links.isEmpty():
            return cut(links.select(F.col("a").alias("node"), F.col("b").alias("root"))) if total is None else total
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_node"), F.least("a", "_m").alias("_up")))
        while True:
            over = up.select(F.col("_node").alias("_at"), F.col("_up").alias("_next"))
            jumped = cut(up.join(over, F.col("_up") == F.col("_at")).select("_node", F.col("_next").alias("_up"), (F.col("_next") != F.col("_up")).alias("_moved")))
            up = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        if total is None:
            total = up.select(F.col("_node").alias("node"), F.col("_up").alias("root"))
        else:
            total = cut(total.join(up, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_up", "root").alias("root")))
        ups = lambda x: up.select(F.col("_node").alias(x), F.col("_up").alias(f"_{x}"))  # noqa: E731, B023
        links = links.join(ups("a"), "a").join(ups("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per input row.

    Two documents are linked when their sets share at least ``percent`` in a hundred of their union; component_id is the
    smallest id reachable. Texts that are null or have no words are linked with nothing, and so are rows without an id (kept, without a
    component). Repeated rows are of one class; rows of one id but other texts each follow their own text.
    """
    light = cut(_per_text(docs, 0, sets=False))
    real = light.where("n > 0 and doc_id is not null")
    classes = cut(real.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefixes").alias("prefixes")))
    links, todo = None, classes
    for level in range(len(LEVELS)):
        members, dense = _regions(todo, last=level == len(LEVELS) - 1)
        members = cut(members)
        texts, marks = _of(docs, members.select(F.col("rep").alias("doc_id")).distinct())
        sets = _per_text(texts, None, sets=True, marks=marks).join(classes.select("print", "rep"), "print").where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "set")
        found = cut(_links(members, sets, percent))
        links = found if links is None else links.unionByName(found)
        dense = cut(dense)
        if dense.isEmpty() or level == len(LEVELS) - 1:
            break
        texts, marks = _of(docs, dense.select(F.col("rep").alias("doc_id")))
        todo = cut(_per_text(texts, level + 1, sets=False, marks=marks).join(classes.select("print", "rep"), "print").where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "n", "prefixes"))
    tops = classes.select("print", "rep").join(components(links), F.col("rep") == F.col("node"), "left").select("print", F.coalesce("root", "rep").alias("_top"))
    own = light.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    placed = own.join(tops, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_top", "doc_id").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS sh FROM d, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(2, len(ws) - 3) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, b AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS (SELECT doc_id, min(to_id) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op9_lsh_forest", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
