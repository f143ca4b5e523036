"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns, named by a chained 128-bit hash. Spark sums its members. Nodes with
more than a set number of members are the tops, few by count; every subtree hanging from them is dealt whole to a
shard. A shard reads its nodes in reverse level order (sorted by Spark, which spills) and passes subtree totals to parents through a
priority queue that spills sorted runs; what leaves the shard roots is summed per top, and the tops are processed the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import table
from assaylake.llm.registry import query

#: Conversations borrow the beginning of the first of so many, at most so many turns less one.
FAMILY, MOST_BORROWED = 5, 9
#: A node is a top when it has more than a 1024th of all conversations, and more than so many.
TOP_SHARE, TOP_LEAST = 1024, 1000
#: Messages a queue holds before a sorted run is spilled, and bytes of ids hashed as one piece.
MOST_HELD = 1 << 17
PIECE_BYTES = 64 << 10
ROOT = b"\0" * 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest (16 bytes of role and text), n_bytes of the text.

    Turns are in the order of ``turn``, null first; equal ones follow by digest. A null role or text is empty, a row without
    conv_id takes no part. Texts are not shuffled, only their digests.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("at"), "digest", "n_bytes")


def rebuilt(original: DataFrame) -> DataFrame:
    """conv_id, at, digest, n_bytes of the rebuilt conversations; ``at`` only orders, and a row with at = 0 stands for each conversation.

    Conversation c starts with the first h turns of conversation c - c % 5 (the remainder has the sign of c) and goes on with its own after the first h;
    h is the crc32 of the decimal c, modulo 9.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = original.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < MOST_BORROWED)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "n_bytes"))).alias("head")
    )
    every = original.where("at = 1").select("conv_id", base.alias("base"), h.alias("h"))
    borrowed = every.join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("t")).select("conv_id", F.col("t.at").cast("long").alias("at"), "t.digest", "t.n_bytes")
    own = original.where(F.col("at") > h).select("conv_id", (F.col("at") + MOST_BORROWED).cast("long").alias("at"), "digest", "n_bytes")
    marks = every.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return marks.unionByName(borrowed).unionByName(own)


PATH = "conv_id long, depth long, node binary, parent binary, n_bytes long, ends boolean"


def _rows(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def paths(sequences: DataFrame) -> DataFrame:
    """A row per conversation and prefix of it, the empty one included; ``ends`` where the conversation has no further turn.

    A conversation passes through one task in order, one turn held at a time.
    """
    schema = [("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("ends", pa.bool_())]

    def chain(batches):
        last = None
        for batch in batches:
            out = []
            for conv, digest, n in zip(*[batch[c].to_pylist() for c in ("conv_id", "digest", "n_bytes")]):
                if last is not None:
                    out.append((*last, last[0] != conv))
                if digest is None:
                    last = (conv, 0, ROOT, None, 0)
                else:
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + digest).digest()[:16], last[2], n)
            if out:
                yield _rows([*zip(*out)], schema)
        if last is not None:
            yield _rows([[x] for x in (*last, True)], schema)

    return sequences.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(chain, PATH)


class SpillingQueue:
    """A priority queue of (order, payload …) tuples; beyond ``held`` of them, a sorted run goes to a file without a name in Spark's own spill folder.

    Runs belong to one task: they vanish with it, and a task that is run again makes them anew. Popped orders must not sink below what was popped before.
    """

    def __init__(self, held: int = MOST_HELD):
        self.held, self.heap, self.runs, self.n_runs = held, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        folders = os.environ.get("SPARK_LOCAL_DIRS", "")
        file = tempfile.TemporaryFile(dir=folders.split(",")[0] or None)
        items = sorted(self.heap)
        for i in range(0, len(items), 1024):
            pickle.dump(items[i : i + 1024], file, protocol=5)
        file.seek(0)
        self.heap = []
        self.n_runs += 1
        run = self._read(file)
        heapq.heappush(self.runs, (next(run), self.n_runs, run))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def pop_until(self, order: tuple) -> Iterator[tuple]:
        """Takes out, in order, what is not after ``order``."""
        while True:
            from_heap = self.heap and (not self.runs or self.heap[0] <= self.runs[0][0])
            if not from_heap and not self.runs:
                return
            item = self.heap[0] if from_heap else self.runs[0][0]
            if item[: len(order)] > order:
                return
            if from_heap:
                heapq.heappop(self.heap)
            else:
                _, n, run = self.runs[0]
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (following, n, run))
            yield item


TOTALS = "node binary, n_children long, n_leaves long, saved_tokens long"
MESSAGES = "parent binary, n_children long, n_leaves long, saved_tokens long"


def _forward(nodes: Iterable[tuple], held: int = MOST_HELD) -> Iterator[tuple]:
    """Time-forward processing of nodes in reverse level order.

    ``nodes``: (depth, node, parent, own saving, inside, children, leaves, savings), the last three what came from outside; inside where the parent is one of the
    nodes too. Yields (node, parent, inside, children, leaves, savings) with the totals of the subtree.
    """
    queue = SpillingQueue(held)
    for depth, node, parent, own, inside, children, leaves, saved in nodes:
        saved += own
        for _, _, more, gained in queue.pop_until((-depth, node)):
            children, leaves, saved = children + 1, leaves + more, saved + gained
        leaves = leaves or 1
        if inside:
            queue.push((1 - depth, parent, leaves, saved))
        yield node, parent, inside, children, leaves, saved


FIELDS = ["depth", "node", "parent", "own", "inside", "children", "leaves", "saved"]


def _processed(nodes: DataFrame, held: int = MOST_HELD) -> DataFrame:
    """node, parent, inside and subtree totals; ``nodes`` must come in reverse level order within each partition."""
    schema = [("node", pa.binary()), ("parent", pa.binary()), ("inside", pa.bool_()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())]

    def run(batches):
        rows = (row for batch in batches for row in zip(*[batch[c].to_pylist() for c in FIELDS]))
        out = []
        for row in _forward(rows, held):
            out.append(row)
            if len(out) == 8192:
                yield _rows([*zip(*out)], schema)
                out = []
        if out:
            yield _rows([*zip(*out)], schema)

    return nodes.select(*FIELDS).mapInArrow(run, "node binary, parent binary, inside boolean, n_children long, n_leaves long, saved_tokens long")


def subtree_totals(nodes: DataFrame, path: DataFrame, limit: int, held: int = MOST_HELD) -> DataFrame:
    """node, n_children, n_leaves, saved_tokens of every node: n_leaves and savings summed over its subtree.

    Tops are the nodes with more than ``limit`` members. Below them, a node belongs to the shard of the first node on the path to it that
    is no top. At every depth fewer than (conversations / limit) nodes are tops.
    """
    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    none = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    tops = cut(nodes.where(F.col("n_convs") > limit))
    depth_of_tops = path.join(tops.select("node"), "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    roots = path.select("conv_id", "depth", F.col("node").alias("shard")).join(depth_of_tops, "conv_id", "left").where(F.col("depth") == F.coalesce(F.col("deepest") + 1, F.lit(0))).select("conv_id", F.col("depth").alias("from"), "shard")
    below = nodes.where(F.col("n_convs") <= limit).join(roots, "conv_id").select("shard", "depth", "node", "parent", own.alias("own"), (F.col("depth") > F.col("from")).alias("inside"), *none)
    shards = cut(_processed(below.repartition("shard").sortWithinPartitions(F.col("depth").desc(), "node"), held))
    sent = shards.where("not inside and parent is not null").groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    waiting = tops.join(sent.withColumnRenamed("parent", "_to"), F.col("node") == F.col("_to"), "left").select(
        "depth", "node", "parent", own.alias("own"), F.col("parent").isNotNull().alias("inside"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("children", "leaves", "saved")]
    )
    totals = ["node", "n_children", "n_leaves", "saved_tokens"]
    return shards.select(*totals).unionByName(_processed(waiting.coalesce(1).sortWithinPartitions(F.col("depth").desc(), "node"), held).select(*totals))


def ends_digests(path: DataFrame) -> DataFrame:
    """node, ends_sha256: digest of the decimal ids, ascending and comma-joined, of the conversations that end there.

    Ids are ranged by (node, id), so a node with very many ends lies in several tasks; each joins its ids to pieces, and only pieces meet, in order.
    """
    ends = path.where("ends").select("node", "conv_id")
    pieces = [("node", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())]
    digests = [("node", pa.binary()), ("ends_sha256", pa.string())]

    def join(batches):
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            out = []
            for of, conv in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist()):
                if ids and (of != node or size > PIECE_BYTES):
                    out.append((node, first, ",".join(ids).encode()))
                    ids, size = [], 0
                if not ids:
                    node, first = of, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield _rows([*zip(*out)], pieces)
        if ids:
            yield _rows([[node], [first], [",".join(ids).encode()]], pieces)

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for of, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist()):
                if of != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = of, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
            if out:
                yield _rows([*zip(*out)], digests)
        if state is not None:
            yield _rows([[node], [state.hexdigest()]], digests)

    joined = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, piece binary")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int | None = None, held: int = MOST_HELD) -> DataFrame:
    """One row per node: node (its hash), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id take no part; repeated rows are turns of their own; an empty table has no nodes, not even a root. Only conv_id, turn, role and text are read.
    ``limit``: members above which a node is a top.
    """
    path = cut(paths(rebuilt(turns(conversations))))
    nodes = cut(path.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")
    ))
    if limit is None:
        everyone = nodes.where("depth = 0").first()
        limit = max(TOP_LEAST, (everyone.n_convs if everyone else 0) // TOP_SHARE)
    totals = subtree_totals(nodes, path, limit, held)
    # A parent with many children is a top, and tops are few; the others have at most ``limit`` children each.
    named = nodes.select(F.col("node").alias("_up"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_convs") > limit).alias("_top"))
    one, many = named.where("not _top").drop("_top"), named.where("_top").select(F.col("_up").alias("_upper"), F.col("parent_conv_id").alias("_of_top"))
    rows = nodes.join(cut(many), F.col("parent") == F.col("_upper"), "left")
    key = F.when(F.col("_upper").isNull(), F.col("parent"))
    rows = rows.withColumn("_key", F.coalesce(key, F.col("node"))).join(one, (F.col("_key") == F.col("_up")) & key.isNotNull(), "left")
    out = rows.join(totals, "node").join(ends_digests(path), "node", "left")
    return out.select(
        "node", "conv_id", "depth", F.coalesce("_of_top", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id AS c, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, d, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM raw),
e AS (SELECT c, c - c % 5 AS base, xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT e.c, i, d, b FROM e JOIN o ON o.c = e.base AND o.i <= h UNION ALL SELECT e.c, i + 9, d, b FROM e JOIN o ON o.c = e.c AND o.i > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS depth, d, b FROM r),
chain AS (SELECT c, CAST(0 AS BIGINT) AS depth, 'root' AS node, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS b FROM e
  UNION ALL SELECT q.c, q.depth, sha256(chain.node || q.d), chain.node, q.b FROM chain JOIN q ON q.c = chain.c AND q.depth = chain.depth + 1),
n AS (SELECT node, any_value(up) AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(b) AS b FROM chain GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * b AS own FROM n LEFT JOIN k USING (node)),
s AS (SELECT a.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.own) AS saved FROM f JOIN chain a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY a.node),
l AS (SELECT c, max(depth) AS depth FROM chain GROUP BY c),
z AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM chain JOIN l USING (c, depth) GROUP BY node)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n p ON p.node = f.up LEFT JOIN z ON z.node = f.node
"""


@query("op13_prefix_trie", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node")
