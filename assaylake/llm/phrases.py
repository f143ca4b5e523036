"""Phrase collocation mining: double-array tries of Apriori-safe candidates.

Words are counted first. A pair can reach the least count only where both words do, a triple only where
both of its pairs do; bitmaps of the words and pairs that do (a fixed most number of bits, strangers may
pass, none is lost) thin out the positions of which pairs, then triples, are summed. What reaches the least count is a
candidate. Candidates are dealt by hash to shards of about ``MOST_PHRASES``, each of which becomes a double-array trie over the
digits of its words' numbers. The texts are read once for all tries: what occurs of the phrases that two bitmaps let
through is summed in the task and sent to its shard, where numpy takes the states of many occurrences one digit further at a
time and bincounts the accepting states. So work and shuffle grow with the texts, not with the texts times the tries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut, spread
from assaylake.llm.common import binary_of, longs, slices, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.terms import LOWER, U, hashes, mixed, runs

LEAST = 10
TOP = 2000
INSIDE_PERCENT = 50
#: Bytes of text held at once, and sums held in a task before they are passed on.
BLOCK_BYTES = 4 << 20
MOST_SUMS = 1 << 20
#: Phrases of one trie, about, and occurrences taken through it together; bits of a bitmap for each entry, and at most.
MOST_PHRASES = 1 << 14
MOST_ROWS = 1 << 16
BITS_EACH, MOST_BITS = 16, 28
NO_LANG = "und"

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 9]] = False


class _Words:
    """Words of a block of rows: hash with the language in it, row, place in the bytes, and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = binary_of(batch["text"])
        self.data = LOWER[data]
        self.start, self.end, self.row = runs(_INSIDE[self.data], at)
        names, ends = binary_of(batch["lang"])
        salt = mixed(hashes(names, ends[:-1], ends[1:]) + U(1))
        self.hash = mixed(hashes(self.data, self.start, self.end) ^ salt[self.row])
        piece = np.cumsum(_ENDS[self.data])[self.start] if len(self.start) else self.start
        self.linked = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit number of a phrase's word hashes, in their order."""
    code = columns[0]
    for column in columns[1:]:
        code = mixed(code * U(0x9E3779B97F4A7C15) + column)
    return code


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            yield _Words(part)


def _texts(docs: DataFrame) -> DataFrame:
    """lang and text; a null language is ``und``, a null text empty."""
    return small_batches(spread(docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))))


def words(docs: DataFrame) -> DataFrame:
    """lang, hash, word, f: occurrences of every word of every language."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                w = _Words(part)
                _, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                texts = [w.data[a:b].tobytes() for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
                lang = part["lang"].take(longs(w.row[first]))
                yield pa.RecordBatch.from_arrays([lang, longs(w.hash[first].view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), longs(n)], ["lang", "hash", "word", "f"])

    return _texts(docs).mapInArrow(count, "lang string, hash long, word string, f long").groupBy("lang", "hash", "word").agg(F.sum("f").alias("f"))


def bitmap(rows: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Bits, as 64-bit words, of the codes of ``rows``: 16 bits for each of the ``n`` rows, but never more than 2^28 (32 MB)."""
    bits = int(min(MOST_BITS, max(16, int(n * BITS_EACH).bit_length())))

    def places(batches):
        for batch in batches:
            at = (_codes(*[batch[c].to_numpy(zero_copy_only=False).view(U) for c in columns]) >> U(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([longs(at >> 6), longs((U(1) << (at & 63).astype(U)).view(np.int64))], ["at", "bit"])

    told = rows.select(*columns).mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[told["at"].to_numpy()] = told["bit"].to_numpy().view(U)
    return out


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes >> U(64 - (len(bits).bit_length() - 1 + 6))
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) > 0


def _task_sums(batches: Iterator[pa.RecordBatch], picks: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of words, codes, hashes of the words (a row for each place) and occurrences of the phrases of a task, each summed as far as ``MOST_SUMS`` allow.

    ``picks``: for a number of words, the first positions of its phrases in a block of words.
    """
    held: dict[int, list[tuple]] = {n: [] for n in picks}

    def merged(n):
        code, rows, f = (np.concatenate(x, axis=-1) for x in zip(*held[n]))
        code, first, back = np.unique(code, return_index=True, return_inverse=True)
        return code, rows[:, first], np.bincount(back, f).astype(np.int64)

    for w in _blocks(batches):
        for n, pick in picks.items():
            at = pick(w)
            rows = np.stack([w.hash[at + i] for i in range(n)])
            code, first, f = np.unique(_codes(*rows), return_index=True, return_counts=True)
            held[n].append((code, rows[:, first], f))
            if sum(len(c) for c, _, _ in held[n]) > MOST_SUMS:
                held[n] = [merged(n)]
                if len(held[n][0][0]) > MOST_SUMS // 2:
                    yield n, *held[n].pop()
    for n, some in held.items():
        if some:
            yield n, *merged(n)


def _summed(docs: DataFrame, n: int, safe) -> DataFrame:
    """h1 … hn, f: occurrences of the runs of ``n`` linked words whose first positions ``safe`` gives for a block of words."""
    names = [f"h{i + 1}" for i in range(n)]

    def count(batches):
        for _, _, rows, f in _task_sums(batches, {n: safe}):
            yield pa.RecordBatch.from_arrays([*[longs(r.view(np.int64)) for r in rows], longs(f)], [*names, "f"])

    return _texts(docs).mapInArrow(count, ", ".join(f"{h} long" for h in names) + ", f long").groupBy(*names).agg(F.sum("f").alias("f"))


def _pairs_in(w: _Words, bits: np.ndarray) -> np.ndarray:
    """Of every word but the last, whether it and the next are linked and a pair of the bitmap."""
    linked = np.zeros(max(len(w.hash) - 1, 0), bool)
    first = np.flatnonzero(w.linked)
    linked[first] = _has(bits, _codes(w.hash[first], w.hash[first + 1]))
    return linked


def candidates(docs: DataFrame, frequent: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2, h3 (null in pairs): every run of two or three words that occurs at least ``least`` times.

    ``frequent`` are the words that do. The sums that decide are taken by 64-bit word hashes; counts come from the tries.
    """
    sc = docs.sparkSession.sparkContext
    some = sc.broadcast(bitmap(frequent, ["hash"], frequent.count()))

    def both(w):
        known = _has(some.value, w.hash)
        return np.flatnonzero(w.linked & known[1:] & known[:-1])

    pairs = cut(_summed(docs, 2, both).where(F.col("f") >= least).drop("f"))
    bits = sc.broadcast(bitmap(pairs, ["h1", "h2"], pairs.count()))

    def safe(w):
        linked = _pairs_in(w, bits.value)
        return np.flatnonzero(linked[1:] & linked[:-1])

    triples = _summed(docs, 3, safe).where(F.col("f") >= least).drop("f")
    return pairs.withColumn("h3", F.lit(None).cast("long")).unionByName(triples)


class Trie:
    """A double array over phrases of word numbers, each number written in ``digits`` base-256 digits.

    The child of state s by digit d is the cell ``base[s] + d``, if its ``check`` is s. State 0 is the root.
    """

    def __init__(self, phrases: np.ndarray, lengths: np.ndarray, n_words: int):
        """``phrases``: a row of word numbers for each, the first ``lengths`` of them used; ``states`` follow its rows."""
        self.digits = max(1, (max(n_words - 1, 1).bit_length() + 7) // 8)
        shifts = np.arange(self.digits - 1, -1, -1, dtype=phrases.dtype) * 8
        rows = ((phrases[:, :, None] >> shifts) & 255).astype(np.uint8).reshape(len(phrases), -1)
        depth = lengths * self.digits
        node = np.zeros(len(rows), np.int32)
        parents, labels, n = [], [], 1
        for level in range(rows.shape[1]):
            at = np.flatnonzero(depth > level)
            edges, back = np.unique(node[at].astype(np.int64) << 8 | rows[at, level], return_inverse=True)
            node[at] = n + back
            parents.append((edges >> 8).astype(np.int32))
            labels.append((edges & 255).astype(np.uint8))
            n += len(edges)
        del rows
        self.states = self._place(np.concatenate([np.zeros(1, np.int32), *parents]), np.concatenate([np.zeros(1, np.uint8), *labels]), n)[node]

    def _place(self, parent: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
        """Cells of all nodes. Nodes with many children get windows of their own, those with few fall into the free cells at random, many at a time."""
        kids = np.bincount(parent[1:], minlength=n).astype(np.int32)
        # Nodes of a level are numbered in the order of their parents, so children of a node stand together.
        begin = np.concatenate([np.ones(1, np.int32), np.cumsum(kids, dtype=np.int32)[:-1] + 1])
        wide = np.flatnonzero(kids > 16)
        free = np.ones(1 + max((len(wide) + 1) * 256, 2 * n + 512), bool)
        free[0] = False
        base = np.zeros(n, np.int32)
        cell = np.zeros(n, np.int32)

        def settle(nodes, bases):
            base[nodes] = bases
            kid = _ranges(begin[nodes], kids[nodes])
            cell[kid] = base[parent[kid]] + label[kid]
            free[cell[kid]] = False

        settle(wide, 1 + np.arange(len(wide)) * 256)
        draw = np.random.default_rng(n)
        for k in range(16, 0, -1):
            left, tries = np.flatnonzero(kids == k), 0
            while len(left):
                if tries > 60:  # the holes are too small for so many children: room is added
                    free = np.concatenate([free, np.ones(len(left) * 32 + 256, bool)])
                    tries = 0
                tries += 1
                rest = []
                for some in np.array_split(left, len(left) // (1 << 18) + 1):
                    low = draw.integers(1, len(free) - 256, len(some), dtype=np.int32)
                    cells = low[:, None] + label[begin[some][:, None] + np.arange(k, dtype=np.int32)]
                    fits = np.flatnonzero(free[cells].all(axis=1))
                    first = np.unique(cells[fits].ravel(), return_index=True)[1]
                    own = np.bincount(first // k, minlength=len(fits)) == k
                    settle(some[fits[own]], low[fits[own]])
                    others = np.ones(len(some), bool)
                    others[fits[own]] = False
                    rest.append(some[others])
                left = np.concatenate(rest)
        self.base = np.zeros(len(free), np.int32)
        self.check = np.full(len(free), -1, np.int32)
        self.base[cell] = base
        self.check[cell[1:]] = cell[parent[1:]]
        return cell

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after one more word each; -1 where the trie has none."""
        alive = np.flatnonzero((states >= 0) & (words >= 0))
        at, word = states[alive], words[alive]
        for i in range(self.digits - 1, -1, -1):
            to = self.base[at].astype(np.int64) + ((word >> (8 * i)) & 255)
            good = self.check[to] == at
            alive, at, word = alive[good], to[good], word[good]
        out = np.full(len(states), -1, np.int64)
        out[alive] = at
        return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, … for n numbers each, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((start - (ends - n)).astype(np.int32), n)


#: A row of a shard by the last two bits of its key: a candidate, or what occurs of a phrase. Candidates come first.
PAIR, TRIPLE, PAIR_SEEN, TRIPLE_SEEN = range(4)
ROW = "key long, h1 long, h2 long, h3 long, f long"


def _rows(code: np.ndarray, shards: int, kind, rows: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    key = (code % U(shards)).astype(np.int64) * 4 + kind
    h = [rows[i] if i < len(rows) else np.zeros(len(code), U) for i in range(3)]
    return pa.RecordBatch.from_arrays([longs(key), *[longs(x.view(np.int64)) for x in h], longs(f)], ["key", "h1", "h2", "h3", "f"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one key, about ``MOST_ROWS`` at most: key, hashes, f."""

    def pieces(held):
        rows = pa.Table.from_batches(held)
        key, *h, f = (rows[c].to_numpy() for c in ("key", "h1", "h2", "h3", "f"))
        h = np.stack(h).view(U)
        ends = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(ends, ends[1:]):
            if a < b:
                yield int(key[a]), h[:, a:b], f[a:b]

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= MOST_ROWS:
            yield from pieces(held)
            held, n = [], 0
    if held:
        yield from pieces(held)


class _Shard:
    """The candidates of a shard in a trie, and how often each occurs."""

    def __init__(self, named: list[tuple[int, np.ndarray]]):
        self.h = np.concatenate([h for _, h in named], axis=1)
        self.third = np.repeat([kind == TRIPLE for kind, _ in named], [h.shape[1] for _, h in named])
        self.known = np.unique(np.concatenate([self.h[:2].ravel(), self.h[2, self.third]]))
        numbers = np.searchsorted(self.known, self.h.T) % len(self.known)
        self.trie = Trie(numbers.astype(np.int32), 2 + self.third, len(self.known))
        self.sums = np.zeros(len(self.trie.base), np.int64)

    def add(self, h: np.ndarray, f: np.ndarray) -> None:
        state = np.zeros(h.shape[1], np.int64)
        for word in h:
            place = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
            state = self.trie.step(state, np.where(self.known[place] == word, place, -1))
        on = state >= 0
        self.sums += np.bincount(state[on], f[on], minlength=len(self.sums)).astype(np.int64)

    def counted(self) -> pa.RecordBatch:
        h1, h2, h3 = (x.view(np.int64) for x in self.h)
        return pa.RecordBatch.from_arrays([longs(h1), longs(h2), pa.array(h3, mask=~self.third), longs(self.sums[self.trie.states])], ["h1", "h2", "h3", "a"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of the shards of a partition, whose rows are in the order of their keys, with their occurrences."""
    at, named, shard = None, [], None
    for key, h, f in _pieces(batches):
        if key >> 2 != at:
            if shard:
                yield shard.counted()
            at, named, shard = key >> 2, [], None
        kind = key & 3
        if kind in (PAIR, TRIPLE):
            named.append((kind, h))
            continue
        if named and not shard:
            shard = _Shard(named)
        if shard:  # otherwise only strangers of the bitmaps came to the shard
            shard.add(h[: 2 if kind == PAIR_SEEN else 3], f)
    if shard:
        yield shard.counted()


def phrase_counts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """h1, h2, h3, a: candidates and their exact number of occurrences, counted by tries of about ``MOST_PHRASES``, one pass over the texts for all.

    ``found`` is read several times and should be written. A shard's rows pass through one task, its candidates first; only they are held.
    """
    sc = docs.sparkSession.sparkContext
    pairs, triples = found.where("h3 is null"), found.where("h3 is not null")
    n_pairs, n_triples = pairs.count(), triples.count()
    shards = 1 + (n_pairs + n_triples) * 5 // (MOST_PHRASES * 4)
    two, three = sc.broadcast(bitmap(pairs, ["h1", "h2"], n_pairs)), sc.broadcast(bitmap(triples, ["h1", "h2", "h3"], n_triples))

    def deal(batches):
        for batch in batches:
            third = batch["h3"].is_valid().to_numpy(zero_copy_only=False)
            h = np.stack([batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "h3")]).view(U)
            code = np.where(third, _codes(*h), _codes(*h[:2]))
            yield _rows(code, shards, np.where(third, TRIPLE, PAIR), h, np.zeros(len(code), np.int64))

    def second(w):
        return np.flatnonzero(_pairs_in(w, two.value))

    def third(w):
        linked = _pairs_in(w, two.value)
        at = np.flatnonzero(linked[1:] & linked[:-1])
        return at[_has(three.value, _codes(w.hash[at], w.hash[at + 1], w.hash[at + 2]))]

    def seen(batches):
        for n, code, rows, f in _task_sums(batches, {2: second, 3: third}):
            yield _rows(code, shards, PAIR_SEEN if n == 2 else TRIPLE_SEEN, rows, f)

    rows = found.mapInArrow(deal, ROW).unionByName(_texts(docs).mapInArrow(seen, ROW))
    dealt = rows.repartition(F.shiftright("key", 2)).sortWithinPartitions("key")
    return dealt.mapInArrow(_counted, "h1 long, h2 long, h3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a² / (l r)) in decimals of 38 digits; it is at most a million."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two or three words that stays.

    Rows with a null language belong to ``und``; null texts have no words; repeated rows count again; an empty table gives
    no rows. Only ``lang`` and ``text`` are read. The word at which a phrase is cut is the one of least score, the earlier of equal ones.
    A pair is dropped where a triple that holds it has at least ``inside_percent`` of its occurrences.
    """
    counted = cut(words(docs))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = cut(counted.where(F.col("f") >= least).select("lang", "hash", "word", "f"))
    phrases = cut(phrase_counts(docs, cut(candidates(docs, frequent, least))).where(F.col("a") >= least))
    word = lambda i: frequent.select(F.col("hash").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    pairs = phrases.where("h3 is null").select("h1", "h2", "a")
    triples = phrases.where("h3 is not null")
    longest = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    kept = pairs.join(longest, ["h1", "h2"], "left").where((100 * F.coalesce("longer", F.lit(0))) < inside_percent * F.col("a")).drop("longer")
    two = kept.join(frequent.select("lang", F.col("hash").alias("h1"), F.col("word").alias("w1"), F.col("f").alias("l")), "h1").join(word(2).withColumnRenamed("f2", "r"), "h2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.join(frequent.select("lang", F.col("hash").alias("h1"), F.col("word").alias("w1"), F.col("f").alias("f1")), "h1").join(word(2).drop("f2"), "h2").join(word(3), "h3")
    three = three.join(pairs.withColumnRenamed("a", "f12"), ["h1", "h2"]).join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23")), ["h2", "h3"])
    early, late = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    three = three.withColumn("_e", early).withColumn("_l", late).withColumn("_late", F.col("_l") < F.col("_e"))
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(F.col("_late"), F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(F.col("_late"), F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("_e", "_l").alias("score"),
    )
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM p) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM u GROUP BY ALL),
b AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM t UNION ALL SELECT lang, y, z, f FROM t) GROUP BY ALL),
k AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, u.f AS l, v.f AS r, (CAST(1000000 AS HUGEINT) * b.f * b.f) // (CAST(u.f AS HUGEINT) * v.f) AS score
  FROM b JOIN u ON u.lang = b.lang AND u.x = b.x JOIN u v ON v.lang = b.lang AND v.x = b.y LEFT JOIN m ON m.lang = b.lang AND m.x = b.x AND m.y = b.y
  WHERE 100 * coalesce(m.f, 0) < 50 * b.f),
q AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, u.f AS f1, v.f AS f3, c.f AS f12, d.f AS f23,
  (CAST(1000000 AS HUGEINT) * t.f * t.f) // (CAST(u.f AS HUGEINT) * d.f) AS e, (CAST(1000000 AS HUGEINT) * t.f * t.f) // (CAST(c.f AS HUGEINT) * v.f) AS g
  FROM t JOIN u ON u.lang = t.lang AND u.x = t.x JOIN u v ON v.lang = t.lang AND v.x = t.z JOIN b c ON c.lang = t.lang AND c.x = t.x AND c.y = t.y JOIN b d ON d.lang = t.lang AND d.x = t.y AND d.y = t.z),
s AS (SELECT * FROM k UNION ALL SELECT lang, phrase, a, CASE WHEN g < e THEN f12 ELSE f1 END, CASE WHEN g < e THEN f3 ELSE f23 END, least(e, g) FROM q)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_tries", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best(collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
