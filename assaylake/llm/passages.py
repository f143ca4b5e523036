"""Removal of repeated passages: prefix doubling over positions, dealt out by Spark.

The rank of a position at offset h is a 64-bit name of the h bytes from there; the names at 2h come from the pair of names at the
position and h further on. Names double inside a block of documents up to 16 bytes. To carry every byte's position through Spark's shuffles at
every offset would move some thirty times the text, so from there on only anchors travel: of each window of the threshold's length, the position of
the smallest name. Two equal windows choose the same anchor, so nothing is lost. A first shuffle by name drops what is unique to one document;
a second brings together the anchors left, with the bytes around them, doubles their offset to the threshold in both directions and reranks: a window whose name has a smaller document
is removed there. Anchors of a name that more than MOST_CONTEXTS positions have (a passage of very many documents) double inside their block instead: the
block sends each window name once, with its smallest document, and gets the smallest of all blocks back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import binary_of, give_back, longs, small_batches, table
from assaylake.llm.registry import query
from assaylake.llm.terms import U, mixed

THRESHOLD = 50
GRAM = 16
SIDE = THRESHOLD - GRAM
CONTEXT = THRESHOLD + SIDE
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
STEP_BYTES = 1 << 19
MOST_CONTEXTS = 20_000
TOP = U(0xFFFFFFFFFFFFFFFF)
LETTER = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
CODEC = "zstd"


# ---- names and anchors --------------------------------------------------------------------------


def doubled(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = (left * U(0x9E3779B97F4A7C15)) ^ (right * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9))
    return x ^ (x >> U(32))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in the joined texts, of the smallest name of any window inside a text, and the names there."""
    n = len(data)
    if n < THRESHOLD:
        return np.zeros(0, np.int64), np.zeros(0, U)
    name, have = LETTER[data], 1
    while have < GRAM:
        name = doubled(name[:-have], name[have:])
        have *= 2
    name = (name ^ (name >> U(29))) * U(0xBF58476D1CE4E5B9)
    name = name | U(1)  # never 0, which marks windows across texts
    inner = at[1:-1]
    for j in range(1, GRAM):
        cross = inner - j
        name[cross[(cross >= 0) & (cross < len(name))]] = TOP
    low = _slide(name, SIDE + 1, np.minimum)
    for j in range(1, THRESHOLD):
        cross = inner - j
        low[cross[(cross >= 0) & (cross < len(low))]] = 0
    room = np.zeros(len(low) + 2 * SIDE, U)
    room[SIDE : SIDE + len(low)] = low
    found = np.flatnonzero((_slide(room, SIDE + 1, np.maximum) == name) & (name != TOP))
    return found, mixed(name[found])


class Block:
    """The documents of a block in the order of id and text: joined bytes, where each begins, and their rows."""

    def __init__(self, rows: pa.Table):
        data, at = binary_of(rows["text"])
        ids = rows["doc_id"].combine_chunks().to_numpy() if rows.num_rows else np.zeros(0, np.int64)
        raw = data.tobytes()
        self.order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], raw[at[i] : at[i + 1]])), np.int64)
        self.ids = ids[self.order]
        parts = [raw[at[i] : at[i + 1]] for i in self.order]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """As ``anchors``, a few documents at a time."""
        found, names, first = [], [], 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + STEP_BYTES, side="right")) - 1)
            begin = self.at[first]
            q, name = anchors(self.data[begin : self.at[last]], self.at[first : last + 1] - begin)
            found.append(q + begin)
            names.append(name)
            first = last
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, U)
        return np.concatenate(found), np.concatenate(names)


def _six(names: np.ndarray) -> bytes:
    """The low six bytes of each name."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U)


LOW48 = U((1 << 48) - 1)


def _split(bucket: np.ndarray, buckets: int):
    """(bucket, indexes) of every bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U(48)) * U(buckets) >> U(16)).astype(np.int64) if buckets <= 1 << 16 else (names % U(buckets)).astype(np.int64)


def name_rows(rows: pa.Table, buckets: int) -> pa.Table:
    """bucket, names, more, counts: the distinct names of a block's anchors, which of them it has twice or more, and of these how often.

    The lowest bit of a count says that two documents have the name; counts end at 32,767, above any limit.
    """
    block = Block(rows)
    found, names = block.anchors()
    doc = block.ids[np.searchsorted(block.at, found, side="right") - 1]
    order = np.lexsort((doc, names))
    names, doc = names[order], doc[order]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(names)) - 1
    several = doc[first] != doc[last] if len(first) else np.zeros(0, bool)
    names, times = names[first], last - first + 1
    out = []
    for k, i in _split(_bucket_of(names, buckets), buckets):
        more = times[i] > 1
        j = i[more]
        out.append((k, _six(names[i]), np.packbits(more).tobytes(), (np.minimum(times[j], 32767) * 2 + several[j]).astype("<u2").tobytes()))
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "names", "more", "counts"])


def shared_rows(rows: pa.Table, most: int = MOST_CONTEXTS) -> pa.Table:
    """b, names, hot: of a bucket, the names of each block that another block, or two documents of it, have too; which of them more than ``most`` positions have."""
    per = [_wide(x) for x in rows["names"].to_pylist()]
    sizes = np.array([len(p) for p in per])
    names = np.concatenate(per)
    more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(rows["more"].to_pylist(), sizes)])
    counts = np.full(len(names), 2, np.int64)
    counts[more] = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u2")
    several, times = counts % 2 == 1, counts // 2
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    counts = np.bincount(group) + np.bincount(group, several[order])
    keep, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
    keep[order] = counts[group] > 1
    hot[order] = (np.bincount(group, times[order]) > most)[group]
    ends = np.cumsum(sizes)
    b, out, hots = [], [], []
    for block, end, size in zip(rows["b"].to_pylist(), ends, sizes):
        here = slice(end - size, end)
        some = names[here][keep[here]]
        if len(some):
            b.append(block)
            out.append(_six(some))
            hots.append(np.packbits(hot[here][keep[here]]).tobytes())
    return pa.Table.from_arrays([pa.array(b, pa.int32()), pa.array(out, pa.binary()), pa.array(hots, pa.binary())], ["b", "names", "hot"])


# ---- contexts: reranking at the threshold -------------------------------------------------------


FIELDS = (("doc", "<i8"), ("index", "<u4"), ("place", "<u4"), ("left", "u1"), ("right", "u1"))


def packed(context: np.ndarray, **columns: np.ndarray) -> bytes:
    """Contexts and their columns as one compressed value."""
    raw = np.int64(len(context)).tobytes() + b"".join(np.ascontiguousarray(columns[k], t).tobytes() for k, t in FIELDS) + context.tobytes()
    return np.int64(len(raw)).tobytes() + pa.Codec(CODEC, 1).compress(raw, asbytes=True)


def unpacked(value: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    raw = pa.Codec(CODEC).decompress(value[8:], int(np.frombuffer(value[:8], np.int64)[0]), asbytes=True)
    m, at, columns = int(np.frombuffer(raw[:8], np.int64)[0]), 8, {}
    for k, t in FIELDS:
        size = m * np.dtype(t).itemsize
        columns[k] = np.frombuffer(raw, t, m, at)
        at += size
    return np.frombuffer(raw, np.uint8, m * CONTEXT, at).reshape(m, CONTEXT), columns


def row_names(context: np.ndarray) -> np.ndarray:
    """A name for each row of bytes."""
    words = -(-context.shape[1] // 8)
    wide = np.zeros((len(context), words * 8), np.uint8)
    wide[:, : context.shape[1]] = context
    wide = wide.view("<u8")
    name = np.full(len(context), 0x1234567, U)
    for j in range(words):
        name = mixed(name * U(3) + wide[:, j])
    return name


def _pack_spans(index: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([index, start, end]).astype("<u4").tobytes()


def repeated_in(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a smaller document of the same name; a number for each name."""
    order = np.lexsort((doc, name))
    ranked = name[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    later = np.zeros(len(name), bool)
    later[order] = doc[order] > doc[order][np.flatnonzero(new)][group]
    number = np.empty(len(name), np.int64)
    number[order] = group
    return later, number


def contexts_at(block: Block, found: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of anchors of a block: their contexts, document's index, place, and the bytes of the document left and right of them, at most SIDE."""
    index = np.searchsorted(block.at, found, side="right") - 1
    place = found - block.at[index]
    left = np.minimum(SIDE, place)
    right = np.minimum(SIDE, block.at[index + 1] - found - GRAM)
    room = np.concatenate([np.zeros(SIDE, np.uint8), block.data, np.zeros(SIDE, np.uint8)])
    context = np.empty((len(found), CONTEXT), np.uint8)
    column = np.arange(CONTEXT)
    for a in range(0, len(found), 1 << 14):
        s = slice(a, a + (1 << 14))
        part = room[found[s, None] + column[None]]
        part[(column[None] < (SIDE - left[s])[:, None]) | (column[None] >= (SIDE + GRAM + right[s])[:, None])] = 0
        context[s] = part
    return context, index, place, left, right


def smallest(name: np.ndarray, doc: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, their smallest documents, and whether two documents have them (or an entry says so)."""
    order = np.lexsort((doc, name))
    name, doc, several = name[order], doc[order], several[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(name)) - 1 if len(name) else first
    both = (doc[first] != doc[last]) | (np.add.reduceat(several.astype(np.int64), first) > 0 if len(name) else np.zeros(0, bool))
    return name[first], doc[first], both


def window_rows(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """bucket, kind 2, payload: each window name of these contexts once, with its smallest document and whether it has two."""
    parts = []
    for a in range(0, len(context), 1 << 14):
        s = slice(a, a + (1 << 14))
        pairs = [(w, doc[s][inside]) for _, inside, w in window_names(context[s], left[s], right[s], row_names(context[s, SIDE : SIDE + GRAM]))]
        w, d = (np.concatenate(c) for c in zip(*pairs))
        parts.append(smallest(w, d, np.zeros(len(w), bool)))
    name, low, several = smallest(*(np.concatenate(c) for c in zip(*parts)))
    out = []
    for k, i in _split((name % U(buckets)).astype(np.int64), buckets):
        i = i[np.argsort(low[i], kind="stable")]  # neighbours of one document compress
        raw = name[i].astype("<u8").tobytes() + low[i].astype("<i8").tobytes() + several[i].astype("u1").tobytes()
        out.append((k, 2, np.int64(len(raw)).tobytes() + pa.Codec(CODEC, 1).compress(raw, asbytes=True)))
    return out


def lows_of(parts: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """b, payload: for each block the names of its windows in which some document of it has a smaller one, and the smallest of all."""
    names, lows, several, blocks = [], [], [], []
    for b, payload in parts:
        raw = pa.Codec(CODEC).decompress(payload[8:], int(np.frombuffer(payload[:8], np.int64)[0]), asbytes=True)
        n = len(raw) // 17
        names.append(np.frombuffer(raw, "<u8", n).astype(U))
        lows.append(np.frombuffer(raw, "<i8", n, 8 * n).astype(np.int64))
        several.append(np.frombuffer(raw, "u1", n, 16 * n) > 0)
        blocks.append(np.full(n, b, np.int64))
    name, low, some, block = (np.concatenate(c) for c in (names, lows, several, blocks))
    all_names, all_lows, _ = smallest(name, low, some)
    best = all_lows[np.searchsorted(all_names, name)]
    told = np.flatnonzero(some | (best < low))
    told = told[np.argsort(block[told], kind="stable")]
    out = []
    for b in np.unique(block[told]):
        i = told[slice(*np.searchsorted(block[told], [b, b + 1]))]
        out.append((int(b), name[i].astype("<u8").tobytes() + best[i].astype("<i8").tobytes()))
    return out


def context_rows(rows: pa.Table, shared: pa.Table, buckets: int, names_buckets: int) -> pa.Table:
    """bucket, kind, payload: contexts of a block's shared anchors by bucket (kind 0), and spans already settled inside the block (1).

    A context that a smaller document of the block has is a repeat as a whole; it needs no more company. Anchors of hot names
    send their windows (2) in place of contexts, and the names themselves (3), which come back to the block.
    """
    block = Block(rows)
    wanted = [_wide(x) | (U(k) << U(48)) for k, x in zip(shared["bucket"].to_pylist(), shared["names"].to_pylist())]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(w)).astype(bool) for x, w in zip(shared["hot"].to_pylist(), wanted)]
    found, names = block.anchors()
    out = []
    if wanted and len(found):
        known, at = np.unique(np.concatenate(wanted), return_index=True)
        hot = np.concatenate(flags)[at]
        key = (names & LOW48) | (_bucket_of(names, names_buckets).astype(U) << U(48))
        nearest = np.minimum(np.searchsorted(known, key), len(known) - 1)
        some = known[nearest] == key
        found, names, hot = found[some], names[some], hot[nearest[some]]
        context, index, place, left, right = contexts_at(block, found)
        doc = block.ids[index]
        whole = mixed(row_names(context) + (left * 64 + right).astype(U))
        later, _ = repeated_in(whole, doc)
        if later.any():
            full = later & (left + right >= SIDE)
            out.append((int(rows["b"][0].as_py()) % buckets, 1, _pack_spans(index[full], (place - left)[full], (place + GRAM + right)[full])))
        if hot.any():
            i = np.flatnonzero(hot & ~later)
            out += window_rows(context[i], left[i], right[i], doc[i], buckets)
            out.append((int(rows["b"][0].as_py()) % buckets, 3, np.unique(names[hot]).astype("<u8").tobytes()))
        go = np.flatnonzero(~later & ~hot)
        for k, i in _split((names[go] % U(buckets)).astype(np.int64), buckets):
            j = go[i]
            out.append((k, 0, packed(context[j], doc=doc[j], index=index[j], place=place[j], left=left[j], right=right[j])))
    columns = list(zip(*out)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "payload"])


def window_names(context: np.ndarray, left: np.ndarray, right: np.ndarray, name: np.ndarray):
    """For o from 0 to SIDE: o, the entries that hold the window that begins o bytes before the anchor, and its names."""
    m = len(context)
    lefts, rights = np.empty((SIDE + 1, m), U), np.empty((SIDE + 1, m), U)
    lefts[0], rights[0] = name, name * U(3)
    for o in range(1, SIDE + 1):
        lefts[o] = doubled(lefts[o - 1], LETTER[context[:, SIDE - o]])
        rights[o] = doubled(rights[o - 1], LETTER[context[:, SIDE + GRAM + o - 1]])
    for o in range(SIDE + 1):
        inside = np.flatnonzero((left >= o) & (right >= SIDE - o))
        yield o, inside, mixed(doubled(lefts[o][inside], rights[SIDE - o][inside]))


def window_repeats(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """entries × (SIDE + 1): whether the window that begins o bytes before the anchor has a smaller document."""
    out = np.zeros((len(context), SIDE + 1), bool)
    for o, inside, window in window_names(context, left, right, name):
        if len(inside):
            out[inside, o] = repeated_in(window, doc[inside])[0]
    return out


def span_rows(rows: pa.Table) -> pa.Table:
    """b, spans, size, kind: repeated spans (document's number in its block, start, end) of a bucket's contexts (kind 0); of hot names the smallest documents of windows (2) and the names (3)."""
    per: dict[int, list[bytes]] = {}
    parts, blocks, windows, told = [], [], [], []
    for b, kind, payload in zip(rows["b"].to_pylist(), rows["kind"].to_pylist(), rows["payload"].to_pylist()):
        if kind == 1:
            per.setdefault(b, []).append(payload)
        elif kind == 2:
            windows.append((b, payload))
        elif kind == 3:
            told.append((b, 3, payload))
        else:
            parts.append(unpacked(payload))
            blocks.append(np.full(len(parts[-1][0]), b, np.int64))
    if parts:
        context = np.concatenate([p[0] for p in parts])
        doc, index, place, left, right = (np.concatenate([p[1][k] for p in parts]).astype(np.int64) for k, _ in FIELDS)
        b = np.concatenate(blocks)
        parts.clear()
        later, _ = repeated_in(mixed(row_names(context) + (left * 64 + right).astype(U)), doc)
        full = later & (left + right >= SIDE)
        pieces = [(b[full], index[full], (place - left)[full], (place + GRAM + right)[full])]
        rest = np.flatnonzero(~full)
        name = row_names(context[rest, SIDE : SIDE + GRAM])
        _, number = repeated_in(name, doc[rest])
        low = np.full(number.max() + 1 if len(number) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, number, doc[rest])
        high = np.full(len(low), np.iinfo(np.int64).min)
        np.maximum.at(high, number, doc[rest])
        open_ = np.flatnonzero((low < high)[number]) if len(number) else np.zeros(0, np.int64)
        rest, name = rest[open_], name[open_]
        order = np.argsort(name, kind="stable")
        rest, name = rest[order], name[order]
        edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
        first = 0
        while first < len(rest):  # a hundred thousand contexts at a time, never parting those of one name
            k = int(np.searchsorted(edges, first + 100_000))
            last = int(edges[k]) if k < len(edges) else len(rest)
            s = rest[first:last]
            flags = window_repeats(context[s], left[s], right[s], doc[s], name[first:last])
            wide = np.zeros((len(s), SIDE + 3), bool)
            wide[:, 1:-1] = flags
            i, o = np.nonzero(wide[:, 1:] & ~wide[:, :-1])
            _, e = np.nonzero(~wide[:, 1:] & wide[:, :-1])
            pieces.append((b[s[i]], index[s[i]], place[s[i]] - (e - 1), place[s[i]] - o + THRESHOLD))
            first = last
        where, index, start, end = (np.concatenate(c) for c in zip(*pieces))
        order = np.argsort(where, kind="stable")
        where, index, start, end = where[order], index[order], start[order], end[order]
        for x in np.unique(where):
            s = slice(*np.searchsorted(where, [x, x + 1]))
            per.setdefault(int(x), []).append(_pack_spans(index[s], start[s], end[s]))
    if windows:
        told += [(b, 2, x) for b, x in lows_of(windows)]
    told += [(b, 0, x) for b, v in per.items() for x in v]
    b, kinds, values = zip(*told) if told else ((), (), ())
    spans = [pa.Codec(CODEC, 1).compress(x, asbytes=True) for x in values]
    return pa.Table.from_arrays([pa.array(b, pa.int32()), pa.array(spans, pa.binary()), longs([len(x) for x in values]), pa.array(kinds, pa.int32())], ["b", "spans", "size", "kind"])


def mark_hot(block: Block, change: np.ndarray, hot: np.ndarray, name: np.ndarray, low: np.ndarray) -> None:
    """Adds to ``change`` the windows around anchors of ``hot`` names whose smallest document, by ``name`` and ``low``, is smaller than their own."""
    found, names = block.anchors()
    found = found[np.isin(names, hot)]
    order = np.argsort(name, kind="stable")
    name, low = name[order], low[order]
    for a in range(0, len(found), 1 << 14):
        at = found[a : a + (1 << 14)]
        context, index, _, left, right = contexts_at(block, at)
        doc = block.ids[index]
        for o, inside, window in window_names(context, left, right, row_names(context[:, SIDE : SIDE + GRAM])):
            near = np.minimum(np.searchsorted(name, window), len(name) - 1)
            begin = at[inside[(name[near] == window) & (low[near] < doc[inside])]] - o
            np.add.at(change, begin, 1)
            np.subtract.at(change, begin + THRESHOLD, 1)


def _nullable(column: pa.Array) -> pa.Array:
    """A struct column whose fields may be null, as the result's schema has them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_struct(column.type):
        return column
    return column.cast(pa.struct([pa.field(f.name, f.type, True) for f in column.type]))


def remove_rows(rows: pa.Table, spans: pa.Table) -> pa.Table:
    """The block's rows with n_bytes, n_removed, n_spans and the bytes kept, in place of text and b."""
    block = Block(rows)
    n = len(block.data)
    change = np.zeros(n + 1, np.int32)
    values: dict[int, list[bytes]] = {0: [], 2: [], 3: []}
    for v, size, kind in zip(spans["spans"].to_pylist(), spans["size"].to_pylist(), spans["kind"].to_pylist()):
        values[kind].append(pa.Codec(CODEC).decompress(v, size, asbytes=True))
    if values[0]:
        index, start, end = np.concatenate([np.frombuffer(v, "<u4").reshape(3, -1) for v in values[0]], axis=1).astype(np.int64)
        np.add.at(change, block.at[index] + start, 1)
        np.subtract.at(change, block.at[index] + end, 1)
    if values[2] and values[3]:
        name, low = np.concatenate([np.frombuffer(v, "<u8").reshape(2, -1) for v in values[2]], axis=1)
        mark_hot(block, change, np.frombuffer(values[3][0], "<u8").astype(U), name.astype(U), low.astype(np.int64))
    gone = np.cumsum(change[:n]) > 0
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    begins = block.at[:-1]
    starts = begins[begins < n]
    edge[starts] = gone[starts]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.at])
    removed, runs = total(gone), total(edge)
    kept = [block.data[a:z][~gone[a:z]].tobytes() for a, z in zip(block.at, block.at[1:])]
    names = [x for x in rows.column_names if x not in ("b", "text")]
    out = [_nullable(rows[x].combine_chunks()).take(pa.array(block.order)) for x in names]
    return pa.Table.from_arrays(out + [longs(np.diff(block.at)), longs(removed), longs(runs), pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])


# ---- the plan -----------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, other (a struct of the other columns), n_bytes, n_removed, n_spans, kept: per input row, the bytes that stay.

    A byte goes when a string of THRESHOLD bytes that covers it also begins in a document of smaller id; strings are
    judged on the input. A null text is empty. Rows without an id stay whole and make nothing repeat; rows of one id don't make each other repeat. Documents are
    dealt into blocks by a hash of the id; three passes read the same shuffled documents.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    other = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), other.alias("other"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks, buckets = max(1, total // block_bytes), max(1, total // bucket_bytes)
    placed = rows.where("doc_id is not null").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    kind = placed.schema["other"].dataType.simpleString()
    by_block = placed.groupBy("b")

    def first(key, t):
        out = name_rows(t, buckets)
        give_back()
        return out.append_column("b", pa.array([key[0].as_py()] * out.num_rows, pa.int32())).select(["b", "bucket", "names", "more", "counts"])

    def second(key, t):
        out = shared_rows(t, most_contexts)
        give_back()
        return out.append_column("bucket", pa.array([key[0].as_py()] * out.num_rows, pa.int32())).select(["b", "bucket", "names", "hot"])

    def third(key, t, s):
        out = context_rows(t, s, buckets, buckets) if t.num_rows else context_rows(t.slice(0, 0), s.slice(0, 0), 1, 1)
        give_back()
        return out.append_column("b", pa.array([key[0].as_py()] * out.num_rows, pa.int32())).select(["b", "bucket", "kind", "payload"])

    def fourth(t):
        out = span_rows(t)
        give_back()
        return out

    def fifth(t, s):
        out = remove_rows(t, s)
        give_back()
        return out

    names = by_block.applyInArrow(first, "b int, bucket int, names binary, more binary, counts binary")
    shared = names.groupBy("bucket").applyInArrow(second, "b int, bucket int, names binary, hot binary")
    contexts = by_block.cogroup(shared.groupBy("b")).applyInArrow(third, "b int, bucket int, kind int, payload binary")
    spans = contexts.groupBy("bucket").applyInArrow(fourth, "b int, spans binary, size long, kind int")
    result = f"doc_id long, other {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    whole = by_block.cogroup(spans.groupBy("b")).applyInArrow(fifth, result)
    zero = F.lit(0).cast("long")
    loose = rows.where("doc_id is null").select("doc_id", "other", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(loose)


def texts(removed: DataFrame) -> DataFrame:
    """doc_id, other and text: what is left, without the parts of characters that a cut through their bytes leaves."""

    def run(batches):
        for batch in batches:
            text = pa.array([(x or b"").decode("utf-8", "ignore") for x in batch["kept"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _nullable(batch["other"]), text], ["doc_id", "other", "text"])

    kind = removed.schema["other"].dataType.simpleString()
    return removed.select("doc_id", "other", "kept").mapInArrow(run, f"doc_id long, other {kind}, text string")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS t(i)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN f USING (s) WHERE f.low < w.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_z FROM runs),
left_ AS (SELECT c.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * from_z + 1, 2 * (a - from_z)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""


@query("op8_prefix_doubling", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
