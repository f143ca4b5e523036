import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from assaylake.llm import neardup, passages
from tests.llm.frames import PASSAGE, SCHEMA, Union, documents, shingles


def copies(seed=4):
    """Groups of near copies at many distances, with edits of single words."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(20, 200))]
        for _ in range(draw.choice([1, 2, 5, 30])):
            own = list(words)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows


def components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None and shingles(t)]
    tree = Union()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if 100 * len(x & y) >= percent * len(x | y):
                tree.join(a, b)
    return tree


@pytest.mark.parametrize("most", [2048, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, most):
    """Also with regions that hold sixteen classes, so that deeper levels and blocks do the work."""
    monkeypatch.setattr(neardup, "MOST_CLASSES", most)
    rows = copies()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tree = components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {i: tree.root(i) for i, _ in rows}
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(rows[r.doc_id][1])) for r in got)


def test_near_duplicates_of_hard_rows(spark):
    rows = documents()
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    tree = components([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else tree.root(r.doc_id))
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}


def brute(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept of every row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()


def passages_rows():
    draw = random.Random(9)
    piece = lambda n: "".join(draw.choice("ab cdé") for _ in range(n))
    shared = [piece(draw.randint(40, 150)) for _ in range(12)]
    rows = [(i, "".join(draw.choice([piece(draw.randint(0, 60)), draw.choice(shared), draw.choice(shared)[draw.randint(0, 20) :]]) for _ in range(draw.randint(0, 7)))) for i in range(120)]
    return rows + [(200, "x" * 300), (201, "x" * 120 + "y"), (202, "x" * 49), (203, "x" * 50), (204, PASSAGE[:50]), (205, PASSAGE[:50])]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 800, "bucket_bytes": 1500}])
def test_passages_equal_brute_force(spark, sizes):
    rows = passages_rows()
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute(rows))


def test_passages_with_hot_names_equal_brute_force(spark):
    rows = passages_rows() + [(300 + i, f"{i} {PASSAGE[:60]} {'z' * (i % 70)}") for i in range(60)] + [(300, PASSAGE), (None, PASSAGE)]
    for most in (0, 5, 40):
        got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=800, bucket_bytes=1500, most_contexts=most).collect()
        order = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=order) == sorted(brute(rows), key=order)


def test_a_hot_passage_costs_a_row_per_block():
    """A footer of 1,200 documents, each after a text of its own: no task gets its contexts."""
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("abcdefgh ") for _ in range(60)) + PASSAGE[:60]) for i in range(1200)]
    blocks = [pa.table({"doc_id": [i for i, _ in part], "text": [t for _, t in part], "b": pa.array([b] * len(part), pa.int32())}) for b, part in enumerate(rows[k::4] for k in range(4))]
    own = lambda t, b: t.append_column("b", pa.array([b] * t.num_rows, pa.int32()))
    shared = passages.shared_rows(pa.concat_tables([own(passages.name_rows(t, 1), b) for b, t in enumerate(blocks)]), 100)
    shared = shared.append_column("bucket", pa.array([0] * shared.num_rows, pa.int32()))
    sent = pa.concat_tables([own(passages.context_rows(t, shared.filter(pc.equal(shared["b"], b)), 1, 1), b) for b, t in enumerate(blocks)])
    cores = [passages.unpacked(p)[0][:, passages.SIDE : passages.SIDE + passages.GRAM] for k, p in zip(sent["kind"].to_pylist(), sent["payload"].to_pylist()) if k == 0]
    assert all(n <= 100 for n in collections.Counter(bytes(x) for c in cores for x in c).values())
    spans = passages.span_rows(sent)
    kept = pa.concat_tables([passages.remove_rows(t, spans.filter(pc.equal(spans["b"], b))) for b, t in enumerate(blocks)]).to_pylist()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in kept) == sorted(brute(rows))


def test_passages_of_hard_rows(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = passages.remove_repeats(df)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute([(r[0], r[1]) for r in rows]), key=order)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=order) == want
    left = passages.texts(got).select("doc_id", "text", "other.*").collect()
    assert sorted(map(hash, (r.text for r in left))) == sorted(hash(w[4].decode("utf-8", "ignore")) for w in want)
    assert passages.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
