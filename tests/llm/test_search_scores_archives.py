import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pytest

from assaylake.functions.lineage import _shared_folder
from assaylake.llm import quality, search, toxicity, warc
from tests.llm.frames import SCHEMA, documents

VECTORS = "vec_id long, embedding array<float>, rank string, list int"


def vectors(n=1500, d=24, seed=2):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(8, d)) * 2
    x = (centers[draw.integers(0, 8, n)] + draw.normal(size=(n, d))).astype(np.float32)
    x[100:400] = x[7]  # one vector many rows have
    return [(i, [float(v) for v in row], "r", 1) for i, row in enumerate(x)]


def nearest(rows, every, k):
    """Exact: for each query the ids and cosines of the nearest, ties to the smaller id."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        yield int(ids[q]), [int(ids[i]) for i in order], [float(score[i]) for i in order]


@pytest.mark.parametrize("per_block", [4096, 64])
def test_search_finds_the_nearest(spark, per_block):
    rows = vectors()
    got = {}
    for r in search.search(spark.createDataFrame(rows, VECTORS), per_block=per_block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, ids, scores in nearest(rows, 50, 5):
        mine = sorted(got.pop(q))
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        hits += len({i for _, i, _ in mine} & set(ids))
        total += 5
        exact = dict(zip(ids, scores))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in mine if i in exact)
        if 100 <= q < 400:
            assert [i for _, i, _ in mine] == ids
    assert not got and hits >= 0.9 * total


def test_search_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "r", 1), (1, [1.0, 1.0], "r", 1), (2, None, "r", 1), (50, [0.0, 0.0], "r", 1), (4, [nan, 1.0], "r", 1), (5, [inf, 1.0], "r", 1), (6, [None, 1.0], "r", 1), (7, [1.0, 2.0, 3.0], "r", 1), (None, [1.0, 0.0], "r", 1), (8, [-1.0, 0.0], None, None), (0, [1.0, 0.0], "r", 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in search.search(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(0, 1, 1, 0.707107), (0, 2, 8, -1.0)]
    assert search.search(spark.createDataFrame([], VECTORS)).count() == 0


PAGES = "page_id long, url string, html string, digest string, status string"


def test_archives_round_trip(spark):
    same, big = "<p>" + "ä same " * 30, "<b>" + "0123456789\r\n\r\n" * 9000
    rows = [(3, "http://a/x y", same), (1, None, same), (2, "http://b", same), (9, "http://c", "short"), (8, "http://c", "short"), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", big), (7, "http://g", big), (7, "http://g", big), (10, "http://h", "WARC/1.1\r\n\r\n0\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*r, "d", "s") for r in rows], PAGES)
    path = f"{_shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.first_pages(df), path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 100
    pages = warc.reassemble(records)
    payloads = {r.page_id: bytes(r.payload) for r in pages.where("record_type = 'response'").collect()}
    assert payloads[6] == big.encode() and payloads[10] == rows[-1][2].encode() and payloads[4] == b""
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status) for r in warc.resolve(pages).collect())
    first = {1: None, 2: 1, 3: 1, 6: None, 7: 6}
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(i) else "response", first.get(i), "ok") for i, _, h in rows]
    assert got == sorted(want)


def test_broken_archives_are_told(spark):
    parts = warc.records_of(1, None, b"x" * 5000, None, "urn:a", 1000)
    lost = [p for p in parts if b"WARC-Segment-Number: 3\r\n" not in p]
    wrong = [p.replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9") for p in warc.records_of(2, None, b"y" * 5000, None, "urn:b", 1000)]
    cut_ = [warc.records_of(3, None, b"z" * 500, None, "urn:c")[0].replace(b"1f4\r\nz", b"1f5\r\nz")]
    alone = warc.records_of(4, None, b"w" * 500, 77, "urn:d")
    data = b"".join(p + b"\r\n\r\n" for p in lost + wrong + cut_ + alone)
    rows = [{"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "page": f.get("warc-page-id"), "kind": f["warc-type"], "refers": f.get("warc-refers-to-page-id"), "segment": f.get("warc-segment-number"), "total": f.get("warc-segment-total-length"), "digest": f.get("warc-payload-digest"), "block": b} for f, b in warc.parse(data)]
    number = lambda x: None if x in (None, "None") else int(x)
    df = spark.createDataFrame([(r["origin"], number(r["page"]), r["kind"], number(r["refers"]), number(r["segment"]), number(r["total"]), r["digest"], bytearray(r["block"])) for r in rows], warc.SCHEMA)
    got = {r.page_id: r.status for r in warc.resolve(warc.reassemble(df)).collect()}
    assert got == {1: "missing segments", 2: "wrong length", 3: "broken framing", 4: "unresolved"}
    assert gzip.decompress(gzip.compress(data)) == data and warc.unchunked(warc.chunked(b"")) == b""


def test_archives_of_an_empty_table(spark):
    path = f"{_shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.first_pages(spark.createDataFrame([], PAGES)), path)
    assert warc.resolve(warc.reassemble(warc.read_records(spark, path))).count() == 0


def labelled(n=600, seed=3):
    """Toxic only where an insult meets a group, so that no sum of single weights tells."""
    draw = np.random.default_rng(seed)
    words = [f"plain{i}" for i in range(80)]
    rows = []
    for i in range(n):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        text = [str(w) for w in draw.choice(words, 12)] + ["insultword"] * insult + ["groupword"] * group
        rows.append((i, " ".join(str(w) for w in draw.permutation(text)), int(insult and group)))
    return rows


def test_machine_learns_a_pair_of_terms(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == bool(y) for i, _, y in out]) > 0.95
    probe = spark.createDataFrame([(1, "insultword"), (2, "groupword"), (3, "groupword insultword")], "doc_id long, text string")
    a, b, c = (r.score for r in toxicity.score(probe, machine).orderBy("doc_id").collect())
    assert c > 0.5 > max(a, b)


def test_network_learns_byte_patterns():
    draw = np.random.default_rng(1)
    plain = lambda n: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(n))
    texts = [plain(int(draw.integers(5, 300))) + ("" if i % 3 else " " + "%%% ### " * 12 + plain(20)) for i in range(240)]
    label = np.array([float(i % 3 > 0) for i in range(240)], np.float32)
    net = quality.train([t.encode() for t in texts[:180]], label[:180], epochs=40)
    data = np.frombuffer("".join(texts[180:]).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts[180:]])])
    p = quality.probabilities(net, data, at)
    assert ((p >= 0.5) == (label[180:] > 0)).mean() > 0.9
    alone = [quality.probabilities(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts[180:190]]
    assert np.allclose(alone, p[:10], atol=1e-5)


def test_pooling_covers_whole_texts():
    """Pooled values equal a plain loop over overlapping chunks."""
    net = quality.new()
    sizes = [0, 1, 3, 4, 9, 500, 2000]
    data = np.random.default_rng(4).integers(0, 256, sum(sizes)).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    laid, windows = quality.laid_out(data, at)
    maxima, _, text = quality.pooled(net, laid, windows)
    want = []
    for k, n in enumerate(sizes):
        own = np.concatenate([data[at[k] : at[k + 1]], np.zeros(16, np.uint8)])
        values = [net.vectors[own[4 * i : 4 * i + 8]].ravel() @ net.filters for i in range(max(1, -(-n // 4)))]
        starts = range(0, max(1, len(values) - quality.OVERLAP), quality.CHUNK)
        want += [(k, np.maximum(np.max(values[s : s + quality.CHUNK + quality.OVERLAP], axis=0) + net.offsets, 0)) for s in starts]
    assert text.tolist() == [k for k, _ in want]
    assert np.allclose(maxima, [v for _, v in want], atol=1e-4)


def test_scores_of_hard_rows(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for given in (labels, labels.limit(0)):
            got = module.score(docs, module.fit(docs, given)).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id == 15}) == 1
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0
