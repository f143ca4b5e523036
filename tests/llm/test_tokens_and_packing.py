import collections
import uuid

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaylake.functions.lineage import _shared_folder
from assaylake.llm import packing, token_files
from assaylake.llm.tokens import Encoder
from tests.llm.frames import SCHEMA, crc, documents

FILES = [("byte_bpe_50k.json", "kept", 4), ("word_bpe_49k.json", "dropped", 2)]
ODD = ["", " ", "  ", "a  b", " x", "x ", "\n\n x", "a\n b", "don't  stop it's", " \n ", "a  b", "<|endoftext|> hi", "É́ Σας", "a\n\nb c\td", "Été, ÀÉÎ!! Straße. ÿªº µm a×b ÷ x..y", "ǅ ŉ İI", "word.'s foo!? (bar) [x] __y__ ß", "one.\nTwo three\nFour", "x" * 300 + "1", "é" * 200 + "e" * 200 + "9", "12 3.5 a1 b\x1c c\x85d e f"]


@pytest.mark.parametrize("name, spaces, width", FILES)
def test_remembered_ids_equal_the_library(name, spaces, width):
    coder = Encoder(public_tokenizers.path(name), spaces, width, remembered=40)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + [r[1] or "" for r in documents()][:11] + [" ".join(ODD)]
    for _ in range(2):
        got = coder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, f"<u{width}").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark):
    rows = documents()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = f"{_shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), path).collect()]
    want, start = [], 0
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids + [2]
        want.append((row[0], start, len(ids), crc(ids)))
        start += len(ids)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    full = token_files.scan(spark, path).collect()
    assert all(len(r.ids) == 4 * r.n for r in full)


def test_hash_is_minimal_and_perfect_and_strangers_are_refused(spark):
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(-(1 << 62), 1 << 62, 5000))
    nth = np.zeros(len(keys), np.int64)
    levels, slots = token_files.build(keys, nth)
    assert sorted(slots) == list(range(len(keys)))
    assert (token_files.find(levels, keys, nth) == slots).all()
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    path = f"{_shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"), shards=3)
    index, buckets = token_files.build_index(token_files.scan(spark, path, ids=False), per_bucket=30)
    wanted = spark.createDataFrame([(i, 0) for i in range(150, 400)], "key long, nth long")
    assert sorted(r.key for r in token_files.locate(index, buckets, wanted).collect()) == list(range(150, 200))


def test_token_files_of_an_empty_table(spark):
    path = f"{_shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json"), path).count() == 0


def test_packing_places_every_piece(spark):
    rows = documents() + [(100 + i, "some words " * (i * 13 % 400), "en", "a", 1, None, None, None) for i in range(300)]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for row in rows:
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(row[0], k, a, b - a, crc(ids[a:b]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // 2048) + 2


def test_layouts_hold_the_histogram():
    draw = np.random.default_rng(5)
    many = draw.integers(1, 2049, 3000)
    for sizes, most in ((many, 1.02 * many.sum() / 2048 + 2), (np.full(50, 1025), 50), (np.repeat([1500, 548, 700], 40), 60), ([1], 1)):
        histogram = collections.Counter(int(x) for x in sizes)
        found = packing.layouts(histogram)
        held = collections.Counter()
        for items, times in found:
            assert sum(length * k for length, k in items) <= 2048
            for length, k in items:
                held[length] += k * times
        assert held == histogram
        assert sum(n for _, n in found) <= most


def histogram_of(n, seed=0):
    sizes = np.clip(np.exp(np.random.default_rng(seed).normal(6.2, 1.0, n)), 1, 2047).astype(int)
    lengths, need = np.unique(sizes, return_counts=True)
    return lengths, need


@pytest.mark.parametrize("n, part", [(10_000, 0.7), (400_000, 0.9)])
def test_program_covers_the_histogram_and_most_sequences_are_its_own(n, part):
    lengths, need = histogram_of(n)
    solved = packing.solve(lengths, need)
    assert sum(c * x for c, x in solved) == pytest.approx(need, rel=1e-6)
    bound = need @ lengths / 2048
    assert all(c @ lengths <= 2048 for c, _ in solved) and sum(x for _, x in solved) <= 1.01 * bound
    alone = sum(k for _, k in packing._best_fit(need, lengths, 2048))
    rounded = [packing._rounded(solved, need, lengths, 2048, waste) for waste in packing.WASTES]
    total, own = min((sum(k for _, k in r), -own) for r, own in rounded)
    assert -own >= part * total
    assert sum(k for _, k in packing.layouts(dict(zip(lengths.tolist(), need.tolist())))) <= min(alone, total)


def test_packing_of_an_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
