"""Phrases, prefix fingerprints and the conversation trie against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from assaylake.llm import phrases, prefix_hashes, prefix_trie
from tests.llm.frames import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) == 1 or a < least:
            continue
        if len(w) == 2 and any(2 * b >= a for (m, *x), b in f.items() if m == lang and len(x) == 3 and b >= least and (x[:2] == w or x[1:] == w)):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    return sorted(out)


def phrase_rows():
    rows = [r[:8] for r in documents() if r[0] != 11 and r[0] != 12]
    rows += [(20 + i, "The cat sat on the mat. The cat sat! on\tthe mat\x0bthe,cat; sat", "en", "a", 1, None, None, None) for i in range(7)]
    rows += [(40, "go " * 30, None, "a", 1, None, None, None), (41, "un été très chaud, un été très long. Un Été", "und", "a", 1, None, None, None)]
    return rows


@pytest.mark.parametrize("least, most", [(2, 1 << 20), (5, 3)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(phrases, "MOST_PHRASES", most)
    rows = phrase_rows()
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=least)
    got = sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, int(r.score)) for r in found.collect())
    assert got == brute_phrases(rows, least) and got
    first = phrases.best(found, 3).collect()
    for lang in {r.lang for r in first}:
        want = sorted((x for x in got if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:3]
        assert [r.phrase for r in sorted((r for r in first if r.lang == lang), key=lambda r: r.rank)] == [x[1] for x in want]


def test_texts_are_read_once_for_all_tries(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_PHRASES", 3)
    monkeypatch.setattr(phrases, "MOST_SUMS", 8)
    monkeypatch.setattr(phrases, "MOST_ROWS", 8)
    reads, texts = [], phrases._texts
    monkeypatch.setattr(phrases, "_texts", lambda docs: reads.append(1) or texts(docs))
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=2).collect()
    # Words, pairs and triples are summed once each; the fourth reading serves every trie.
    assert len(reads) == 4
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, int(r.score)) for r in got) == brute_phrases(rows, 2)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_finds_its_phrases_and_no_others():
    draw = np.random.default_rng(3)
    n_words = 70000
    rows = np.unique(np.concatenate([draw.integers(0, n_words, (3000, 3)), np.stack([np.full(3000, 7), draw.integers(0, n_words, 3000), np.zeros(3000, int)], 1)]), axis=0)
    length = np.where(rows[:, 0] == 7, 2, 3)
    rows[length == 2, 2] = 0
    rows, first = np.unique(rows, axis=0, return_index=True)
    length = length[first]
    trie = phrases.Trie(rows, length, n_words)
    state = trie.step(np.zeros(len(rows), np.int64), rows[:, 0])
    state = trie.step(state, rows[:, 1])
    assert (state[length == 2] == trie.states[length == 2]).all() and len(set(trie.states.tolist())) == len(rows)
    assert (trie.step(state, rows[:, 2])[length == 3] == trie.states[length == 3]).all()
    other = draw.integers(0, n_words, (5000, 2))
    known = {tuple(r) for r in rows[:, :2].tolist()}
    state = trie.step(trie.step(np.zeros(5000, np.int64), other[:, 0]), other[:, 1])
    assert ((state >= 0) == np.array([tuple(x) in known for x in other.tolist()])).all()


def test_spans_and_extensions_equal_the_texts():
    text = "abracadabra abracadabrb xabracadabra" * 3 + "é😀é😀"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    p = prefix_hashes.Prefixes(points)
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, len(text), 500), draw.integers(0, len(text), 500)
    most = len(text) - np.maximum(a, b)
    length = (most * draw.random(500)).astype(int)
    assert p.equal(a, b, length).tolist() == [text[i : i + n] == text[j : j + n] for i, j, n in zip(a, b, length)]

    def common(x, y):
        return next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

    assert p.extension(a, b, most).tolist() == [common(text[i:], text[j:]) for i, j in zip(a, b)]
    assert p.extension(a, b, np.minimum(a, b), back=True).tolist() == [common(text[:i][::-1], text[:j][::-1]) for i, j in zip(a, b)]


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_equal_brute_force(spark, parts):
    rows = documents() + [(30, "x", "en", "a", 1, None, None, None), (31, "same text here, and a little more of it", "en", "a", 1, None, None, None), (29, "same text here, and a little more of it", "en", "a", 1, None, None, None)]
    got = prefix_hashes.fingerprints(spark.createDataFrame(rows, SCHEMA), parts).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = collections.Counter()
    for row, after in zip(ordered, ordered[1:] + ordered[:1]):
        a, b = row[1] or "", after[1] or ""
        half = len(a) // 2
        want[row[0], len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    texts = {r[0]: r[1] or "" for r in rows}
    prints = collections.defaultdict(set)
    for r in got:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert r.near_edited == prefix_hashes.likeness(r.fingerprint, r.edited_fingerprint)
        assert 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    by = {r.doc_id: r for r in got}
    assert prefix_hashes.likeness(by[31].fingerprint, by[29].fingerprint) == 1.0
    assert 0.4 < by[11].near_edited < 0.75 and by[5].near_next == 0.0


def test_fingerprints_of_an_empty_table_and_one_row(spark):
    assert prefix_hashes.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = prefix_hashes.fingerprints(spark.createDataFrame(documents()[:1], SCHEMA), 3).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]


def brute_trie(rows):
    raw = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            raw[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    raw = {c: [t for *_, t in sorted(x, key=lambda y: y[:2])] for c, x in raw.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(raw):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(raw.get(base, [])[:h] + raw[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids), leaves, saved, digest))
    return sorted(out, key=str)


def conversation_rows():
    rows = []
    for c in range(-7, 40):
        for t in range((c * 7) % 11):
            text = f"turn {t}" if c % 3 or t < 3 else f"own {c} {t}"
            rows.append((c, None if t == 0 and c % 4 == 0 else t, "user" if t % 2 == 0 else None, None if t == 2 and c % 6 == 0 else text, "x"))
    return rows + [(None, 1, "user", "lost", "x"), (12, 0, "user", "again", "x"), (12, 0, "user", "again", "x"), (900, 5, "", "", None), (903, 0, "a", "ünï", None)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("limit, held", [(None, 1 << 17), (3, 2), (20, 4)])
def test_trie_equals_brute_force(spark, limit, held):
    rows = conversation_rows()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), limit, held).collect()
    assert sorted([tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got], key=str) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_queue_spills_and_keeps_order():
    draw = np.random.default_rng(1)
    queue, want, got = prefix_trie.SpillingQueue(7), [], []
    for step in range(30):
        for k in draw.integers(step, step + 9, 20).tolist():
            queue.push((k, step))
            want.append(k)
        got += [x[0] for x in queue.pop_until((step,))]
    got += [x[0] for x in queue.pop_until((99,))]
    assert got == sorted(want) and queue.n_runs > 5
