"""Every stage of the pipeline on what its predecessor kept, against brute force or SQL."""

import collections
import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from assaylake.llm import mixing, rules
from tests.llm.frames import SCHEMA, crc, documents
from tests.llm.test_dedup import brute, components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sql(frame, text):
    con = duckdb.connect()
    con.register("documents", frame)
    return con.execute(text).fetchdf()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()

    kept = sql(before, rules.SQL).query("kept")["doc_id"].tolist()
    docs = stages["quality_rules"](spark, docs, SF)
    assert docs.columns == COLUMNS
    after = docs.toPandas()
    assert sorted(after.doc_id) == sorted(kept)
    assert dict(zip(after.doc_id, after.text)).items() <= dict(zip(before.doc_id, before.text)).items()

    before = after
    tree = components(list(zip(before.doc_id, before.text)))
    docs = stages["near_duplicates"](spark, docs, SF)
    after = docs.toPandas()
    assert docs.columns == COLUMNS and sorted(after.doc_id) == sorted(i for i in before.doc_id if tree.root(i) == i)

    before = after
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute(list(zip(before.doc_id, before.text)))}
    docs = stages["repeated_passages"](spark, docs, SF)
    after = docs.toPandas()
    assert docs.columns == COLUMNS and dict(zip(after.doc_id, after.text)) == want
    assert all(after.n_chars == after.text.str.len())

    before = after
    want = sql(before, mixing.SQL)
    docs = stages["mix_sources"](spark, docs, SF)
    after = docs.toPandas()
    taken = collections.Counter(after.doc_id)
    assert docs.columns == COLUMNS
    assert all(taken[i] * s == t for i, s, t in zip(want.doc_id, want["size"], want.taken))

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text in zip(after.doc_id, after.text):
        ids = coder.encode(text, add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    packed = stages["pack"](spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a[1] == b[0] for parts in map(sorted, ends.values()) for a, b in zip(parts, parts[1:]))
    assert all(min(p)[0] == 0 and max(p)[1] <= 2048 for p in ends.values())


def test_pipeline_of_hard_rows_and_of_none(spark):
    for rows in (documents(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "pack":
                assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert (docs.count() > 0) == bool(rows)
