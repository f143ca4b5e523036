import collections

import pytest

import corpus_pipeline
from assaylake.llm import mixing, rules
from tests.llm.frames import SCHEMA, WORD, documents


def test_measures_and_verdicts(spark):
    rows = documents()
    got = rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for row in rows:
        text = row[1] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        for r in by[row[0]]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
            assert r.removed_words == 0 and r.kept == (not r.base_failed)


def test_shared_lines_are_removed_and_depleted_documents_rejected(spark):
    line = "a line that every page of this host has at its end and start and everywhere"
    own = "twelve words of its own are in each of these documents number "
    rows = [(i, f"{line}\n{own}{i} {'x' * i}" if i % 2 else f"{line}\nfew words {i}", "h") for i in range(60)]
    rows += [(100, f"{line}\n{own}100", "other")] + [(200 + i, f"{line} \nsame text in many copies", "copies") for i in range(60)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    n = len(line.split())
    assert got[0].removed_words == 0 and got[0].kept
    assert got[2].removed_words == n and not got[2].kept
    assert got[3].removed_words == n and got[3].kept
    assert got[100].removed_words == 0 and got[205].removed_words == 0


def test_stage_emits_texts_without_shared_lines(spark):
    """Short lines too, which the passage stage doesn't see; the first holder, other hosts and blank lines stay whole."""
    line, long = "Licensed under the Apache License, Version 2.0.", "A long ΣΑΣ\tline that stands in every document of this host, in any case"
    body = lambda i: f"twelve words of its own are in each of these documents number {i}\n\n  indented {'x' * i} "
    rows = [(i, f"{line}\n{body(i)}\n{long.upper() if i % 2 else long}\n {line.lower()} \n", "h") for i in range(40)]
    rows += [(40, rows[3][1], "other"), (3, rows[3][1], "other"), (7, rows[7][1], "h"), (None, rows[8][1], "h"), (41, f"{line}\ntoo few", "h")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars int")
    want = [(i, t if i == 0 or s == "other" else t.split("\n", 1)[1].rsplit("\n", 3)[0] + "\n", s) for i, t, s in rows if i != 41]
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, t, s, len(t)) for i, t, s in want)


def test_rules_of_an_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_targets_fill_up_to_the_limit(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, None: 500, "z": 0}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {"a": (1000, pytest.approx(1460 * 5 / 7)), "b": (10, 30.0), "c": (10, 30.0), "z": (0, 0.0), None: (500, pytest.approx(1460 * 2 / 7))}
    assert sum(t for _, t in got.values()) == pytest.approx(1520)


def test_mix_is_near_its_targets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(df)
    per = planned.selectExpr("doc.source AS source", "size * copies AS taken", "target").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05 for r in per)
    a, b = (sorted(map(tuple, mixing.emit(mixing.plan(x)).collect())) for x in (df, df.repartition(7)))
    assert a == b and len(a) == planned.selectExpr("sum(copies)").first()[0]


def test_mix_of_hard_rows(spark):
    rows = documents()
    planned = mixing.plan(spark.createDataFrame(rows, SCHEMA))
    assert planned.count() == len(rows)
    assert all(r["size"] == len(WORD.findall(r["doc"]["text"] or "")) and 0 <= r["copies"] <= 3 for r in planned.collect())
    assert mixing.emit(planned).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
