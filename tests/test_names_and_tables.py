"""Names in every form, consequences, sources on files, and neighbour pairs against brute force."""

import gzip

import numpy as np

from assaylake.operators import assemble as asm
from assaylake.operators import names as nm
from assaylake.sources import readers as rd
from assaylake.sources import writers as wr


def test_parse_variants(spark):
    names = {
        "p.Ala12Val": ("p.Ala12Val", "missense"), "A12V": ("p.Ala12Val", "missense"), "p.Ala12Ala": ("p.Ala12=", "synonymous"), "A12*": ("p.Ala12Ter", "nonsense"), "_wt": ("p.=", "wild type"),
        "_sy": ("p.(=)", "synonymous"), "p.[Leu5Pro;Ala2Val]": ("p.[Ala2Val;Leu5Pro]", "multi-variant"), "p.Gly5fs": ("p.Gly5fs", "frameshift"), "p.Ala2del": ("p.Ala2del", "deletion"),
        "p.Ala2_Gly3insTrp": ("p.Ala2_Gly3insTrp", "insertion"), "p.Met1Val": ("p.Met1Val", "start lost"), "p.Ter9Gln": ("p.Ter9Gln", "stop lost"), "c.4A>G": ("c.4A>G", "nucleotide substitution"),
        "c.67+1G>A": ("c.67+1G>A", "splice site"), "c.67+9G>A": ("c.67+9G>A", "intronic"), "c.-4A>G": ("c.-4A>G", "5' UTR"), "c.*4A>G": ("c.*4A>G", "3' UTR"), "zzz": (None, None), "NA": (None, None),
        "p.[Ala2Val;Ala2Gly]": (None, None),
    }
    got = {r["variant"]: (r["key"], r["kind"]) for r in nm.parse_variants(spark.createDataFrame([(n,) for n in names], "variant string")).collect()}
    assert got == names


# Coding sequences: M A G W stop, and M A A G L without a stop.
SHORT, OPEN = "ATGGCTGGTTGGTAA", "ATGGCTGCTGGTCTT"
INDELS = [
    (SHORT, "c.4_6del", "deletion", "p.Ala2del", 2),
    (SHORT, "c.4_9del", "deletion", "p.Ala2_Gly3del", 2),
    (SHORT, "c.5del", "frameshift", "p.Ala2fs", 2),
    (SHORT, "c.4_6dup", "duplication", "p.Ala2dup", 2),
    (SHORT, "c.4_9dup", "duplication", "p.Ala2_Gly3dup", 2),
    (SHORT, "c.6_7insTGG", "insertion", "p.Ala2_Gly3insTrp", 2),
    (SHORT, "c.1_2del", "start lost", None, 1),
    (SHORT, "c.13_15delinsTGGTAA", "stop lost", "p.Ter5Trp", 5),
    (SHORT, "c.13_15delinsTGG", "stop lost", "p.Ter5Trp", 5),
    (SHORT, "c.13_15del", "stop lost", "p.Ter5Xaa", 5),
    (SHORT, "c.7_12del", "nonsense", "p.Gly3Ter", 3),
    (SHORT, "c.13_15dup", "synonymous", "p.=", None),
    (SHORT, "c.12_13insTAA", "synonymous", "p.Ter5=", 5),
    (SHORT, "c.6_7insTAA", "nonsense", "p.Gly3Ter", 3),
    (SHORT, "c.6_7insTGGTAATGG", "insertion", "p.Ala2_Gly3insTrpTer", 2),
    (SHORT, "c.9_10insTAAG", "nonsense", "p.Trp4Ter", 4),
    (SHORT, "c.4_9delinsTGG", "deletion-insertion", "p.Ala2_Gly3delinsTrp", 2),
    (SHORT, "c.4_6delinsTGG", "missense", "p.Ala2Trp", 2),
    (SHORT, "c.4_9delinsGCCGGA", "synonymous", "p.[Ala2=;Gly3=]", 2),
    (SHORT, "c.4_9delinsTGGTGG", "multi-variant", "p.[Ala2Trp;Gly3Trp]", 2),
    (SHORT, "c.4_9delinsTAATGG", "nonsense", "p.Ala2Ter", 2),
    (SHORT, "c.1_6delinsGTGTGG", "start lost", None, 1),
    (OPEN, "c.4_6del", "deletion", "p.Ala3del", 3),
    (OPEN, "c.4_6dup", "duplication", "p.Ala3dup", 3),
    (OPEN, "c.14_15del", "frameshift", "p.Leu5fs", 5),
    (SHORT, "c.88+1_88+5del", "splice site", None, None),
    (SHORT, "c.88+10del", "intronic", None, None),
    (SHORT, "c.-4del", "5' UTR", None, None),
    (SHORT, "c.-4_2del", "start lost", None, None),
    (SHORT, "c.*4del", "3' UTR", None, None),
    (SHORT, "c.14_19del", None, None, None),
    (SHORT, "nonsense name", None, None, None),
]


def test_indels(spark):
    targets = spark.createDataFrame([("s", SHORT), ("o", OPEN)], "dataset_id string, sequence string")
    names = spark.createDataFrame([("s" if dna == SHORT else "o", name) for dna, name, *_ in INDELS], "dataset_id string, variant string")
    got = {(r.dataset_id, r.variant): (r["class"], r.pro_key, r.position) for r in nm.consequence_indels(names, targets).collect()}
    wrong = []
    for dna, name, cls, key, position in INDELS:
        have = got["s" if dna == SHORT else "o", name]
        if have[0] != cls or (key is not None and have[1] != key) or have[2] != position:
            wrong.append((name, have, (cls, key, position)))
    assert not wrong


def test_read_counts_with_comments_and_gz(spark, tmp_path):
    path = tmp_path / "counts.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("# a comment\nhgvs_pro\tin1\tout1\np.Ala2Val\t5\tNA\np.=\t0\tword\n")
    table = rd.read_counts(spark, str(path), sep="\t")
    types = {r["column"]: r["type"] for r in rd.column_types(table).collect()}
    assert types == {"hgvs_pro": "text", "in1": "number", "out1": "text"}
    rows = {r["hgvs_pro"]: (r["in1"], r["out1"]) for r in rd.typed(table, ["in1", "out1"]).collect()}
    assert rows == {"p.Ala2Val": (5.0, None), "p.=": (0.0, None)}
    layout = rd.detect_layout(table)
    assert layout["layout"] == "generic" and layout["variant_column"] == "hgvs_pro"


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("d", "p.=", 1.5), ("d", "p.Ala2Val", None)], "dataset_id string, hgvs_pro string, score double")
    wr.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("*.csv"))
    assert "p.Ala2Val,NA" in text


def test_neighbor_pairs_brute_force(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-2, 2, (60, 3))
    df = spark.createDataFrame([("d", i, *map(float, x)) for i, x in enumerate(p)], "dataset_id string, position int, x double, y double, z double")
    got = {(r["a"], r["b"]) for r in asm.neighbor_pairs(df, 0.7).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(p[i] - p[j]) <= 0.7}
    assert got == want


def test_shared_input_sheet(spark):
    sheet = spark.createDataFrame([("in", "input", "1;2"), ("o1", "output", "1"), ("o2", "out", "2")], "sample string, role string, replicate string")
    got = {(r["source_column"], r["biological"]) for r in rd.design_from_sheet(sheet).collect()}
    assert got == {("in", 1), ("in", 2), ("o1", 1), ("o2", 2)}
