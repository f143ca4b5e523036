"""Queries for variant names, table assembly, sources and sinks."""

from pyspark.sql import functions as F

from assaylake.functions.expressions import settle
from assaylake.operators import assemble as asm
from assaylake.operators import barcodes as bc
from assaylake.operators import names as nm
from assaylake.plans.facts import ALT, ALT3, DATASET, KIND, N_POSITIONS, POSITION, REF, REF3, SHARED_SQL, THREE_LETTER, VARIANT, VARIANT_NO, Facts
from assaylake.plans.registry import query
from assaylake.plans.scoring import barcode_rows, reasons
from assaylake.sources import readers as rd
from assaylake.sources import writers as wr

# --- Names in several styles -----------------------------------------------------------------------

NEXT3 = f"substr('{THREE_LETTER}', CAST(1 + 3 * ((({POSITION} + 1) * 7) % 20) AS INT), 3)"
BODY = f"CASE WHEN {REF} = {ALT} THEN concat({REF3}, CAST({POSITION} AS STRING), '=') ELSE concat({REF3}, CAST({POSITION} AS STRING), {ALT3}) END"
WRITTEN = f"""CASE WHEN style = 7 THEN concat('x', CAST(v AS STRING)) WHEN v = 0 THEN CASE style WHEN 2 THEN '_wt' WHEN 4 THEN 'WT' ELSE 'p.=' END
    WHEN style = 2 THEN concat({REF}, CAST({POSITION} AS STRING), CASE WHEN {REF} = {ALT} THEN '=' ELSE {ALT} END)
    WHEN style = 3 THEN concat('p.(', {BODY}, ')') WHEN style = 4 THEN {BODY}
    WHEN style = 5 AND {ALT} = '*' THEN concat('p.', {REF3}, CAST({POSITION} AS STRING), '*') WHEN style = 5 AND {REF} = {ALT} THEN concat('p.', {REF3}, CAST({POSITION} AS STRING), {REF3})
    WHEN style = 6 THEN concat('p.[', {NEXT3}, CAST({POSITION} + 1 AS STRING), '=;', {BODY}, ']') ELSE {VARIANT} END"""
EXPECTED = f"CASE WHEN style = 7 THEN NULL WHEN v <> 0 AND style = 6 THEN concat('p.[', {BODY}, ';', {NEXT3}, CAST({POSITION} + 1 AS STRING), '=]') ELSE {VARIANT} END"

SHARED_SQL["written"] = f"""SELECT dataset_id, v, style, {WRITTEN} AS variant, {EXPECTED} AS key FROM (SELECT DISTINCT {DATASET} AS dataset_id, {VARIANT_NO} AS v, l_linenumber AS style FROM lineitem)"""
SHARED_SQL["name_facts"] = f"""SELECT DISTINCT variant, key, CASE WHEN key IS NULL THEN 'invalid' WHEN key = variant THEN 'valid' ELSE 'read leniently' END AS status,
    CASE WHEN key IS NULL THEN NULL WHEN style = 6 AND v <> 0 THEN 'multi-variant' ELSE {KIND} END AS kind, CASE WHEN key IS NULL OR v = 0 THEN NULL ELSE {POSITION} END AS position,
    CASE WHEN key IS NULL OR v = 0 OR style = 6 THEN NULL ELSE {REF} END AS ref, CASE WHEN key IS NULL OR v = 0 OR style = 6 THEN NULL ELSE {ALT} END AS alt FROM written"""


def written(t: Facts):
    rows = t.table("lineitem").selectExpr(f"{DATASET} AS dataset_id", f"{VARIANT_NO} AS v", "l_linenumber AS style").distinct()
    return rows.selectExpr("dataset_id", "v", "style", f"{WRITTEN} AS variant")


@query("n1_parse_variants", "variant:s key:s status:s kind:s position:i ref:s alt:s", "SELECT * FROM name_facts")
def n1(t: Facts):
    return nm.parse_variants(written(t))


@query(
    "n2_variant_kind",
    "kind:s n:i",
    "SELECT kind, count(*) AS n FROM name_facts WHERE kind IS NOT NULL GROUP BY ALL",
)
def n2(t: Facts):
    return nm.parse_variants(written(t)).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n3_duplicate_variants",
    "dataset_id:s key:s n_rows:i",
    "SELECT dataset_id, key, count(*) AS n_rows FROM (SELECT DISTINCT dataset_id, variant, key FROM written) WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
def n3(t: Facts):
    rows = written(t).select("dataset_id", "variant").distinct().join(nm.parse_variants(written(t)).select("variant", "key"), "variant")
    return nm.duplicate_variants(rows)


SHIFTED = f"CASE WHEN style = 7 THEN concat('x', CAST(v AS STRING)) WHEN v = 0 THEN 'p.=' WHEN style = 4 THEN concat('p.', {REF3}, CAST({POSITION} + 1 AS STRING), {ALT3}) ELSE {VARIANT} END"


@query(
    "n4_check_target",
    "dataset_id:s variant:s status:s position:i",
    f"""SELECT dataset_id, variant, CASE WHEN variant LIKE 'x%' OR position > {N_POSITIONS} OR (position IS NOT NULL AND ref <> ref_aa) THEN 'invalid' WHEN variant = key THEN 'valid' ELSE 'read leniently' END AS status, position FROM (
        SELECT DISTINCT dataset_id, {SHIFTED} AS variant, CASE WHEN v = 0 OR style = 7 THEN NULL ELSE {POSITION} + CASE WHEN style = 4 THEN 1 ELSE 0 END END AS position, CASE WHEN v = 0 THEN NULL ELSE {REF} END AS ref,
        CASE WHEN style = 4 AND {REF} = {ALT} AND v <> 0 THEN concat('p.', {REF3}, CAST({POSITION} + 1 AS STRING), '=') ELSE {SHIFTED} END AS key FROM written) LEFT JOIN targets USING (dataset_id, position)""",
)
def n4(t: Facts):
    rows = written(t).selectExpr("dataset_id", f"{SHIFTED} AS variant").distinct()
    parsed = rows.join(nm.parse_variants(rows), "variant")
    return nm.check_target(parsed, t.targets)


@query(
    "n5_other_target",
    "dataset_id:s variant:s target:s",
    f"SELECT DISTINCT dataset_id, concat('T', CAST(style AS STRING), ':', {VARIANT}) AS variant, concat('T', CAST(style AS STRING)) AS target FROM written WHERE style NOT IN (1, 2)",
)
def n5(t: Facts):
    rows = written(t).selectExpr("dataset_id", f"concat('T', CAST(style AS STRING), ':', {VARIANT}) AS variant").distinct()
    parsed = rows.join(nm.parse_variants(rows), "variant")
    labels = t.datasets.selectExpr("dataset_id", "explode(array('T1', 'T2')) AS label")
    return nm.other_target(parsed, labels)


@query(
    "n11_summarize_variants",
    "dataset_id:s status:s kind:s n:i first_position:i last_position:i",
    """SELECT dataset_id, status, kind, count(*) AS n, min(position) AS first_position, max(position) AS last_position FROM (SELECT DISTINCT dataset_id, variant FROM written) JOIN name_facts USING (variant) GROUP BY ALL""",
)
def n11(t: Facts):
    rows = written(t).select("dataset_id", "variant").distinct()
    return nm.summarize_variants(rows.join(nm.parse_variants(rows), "variant"))


@query(
    "n12_place_on_target",
    "dataset_id:s outside:i compared:i disagree:i problem:b",
    f"""SELECT dataset_id, count(*) FILTER (ref_aa IS NULL) AS outside, count(*) FILTER (ref_aa IS NOT NULL AND ref IS NOT NULL) AS compared, count(*) FILTER (ref_aa <> ref) AS disagree,
        count(*) FILTER (ref_aa IS NOT NULL AND ref IS NOT NULL) >= 5 AND count(*) FILTER (ref_aa <> ref) > count(*) FILTER (ref_aa IS NOT NULL AND ref IS NOT NULL) / 10 AS problem FROM (
        SELECT dataset_id, ref, position + 100 + CASE WHEN style = 4 THEN 1 ELSE 0 END - 100 AS position FROM written JOIN names USING (v) WHERE v > 0) LEFT JOIN targets USING (dataset_id, position) GROUP BY ALL""",
)
def n12(t: Facts):
    items = written(t).where("v > 0").selectExpr("dataset_id", f"{REF} AS ref", f"{POSITION} + 100 + CASE WHEN style = 4 THEN 1 ELSE 0 END AS ref_position")
    return nm.placement_summary(nm.place_on_target(items, t.targets, F.lit(100)))


@query(
    "n13_read_substitution",
    "variant:s ref:s position:i alt:s key:s",
    "SELECT DISTINCT variant, ref, position, alt, key FROM name_facts WHERE kind IN ('missense', 'nonsense', 'synonymous') AND NOT regexp_matches(variant, '^[A-Z][a-z]')",
)
def n13(t: Facts):
    s = nm.read_substitution(F.col("variant"))
    rows = settle(written(t).select("variant").distinct(), **s).where("ref IS NOT NULL")
    return rows.withColumn("key", nm.substitution_key(F.col("ref"), F.col("position"), F.col("alt")))


@query(
    "n14_n_substitutions",
    "key:s n:i",
    "SELECT DISTINCT key, CASE WHEN key IS NULL THEN -1 WHEN key = 'p.=' THEN 0 ELSE len(list_filter(string_split(replace(replace(replace(key, 'p.', ''), '[', ''), ']', ''), ';'), lambda x: NOT ends_with(x, '='))) END AS n FROM name_facts",
)
def n14(t: Facts):
    return nm.parse_variants(written(t)).select("key").distinct().withColumn("n", nm.n_substitutions(F.col("key")))


@query(
    "n10_normalise_names",
    "letters:s key:s",
    f"""SELECT DISTINCT CASE WHEN v = 0 THEN '' WHEN style % 2 = 0 THEN concat({REF}, CAST({POSITION} AS STRING), {ALT}) ELSE concat({REF}, CAST({POSITION} AS STRING), {ALT}, ' K', CAST({POSITION} + 1 AS STRING), 'L') END AS letters,
        CASE WHEN v = 0 THEN 'p.=' WHEN style % 2 = 0 THEN concat('p.', {BODY}) ELSE concat('p.[', {BODY}, ';Lys', CAST({POSITION} + 1 AS STRING), 'Leu]') END AS key FROM written""",
)
def n10(t: Facts):
    text = f"CASE WHEN v = 0 THEN '' WHEN style % 2 = 0 THEN concat({REF}, CAST({POSITION} AS STRING), {ALT}) ELSE concat({REF}, CAST({POSITION} AS STRING), {ALT}, ' K', CAST({POSITION} + 1 AS STRING), 'L') END"
    return written(t).selectExpr(f"{text} AS letters").distinct().withColumn("key", nm.normalise_names(F.col("letters"), "letters"))


# --- Nucleotide names ------------------------------------------------------------------------------

# The wild-type coding sequence: the first codon of each residue of the target.
_CODON_OF = {}
for _i, _aa in enumerate(nm.GENETIC_CODE):
    _CODON_OF.setdefault(_aa, nm.BASES[_i // 16] + nm.BASES[_i // 4 % 4] + nm.BASES[_i % 4])
WT_DNA = "".join(_CODON_OF["ARNDCQEGHILKMFPSTWYV"[(p * 7) % 20]] for p in range(1, N_POSITIONS + 1))
LENGTH = len(WT_DNA)


def _base(n: str) -> str:
    return f"substr('{WT_DNA}', CAST({n} AS INT), 1)"


def _other(n: str, k: str) -> str:
    return f"substr('ACGT', CAST((instr('ACGT', {_base(n)}) + {k}) % 4 + 1 AS INT), 1)"


_N1, _N2 = f"(l_partkey % {LENGTH} + 1)", f"(l_orderkey % {LENGTH} + 1)"
_LO, _HI = f"least({_N1}, {_N2})", f"greatest({_N1}, {_N2})"
_K1, _K2 = "(l_linenumber % 3)", "(l_suppkey % 3)"
NT_NAME = (
    f"CASE WHEN l_linenumber = 7 AND {_N1} <> {_N2} THEN concat('c.[', CAST({_LO} AS STRING), {_base(_LO)}, '>', {_other(_LO, _K1)}, ';', CAST({_HI} AS STRING), {_base(_HI)}, '>', {_other(_HI, _K2)}, ']') "
    f"ELSE concat('c.', CAST({_N1} AS STRING), {_base(_N1)}, '>', {_other(_N1, _K1)}) END"
)
SHARED_SQL["nt_names"] = f"SELECT DISTINCT {DATASET} AS dataset_id, {NT_NAME} AS variant FROM lineitem"
SHARED_SQL["nt_edits"] = """SELECT dataset_id, variant, CAST(regexp_extract(e, '^([0-9]+)', 1) AS INT) AS n, right(e, 1) AS b FROM (
    SELECT dataset_id, variant, unnest(string_split(replace(replace(substr(variant, 3), '[', ''), ']', ''), ';')) AS e FROM nt_names)"""
SHARED_SQL["nt_codons"] = f"""SELECT dataset_id, variant, k, r, substr('{nm.GENETIC_CODE}', CAST(1 + 16 * (instr('TCAG', coalesce(b1, substr(w, 1, 1))) - 1) + 4 * (instr('TCAG', coalesce(b2, substr(w, 2, 1))) - 1) + instr('TCAG', coalesce(b3, substr(w, 3, 1))) - 1 AS INT), 1) AS a FROM (
    SELECT dataset_id, variant, k, max(CASE WHEN n % 3 = 1 THEN b END) AS b1, max(CASE WHEN n % 3 = 2 THEN b END) AS b2, max(CASE WHEN n % 3 = 0 THEN b END) AS b3, substr('{WT_DNA}', CAST(3 * k - 2 AS INT), 3) AS w,
    substr('ARNDCQEGHILKMFPSTWYV', CAST(1 + (k * 7) % 20 AS INT), 1) AS r FROM (SELECT *, CAST(floor((n - 1) / 3) + 1 AS INT) AS k FROM nt_edits) GROUP BY ALL)"""
_T3 = "substr('" + THREE_LETTER + "', CAST(3 * instr('ARNDCQEGHILKMFPSTWYV*', {x}) - 2 AS INT), 3)"
SHARED_SQL["nt_changes"] = f"""SELECT dataset_id, variant, count(*) AS moved, count(*) FILTER (r <> a) AS diffs, min(CASE WHEN r <> a AND a = '*' THEN k END) AS stop,
    string_agg(concat({_T3.format(x='r')}, CAST(k AS STRING), '='), ';' ORDER BY k) AS quiet, string_agg(CASE WHEN r <> a THEN concat({_T3.format(x='r')}, CAST(k AS STRING), {_T3.format(x='a')}) END, ';' ORDER BY k) AS loud,
    min(k) AS k_all, min(CASE WHEN r <> a THEN k END) AS k_first, arg_min(r, k) AS r_all, arg_min(r, CASE WHEN r <> a THEN k END) AS r_first, arg_min(a, CASE WHEN r <> a THEN k END) AS a_first FROM nt_codons GROUP BY ALL"""
SHARED_SQL["nt_consequences"] = """SELECT dataset_id, variant, moved, CASE WHEN stop = k_first THEN least(1, diffs) ELSE diffs END AS changed, diffs > 0 AND moved > diffs AS mixed,
    CASE WHEN diffs = 0 THEN CASE WHEN moved = 1 THEN concat('p.', quiet) ELSE concat('p.[', quiet, ']') END WHEN diffs = 1 OR stop = k_first THEN concat('p.', string_split(loud, ';')[1]) ELSE concat('p.[', loud, ']') END AS pro_key,
    CASE WHEN diffs = 0 THEN 'synonymous' WHEN diffs > 1 AND coalesce(stop <> k_first, true) THEN 'multi-variant' WHEN a_first = '*' THEN 'nonsense' ELSE 'missense' END AS class, coalesce(k_first, k_all) AS position FROM nt_changes"""


def nt_names(t: Facts):
    return t.table("lineitem").selectExpr(f"{DATASET} AS dataset_id", f"{NT_NAME} AS variant").distinct()


def codons(t: Facts):
    return t.targets.selectExpr("dataset_id", "position", f"substr('{WT_DNA}', 3 * position - 2, 3) AS codon")


@query("n6_consequence_substitutions", "dataset_id:s variant:s pro_key:s class:s position:i codons_changed:i changed:i mixed:b", "SELECT *, moved AS codons_changed FROM nt_consequences")
def n6(t: Facts):
    return nm.consequence_subs(nt_names(t), codons(t))


# The target with its stop codon, so that changes reach it.
STOPPED = WT_DNA + "TAA"
_INDELS = [
    f"concat('c.', CAST({_N1} AS STRING), 'del')", f"concat('c.', CAST({_LO} AS STRING), '_', CAST({_HI} + 1 AS STRING), 'del')", f"concat('c.', CAST({_N1} AS STRING), '_', CAST({_N1} + 1 AS STRING), 'insGAT')",
    f"concat('c.', CAST({_N1} AS STRING), '_', CAST({_N1} + 2 AS STRING), 'dup')", f"concat('c.', CAST({_N1} AS STRING), '_', CAST({_N1} + 2 AS STRING), 'delinsTGATAC')", f"concat('c.', CAST({_N1} AS STRING), '_', CAST({_N1} + 5 AS STRING), 'delinsGCA')",
    f"concat('c.', CAST({_N1} AS STRING), '_', CAST({_N1} + 1 AS STRING), 'insTAAG')", f"concat('c.', CAST({_LO} AS STRING), '_', CAST({_HI} + 3 AS STRING), 'dup')",
]
INDEL = "CASE l_suppkey % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_INDELS)) + " END"
_T = "substr('" + THREE_LETTER + "', CAST(3 * instr('ARNDCQEGHILKMFPSTWYV*', {x}) - 2 AS INT), 3)"
_PROTEIN = "array_to_string(list_transform(range(0, length({x}) // 3), lambda i: substr('" + nm.GENETIC_CODE + "', CAST(1 + 16 * (instr('TCAG', substr({x}, 3 * i + 1, 1)) - 1) + 4 * (instr('TCAG', substr({x}, 3 * i + 2, 1)) - 1) + instr('TCAG', substr({x}, 3 * i + 3, 1)) - 1 AS INT), 1)), '')"
_TOSTOP = "CASE WHEN instr({x}, '*') > 0 THEN left({x}, instr({x}, '*')) ELSE {x} END"
_LETTERS3 = "array_to_string(list_transform(string_split({x}, ''), lambda c: " + _T.format(x="c") + "), '')"
_NUM = lambda i: f"concat({_T.format(x=f'substr(r, CAST({i} AS INT), 1)')}, CAST({i} AS VARCHAR))"
_SPAN = lambda i, n: f"concat({_NUM(i)}, CASE WHEN {n} > 1 THEN concat('_', {_NUM(f'({i} + {n} - 1)')}) ELSE '' END)"
SHARED_SQL["indel_names"] = f"SELECT DISTINCT {DATASET} AS dataset_id, {INDEL} AS variant FROM lineitem"
SHARED_SQL["indel_edits"] = f"""SELECT dataset_id, variant, s, e, kind, '{STOPPED}' AS dna, CASE kind WHEN 'dup' THEN concat(left('{STOPPED}', e), substr('{STOPPED}', s, e - s + 1), substr('{STOPPED}', e + 1))
    WHEN 'ins' THEN concat(left('{STOPPED}', s), bases, substr('{STOPPED}', s + 1)) ELSE concat(left('{STOPPED}', s - 1), bases, substr('{STOPPED}', e + 1)) END AS altered, CASE kind WHEN 'dup' THEN e WHEN 'ins' THEN s ELSE s - 1 END AS kept
    FROM (SELECT *, CAST(regexp_extract(variant, '^c.([0-9]+)', 1) AS INT) AS s, CAST(coalesce(nullif(regexp_extract(variant, '_([0-9]+)', 1), ''), regexp_extract(variant, '^c.([0-9]+)', 1)) AS INT) AS e,
    regexp_extract(variant, '(delins|del|dup|ins)', 1) AS kind, regexp_extract(variant, '([ACGT]*)$', 1) AS bases FROM indel_names)"""
SHARED_SQL["indel_proteins"] = f"""SELECT *, CASE WHEN (length(altered) - length(dna)) % 3 <> 0 THEN {_TOSTOP.format(x='w')} WHEN instr(substr(w, length(r)), '*') > 0 THEN left(w, length(r) - 1 + instr(substr(w, length(r)), '*')) ELSE w END AS n
    FROM (SELECT *, {_PROTEIN.format(x='altered')} AS w, {_TOSTOP.format(x=_PROTEIN.format(x='dna'))} AS r FROM indel_edits WHERE e <= length(dna))"""
SHARED_SQL["indel_middles"] = """SELECT *, substr(r, k + 1, length(r) - k - t) AS gone, CASE WHEN instr(p0, '*') > 0 THEN left(p0, instr(p0, '*')) ELSE p0 END AS put FROM (SELECT *, substr(n, k + 1, length(n) - k - t) AS p0 FROM (
    SELECT *, list_max(list_filter(range(0, least(length(r), length(n)) - k + 1), lambda i: right(r, i) = right(n, i))) AS t FROM (SELECT *, list_max(list_filter(range(0, least(length(r), length(n)) + 1), lambda i: left(r, i) = left(n, i))) AS k FROM indel_proteins)))"""


@query(
    "n7_consequence_indels",
    "dataset_id:s variant:s class:s pro_key:s position:i",
    f"""SELECT dataset_id, variant, class, CASE class WHEN 'frameshift' THEN concat('p.', {_NUM('least(k + 1, length(r))')}, 'fs') WHEN 'nonsense' THEN concat('p.', {_NUM('(k + 1)')}, 'Ter') WHEN 'stop lost' THEN concat('p.Ter', CAST(k + 1 AS VARCHAR), coalesce(nullif({_T.format(x='substr(n, CAST(k + 1 AS INT), 1)')}, ''), 'Xaa'))
        WHEN 'synonymous' THEN CASE WHEN kept // 3 >= length(r) THEN 'p.=' ELSE concat('p.', {_NUM('(kept // 3 + 1)')}, '=') END WHEN 'missense' THEN concat('p.', {_NUM('(k + 1)')}, {_T.format(x='put')}) WHEN 'deletion-insertion' THEN concat('p.', {_SPAN('(k + 1)', 'length(gone)')}, 'delins', {_LETTERS3.format(x='put')})
        WHEN 'deletion' THEN concat('p.', {_SPAN('(k + 1)', 'length(gone)')}, 'del') WHEN 'duplication' THEN concat('p.', {_SPAN('(k - length(put) + 1)', 'length(put)')}, 'dup') WHEN 'insertion' THEN concat('p.', {_NUM('k')}, '_', {_NUM('(k + 1)')}, 'ins', {_LETTERS3.format(x='put')}) END AS pro_key,
        CASE class WHEN 'frameshift' THEN least(k + 1, length(r)) WHEN 'synonymous' THEN CASE WHEN kept // 3 < length(r) THEN kept // 3 + 1 END WHEN 'duplication' THEN k - length(put) + 1 WHEN 'insertion' THEN k ELSE k + 1 END AS position FROM (
        SELECT *, CASE WHEN n = r THEN 'synonymous' WHEN n = '' THEN 'start lost' WHEN (length(altered) - length(dna)) % 3 <> 0 THEN CASE WHEN k < length(r) AND substr(n, CAST(k + 1 AS INT), 1) = '*' THEN 'nonsense' WHEN k + 1 = length(r) AND length(n) > k THEN 'stop lost' ELSE 'frameshift' END
          WHEN left(put, 1) = '*' THEN 'nonsense' WHEN k + 1 = length(r) THEN 'stop lost' WHEN length(gone) = 1 AND length(put) = 1 THEN 'missense' WHEN gone <> '' AND put <> '' THEN 'deletion-insertion'
          WHEN gone <> '' AND k + 1 + length(gone) = length(r) THEN 'nonsense' WHEN gone <> '' THEN 'deletion' WHEN k >= length(put) AND substr(r, CAST(k - length(put) + 1 AS INT), length(put)) = put THEN 'duplication' ELSE 'insertion' END AS class FROM indel_middles)
        UNION ALL SELECT dataset_id, variant, NULL, NULL, NULL FROM indel_edits WHERE e > length(dna)""",
)
def n7(t: Facts):
    names = t.table("lineitem").selectExpr(f"{DATASET} AS dataset_id", f"{INDEL} AS variant")
    return nm.consequence_indels(names, t.datasets.withColumn("sequence", F.lit(STOPPED)))


_ROWS = f"""SELECT {DATASET} AS dataset_id, l_suppkey AS row_no, concat('c.', CAST({_N1} AS STRING), {_base(_N1)}, '>', {_other(_N1, '0')}) AS variant, l_linestatus AS sample_id,
    CASE WHEN {_N1} % 2 = 0 THEN CAST({_N1} AS DOUBLE) ELSE sum(l_quantity) END AS cnt FROM lineitem GROUP BY {DATASET}, l_suppkey, l_partkey % {LENGTH} + 1, l_linestatus"""


def codon_rows(t: Facts):
    n = f"n"
    rows = t.table("lineitem").groupBy(F.expr(DATASET).alias("dataset_id"), F.col("l_suppkey").alias("row_no"), F.expr(_N1).alias("n"), F.col("l_linestatus").alias("sample_id")).agg(F.sum("l_quantity").alias("q"))
    return rows.selectExpr("dataset_id", "row_no", f"concat('c.', CAST(n AS STRING), {_base(n)}, '>', {_other(n, '0')}) AS variant", "sample_id", "CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) ELSE q END AS cnt")


SHARED_SQL["codon_rows"] = f"""SELECT dataset_id, row_no, concat('c.', CAST(n AS STRING), {_base('n')}, '>', {_other('n', '0')}) AS variant, sample_id, CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) ELSE q END AS cnt FROM (
    SELECT {DATASET} AS dataset_id, l_suppkey AS row_no, {_N1} AS n, l_linestatus AS sample_id, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"""
SHARED_SQL["codon_vectors"] = "SELECT dataset_id, variant, row_no, string_agg(concat(sample_id, ':', CAST(cnt AS STRING)), ',' ORDER BY sample_id) AS vec FROM codon_rows GROUP BY ALL"
SHARED_SQL["codon_conflicts"] = "SELECT dataset_id, variant, count(*) AS n_rows FROM codon_vectors GROUP BY ALL HAVING count(DISTINCT vec) > 1"


def codon_consequences(t: Facts):
    rows = codon_rows(t)
    return nm.combine_codons(rows, nm.consequence_subs(rows.select("dataset_id", "variant"), codons(t)))


@query(
    "n8_combine_codons",
    "dataset_id:s pro_key:s sample_id:s cnt:d n_codons:i",
    f"""WITH once AS (SELECT dataset_id, variant, sample_id, max(cnt) AS cnt FROM codon_rows WHERE (dataset_id, variant) NOT IN (SELECT (dataset_id, variant) FROM codon_conflicts) GROUP BY ALL),
        c AS (SELECT DISTINCT variant, CAST(regexp_extract(variant, '([0-9]+)', 1) AS INT) AS n, right(variant, 1) AS b FROM once),
        d AS (SELECT variant, k, substr('ARNDCQEGHILKMFPSTWYV', CAST(1 + (k * 7) % 20 AS INT), 1) AS r, CASE (n - 1) % 3 WHEN 0 THEN concat(b, substr(w, 2, 2)) WHEN 1 THEN concat(substr(w, 1, 1), b, substr(w, 3, 1)) ELSE concat(substr(w, 1, 2), b) END AS x FROM (
          SELECT *, CAST(floor((n - 1) / 3) + 1 AS INT) AS k, substr('{WT_DNA}', CAST(3 * floor((n - 1) / 3) + 1 AS INT), 3) AS w FROM c)),
        e AS (SELECT variant, k, r, substr('{nm.GENETIC_CODE}', CAST(1 + 16 * (instr('TCAG', substr(x, 1, 1)) - 1) + 4 * (instr('TCAG', substr(x, 2, 1)) - 1) + instr('TCAG', substr(x, 3, 1)) - 1 AS INT), 1) AS a FROM d),
        p AS (SELECT variant, concat('p.', {_T3.format(x='r')}, CAST(k AS STRING), CASE WHEN r = a THEN '=' ELSE {_T3.format(x='a')} END) AS pro_key FROM e)
        SELECT dataset_id, pro_key, sample_id, sum(cnt) AS cnt, count(*) AS n_codons FROM once JOIN p USING (variant) GROUP BY ALL""",
)
def n8(t: Facts):
    return codon_consequences(t)[0]


@query("n8_codon_conflicts", "dataset_id:s variant:s n_rows:i", "SELECT * FROM codon_conflicts")
def n8_conflicts(t: Facts):
    return codon_consequences(t)[1]


@query(
    "n9_names_from_sequences",
    "variant:s nt_key:s pro_key:s",
    """SELECT DISTINCT variant, variant AS nt_key, CASE WHEN diffs = 0 THEN CASE WHEN moved = 1 THEN concat('p.', quiet) ELSE concat('p.[', quiet, ']') END WHEN diffs = 1 THEN concat('p.', loud) ELSE concat('p.[', loud, ']') END AS pro_key FROM nt_changes""",
)
def n9(t: Facts):
    edits = F.split(F.regexp_replace(F.regexp_replace("variant", r"^c\.", ""), r"[\[\]]", ""), ";")
    put = lambda s, e: F.concat(F.substr(s, F.lit(1), F.regexp_extract(e, r"^(\d+)", 1).cast("int") - 1), F.right(e, F.lit(1)), F.substr(s, F.regexp_extract(e, r"^(\d+)", 1).cast("int") + 1))
    rows = nt_names(t).select("variant").distinct().withColumn("sequence", F.aggregate(edits, F.lit(WT_DNA), put))
    return nm.names_from_sequences(rows, WT_DNA)


# --- Assembly ----------------------------------------------------------------------------------------

RAW_COUNT = "l_quantity - 10 + CASE WHEN l_partkey % 10 = 3 THEN 0.5D ELSE 0D END"


@query(
    "j1_count_checks",
    "dataset_id:s sample_id:s total:d observed:i zeros:i negative:i non_integer:i problem:s",
    f"""SELECT *, CASE WHEN negative > 0 THEN 'error' WHEN non_integer > 0 OR observed = 0 THEN 'warning' END AS problem FROM (SELECT dataset_id, sample_id, sum(cnt) AS total, count(*) FILTER (cnt <> 0) AS observed, count(*) FILTER (cnt = 0) AS zeros,
        count(*) FILTER (cnt < 0) AS negative, count(*) FILTER (cnt <> floor(cnt)) AS non_integer FROM (SELECT {DATASET} AS dataset_id, l_linestatus AS sample_id, l_partkey, sum({RAW_COUNT.replace('0.5D', '0.5').replace('0D', '0')}) AS cnt FROM lineitem GROUP BY ALL) GROUP BY ALL)""",
)
def j1(t: Facts):
    rows = t.table("lineitem").groupBy(F.expr(DATASET).alias("dataset_id"), F.col("l_linestatus").alias("sample_id"), "l_partkey").agg(F.sum(F.expr(RAW_COUNT)).alias("cnt"))
    return asm.count_checks(rows)


@query(
    "j2_identical_samples",
    "dataset_id:s sample_a:s sample_b:s n:i",
    """WITH c AS (SELECT dataset_id, sample_id, variant, cnt FROM counts UNION ALL SELECT dataset_id, concat(sample_id, '_copy'), variant, cnt FROM counts WHERE replicate_id = 'r1'),
       d AS (SELECT dataset_id, sample_id, count(*) AS n, string_agg(concat(variant, ':', CAST(cnt AS STRING)), ',' ORDER BY variant) AS s FROM c GROUP BY ALL)
       SELECT a.dataset_id, a.sample_id AS sample_a, b.sample_id AS sample_b, a.n FROM d a JOIN d b ON a.dataset_id = b.dataset_id AND a.s = b.s AND a.sample_id < b.sample_id""",
)
def j2(t: Facts):
    counts = t.counts.select("dataset_id", "sample_id", "variant", "cnt")
    copy = t.counts.where("replicate_id = 'r1'").selectExpr("dataset_id", "concat(sample_id, '_copy') AS sample_id", "variant", "cnt")
    return asm.identical_samples(counts.unionByName(copy))


MAP_SQL = f"""SELECT DISTINCT {DATASET} AS dataset_id, CAST(l_partkey AS STRING) AS barcode, {VARIANT} AS variant FROM (SELECT *, {VARIANT_NO} AS v FROM lineitem) q WHERE l_partkey % 89 <> 1
    UNION ALL SELECT DISTINCT {DATASET}, CAST(l_partkey AS STRING), 'p.=' FROM lineitem WHERE l_partkey % 97 = 0 AND l_partkey % 500 <> 0"""
SHARED_SQL["map_rows"] = MAP_SQL
SHARED_SQL["barcode_mapping"] = "SELECT dataset_id, barcode, CASE WHEN count(DISTINCT variant) = 1 THEN min(variant) END AS variant, CASE WHEN count(DISTINCT variant) = 1 THEN 'mapped' ELSE 'conflict' END AS status FROM map_rows GROUP BY ALL"


def mapping(t: Facts):
    pairs = t.reads.select("dataset_id", "barcode", "partkey", "v").distinct()
    given = Facts.named(pairs.where("partkey % 89 <> 1")).select("dataset_id", "barcode", "variant")
    second = pairs.where("partkey % 97 = 0 AND v <> 0").selectExpr("dataset_id", "barcode", "'p.=' AS variant")
    return bc.barcode_map(given.unionByName(second))


@query(
    "j3_apply_barcode_map",
    "dataset_id:s barcode:s variant:s status:s cnt:d",
    "SELECT dataset_id, barcode, variant, coalesce(status, 'unmapped') AS status, cnt FROM (SELECT dataset_id, barcode, sum(cnt) AS cnt FROM reads GROUP BY ALL) LEFT JOIN barcode_mapping USING (dataset_id, barcode)",
)
def j3(t: Facts):
    return bc.apply_barcode_map(t.reads.groupBy("dataset_id", "barcode").agg(F.sum("cnt").alias("cnt")), mapping(t))


@query(
    "j3_uncounted_barcodes",
    "dataset_id:s barcode:s variant:s status:s",
    "SELECT * FROM barcode_mapping WHERE (dataset_id, barcode) NOT IN (SELECT (dataset_id, barcode) FROM reads WHERE role = 'input' AND replicate_id = 'r1')",
)
def j3_uncounted(t: Facts):
    return bc.uncounted_barcodes(t.reads.where("role = 'input' AND replicate_id = 'r1'"), mapping(t))


@query(
    "j4_barcode_problems",
    "dataset_id:s barcode:s problem:s n_rows:i",
    """WITH r AS (SELECT dataset_id, lane, CASE WHEN partkey % 61 = 0 THEN 'NA' ELSE barcode END AS barcode FROM reads)
       SELECT dataset_id, barcode, 'repeated' AS problem, count(*) AS n_rows FROM r WHERE barcode <> 'NA' GROUP BY dataset_id, barcode HAVING count(*) > 1 UNION ALL SELECT dataset_id, NULL, 'blank', count(*) FROM r WHERE barcode = 'NA' GROUP BY dataset_id""",
)
def j4(t: Facts):
    return bc.barcode_problems(t.reads.selectExpr("dataset_id", "CASE WHEN partkey % 61 = 0 THEN 'NA' ELSE barcode END AS barcode"))


def design(t: Facts):
    rows = t.datasets.selectExpr("dataset_id", "explode(array('r1', 'r2', 'r3')) AS r").selectExpr("*", "explode(array('base', 'drug')) AS condition").selectExpr("*", "explode(array('input', 'output')) AS role")
    return rows.selectExpr(
        "dataset_id", "CASE WHEN role = 'input' THEN concat(r, '_input') ELSE concat(r, '_', condition) END AS sample_id", "concat(condition, '-', r) AS replicate_id", "role", "condition",
        "CASE r WHEN 'r1' THEN 'A' WHEN 'r2' THEN 'B' END AS tile", "CAST(substr(r, 2, 1) AS INT) AS biological", "condition = 'base' AS is_reference",
    )


def tiles(t: Facts):
    return t.datasets.selectExpr("dataset_id", "stack(2, 'A', 1, 14, 'B', 12, 24) AS (tile, pos_start, pos_end)")


DESIGN_SQL = """SELECT dataset_id, CASE WHEN role = 'input' THEN concat(r, '_input') ELSE concat(r, '_', condition) END AS sample_id, concat(condition, '-', r) AS replicate_id, role, condition, CASE r WHEN 'r1' THEN 'A' WHEN 'r2' THEN 'B' END AS tile,
    CAST(substr(r, 2, 1) AS INT) AS biological, condition = 'base' AS is_reference FROM (SELECT DISTINCT dataset_id FROM targets), (VALUES ('r1'), ('r2'), ('r3')) x(r), (VALUES ('base'), ('drug')) y(condition), (VALUES ('input'), ('output')) z(role)"""
SHARED_SQL["design"] = DESIGN_SQL
SHARED_SQL["tile_of"] = "SELECT * FROM (VALUES ('A', 1, 14), ('B', 12, 24)) x(tile, pos_start, pos_end)"
SHARED_SQL["cond_counts"] = "SELECT dataset_id, variant, kind, position, CASE WHEN role = 'input' THEN concat(replicate_id, '_input') ELSE concat(replicate_id, '_', condition) END AS sample_id, sum(cnt) AS cnt FROM reads JOIN names USING (v) GROUP BY ALL"


def cond_counts(t: Facts):
    sample = F.when(F.col("role") == "input", F.concat("replicate_id", F.lit("_input"))).otherwise(F.concat_ws("_", "replicate_id", "condition"))
    sums = t.reads.groupBy("dataset_id", "v", sample.alias("sample_id")).agg(F.sum("cnt").alias("cnt"))
    return Facts.named(sums).select("dataset_id", "variant", "kind", "position", "sample_id", "cnt")


@query("j5_attach_design", "dataset_id:s variant:s sample_id:s replicate_id:s role:s cnt:d", "SELECT * FROM cond_counts JOIN design USING (dataset_id, sample_id)")
def j5(t: Facts):
    return asm.attach_design(cond_counts(t), design(t))


@query(
    "j6_shared_samples",
    "dataset_id:s sample_id:s replicate_id_a:s replicate_id_b:s within_condition:b",
    """WITH s AS (SELECT DISTINCT dataset_id, sample_id, replicate_id, condition, tile, pos_start, pos_end FROM design LEFT JOIN tile_of USING (tile))
       SELECT a.dataset_id, a.sample_id, a.replicate_id AS replicate_id_a, b.replicate_id AS replicate_id_b, a.condition = b.condition AS within_condition FROM s a JOIN s b ON a.dataset_id = b.dataset_id AND a.sample_id = b.sample_id AND a.replicate_id < b.replicate_id
       WHERE NOT coalesce(a.pos_start > b.pos_end OR b.pos_start > a.pos_end, false)""",
)
def j6(t: Facts):
    return asm.shared_samples(design(t), tiles(t))


@query(
    "j7_apply_tiles",
    "dataset_id:s variant:s replicate_id:s role:s cnt:d outside_tile:b",
    """SELECT dataset_id, variant, replicate_id, role, CASE WHEN inside THEN cnt END AS cnt, NOT inside AS outside_tile FROM (SELECT *, tile IS NULL OR position IS NULL OR position BETWEEN pos_start AND pos_end AS inside FROM cond_counts JOIN design USING (dataset_id, sample_id) LEFT JOIN tile_of USING (tile))""",
)
def j7(t: Facts):
    return asm.apply_tiles(asm.attach_design(cond_counts(t), design(t)), tiles(t))


@query(
    "j8_control_rows",
    "dataset_id:s variant:s kind:s position:i",
    "SELECT dataset_id, variant, kind, position FROM cond_score WHERE kind = 'synonymous' OR (kind = 'nonsense' AND position BETWEEN 3 AND 18)",
)
def j8(t: Facts):
    controls = t.datasets.selectExpr("dataset_id", "stack(3, 'synonymous', 'auto', NULL, NULL, 'nonsense', 'auto', 3, 18, 'wild type', 'none', NULL, NULL) AS (class, mode, pos_start, pos_end)")
    return asm.control_rows(t.cond_score, controls)


SHARED_SQL["second_scores"] = """SELECT 'D' || CAST(CAST(floor(c_custkey / 250) AS BIGINT) AS STRING) AS dataset_id, variant, kind, position, alt, avg(o_totalprice) / 98765.4321 AS score, CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / 98765.4321 / sqrt(count(*)) END AS se
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN names ON names.v = o_custkey % 500 GROUP BY ALL"""


def second_scores(t: Facts):
    joined = t.table("orders").join(t.table("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy(F.expr("concat('D', CAST(CAST(floor(c_custkey / 250) AS BIGINT) AS STRING))").alias("dataset_id"), F.expr("CAST(o_custkey % 500 AS INT)").alias("v")).agg(
        (F.avg("o_totalprice") / 98765.4321).alias("score"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("o_totalprice") / 98765.4321 / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    return Facts.named(sums).drop("v", "ref")


@query(
    "j9_match_variants",
    "dataset_id:s variant:s score_a:d se_a:d score_b:d se_b:d match:s",
    """SELECT dataset_id, variant, a.score AS score_a, a.se AS se_a, b.score AS score_b, b.se AS se_b, CASE WHEN a.x IS NULL THEN 'only b' WHEN b.x IS NULL THEN 'only a' WHEN a.score IS NULL OR b.score IS NULL THEN 'not scored' ELSE 'both' END AS match
       FROM (SELECT *, 1 AS x FROM cond_score WHERE kind <> 'wild type') a FULL JOIN (SELECT *, 1 AS x FROM second_scores WHERE kind <> 'wild type') b USING (dataset_id, variant)""",
)
def j9(t: Facts):
    return asm.match_variants(t.cond_score, second_scores(t))


@query(
    "j9_match_by_reference",
    "dataset_id:s match:s n:i",
    """SELECT dataset_id, CASE WHEN a.x IS NULL THEN 'only b' WHEN b.x IS NULL THEN 'only a' ELSE 'both' END AS match, count(*) AS n FROM (SELECT dataset_id, position + 10 AS p, alt, 1 AS x FROM cond_score WHERE position IS NOT NULL) a
       FULL JOIN (SELECT dataset_id, position + 12 AS p, alt, 1 AS x FROM second_scores WHERE position IS NOT NULL) b USING (dataset_id, p, alt) GROUP BY ALL""",
)
def j9_ref(t: Facts):
    return asm.match_counts(asm.match_by_reference(t.cond_score, second_scores(t), 10, 12))


@query(
    "j10_pair_replicates",
    "dataset_id:s condition:s replicate_id_a:s replicate_id_b:s",
    "SELECT DISTINCT dataset_id, 'drug' AS condition, replace(replicate_id, 'drug', 'base') AS replicate_id_a, replicate_id AS replicate_id_b FROM design WHERE condition = 'drug'",
)
def j10(t: Facts):
    first = design(t).where("role = 'input'").withColumnRenamed("sample_id", "first_sample")
    return asm.pair_replicates(first)


SHARED_SQL["feature_of"] = "SELECT CAST(n_nationkey AS INT) AS id, concat('site ', n_name) AS label, CASE WHEN n_regionkey < 2 THEN 'Binding' ELSE 'Domain' END AS type, CAST(1 + n_nationkey % 20 AS INT) AS pos_start, CAST(3 + n_nationkey % 20 AS INT) AS pos_end FROM nation"


def features(t: Facts):
    rows = t.table("nation").selectExpr("concat('site ', n_name) AS label", "CASE WHEN n_regionkey < 2 THEN 'Binding' ELSE 'Domain' END AS type", "CAST(1 + n_nationkey % 20 AS INT) AS pos_start", "CAST(3 + n_nationkey % 20 AS INT) AS pos_end", "'x' AS x")
    return t.datasets.withColumn("x", F.lit("x")).join(rows, "x").drop("x")


@query(
    "j11_match_controls",
    "dataset_id:s key:s found:s",
    """SELECT l.dataset_id, l.variant AS key, CASE WHEN c.variant IS NULL THEN 'not in run' WHEN c.score IS NULL THEN 'not scored' ELSE 'scored' END AS found FROM second_scores l LEFT JOIN (SELECT dataset_id, variant, CASE WHEN k >= 3 THEN score END AS score FROM cond_score) c USING (dataset_id, variant)""",
)
def j11(t: Facts):
    labels = second_scores(t).select("dataset_id", F.col("variant").alias("key"))
    return asm.match_controls(labels, t.cond_score.withColumn("score", F.when(F.col("k") >= 3, F.col("score"))))


@query(
    "j12_in_features",
    "dataset_id:s variant:s position:i",
    "SELECT dataset_id, variant, position FROM cond_score c WHERE EXISTS (SELECT 1 FROM feature_of WHERE (lower(label) LIKE 'bind%' OR lower(type) LIKE 'bind%') AND c.position BETWEEN pos_start AND pos_end)",
)
def j12(t: Facts):
    return asm.in_features(t.cond_score, features(t), "Bind*")


@query(
    "j13_annotate",
    "dataset_id:s variant:s source:s value:d features:s",
    """SELECT c.dataset_id, c.variant, s.source, s.value, f.features FROM cond_score c LEFT JOIN (SELECT dataset_id, variant, 'second' AS source, score AS value FROM second_scores) s USING (dataset_id, variant)
       LEFT JOIN (SELECT p AS position, string_agg(DISTINCT label, '; ' ORDER BY label) AS features FROM feature_of, range(1, 30) r(p) WHERE p BETWEEN pos_start AND pos_end GROUP BY ALL) f USING (position)""",
)
def j13(t: Facts):
    notes = second_scores(t).selectExpr("dataset_id", "'second' AS source", "variant AS key", "score AS value")
    return asm.annotate(t.cond_score, notes, features(t))


# A protein is a label's vectors within a run of five hundred, so none is longer than that.
PROTEIN = "concat('P', CAST(label AS STRING), '-', CAST(CAST(floor(vec_id / 500) AS BIGINT) AS STRING))"
SHARED_SQL["coords"] = f"SELECT {PROTEIN} AS dataset_id, CAST(vec_id AS BIGINT) AS position, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS rsa, CAST(embedding[5] AS DOUBLE) AS value FROM embeddings"


def coords(t: Facts):
    return t.table("embeddings").selectExpr(
        f"{PROTEIN} AS dataset_id", "vec_id AS position", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y", "CAST(embedding[2] AS DOUBLE) AS z", "CAST(embedding[3] AS DOUBLE) AS rsa", "CAST(embedding[4] AS DOUBLE) AS value"
    )


@query(
    "j14_neighbor_pairs",
    "dataset_id:s a:i b:i distance:d",
    """SELECT a.dataset_id, a.position AS a, b.position AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM coords a JOIN coords b ON a.dataset_id = b.dataset_id AND a.position < b.position
       WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0064""",
)
def j14(t: Facts):
    return asm.neighbor_pairs(coords(t), 0.08)


@query("j15_place_query", "dataset_id:s query:s shift:i overlap:i same:i",
    """WITH q AS (SELECT DISTINCT concat('D', CAST(CAST(floor(l_suppkey / 25) AS BIGINT) AS STRING)) AS dataset_id, l_partkey % 12 AS i FROM lineitem), p AS (SELECT dataset_id, string_agg(ref_aa, '' ORDER BY position) AS s FROM targets GROUP BY ALL)
       SELECT dataset_id, substr(s, CAST(i + 1 AS INT), 12) AS query, i AS shift, 12 AS overlap, 12 AS same FROM q JOIN p USING (dataset_id)""")
def j15(t: Facts):
    proteins = t.targets.groupBy("dataset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "ref_aa"))), lambda x: x["ref_aa"]), "").alias("protein"))
    starts = t.table("lineitem").selectExpr(f"{DATASET} AS dataset_id", "CAST(l_partkey % 12 AS INT) AS i").distinct()
    queries = starts.join(proteins, "dataset_id").select("dataset_id", F.substr("protein", F.col("i") + 1, F.lit(12)).alias("query"))
    return asm.place_query(queries, proteins)


# --- Sources and sinks -------------------------------------------------------------------------------

SAMPLES = [f"r{r}_{role}" for r in (1, 2, 3) for role in ("input", "output")]
_WIDE = "SELECT dataset_id, variant, " + ", ".join(f"max(CASE WHEN sample_id = '{s}' THEN cnt END) AS {s}" for s in SAMPLES) + " FROM counts GROUP BY ALL"
SHARED_SQL["wide_counts"] = _WIDE


def wide(t: Facts):
    return wr.counts_table(t.counts, SAMPLES).withColumnRenamed("hgvs_pro", "variant")


@query("s4_melt_counts", "dataset_id:s variant:s sample_id:s cnt:d", "SELECT dataset_id, variant, sample_id, cnt FROM counts")
def s4(t: Facts):
    return rd.melt_counts(wide(t), ["dataset_id", "variant"], SAMPLES)


@query(
    "s1_typed_cells",
    "dataset_id:s variant:s cell:s value:d",
    "SELECT dataset_id, variant, cell, CASE WHEN trim(cell) IN ('', 'NA', 'N/A', 'NaN', 'nan', 'null', 'NULL', 'None') THEN NULL ELSE try_cast(trim(cell) AS DOUBLE) END AS value FROM (SELECT dataset_id, variant, CASE WHEN cnt = 0 THEN 'NA' WHEN cnt < 20 THEN 'x' ELSE concat(' ', CAST(CAST(cnt AS BIGINT) AS STRING)) END AS cell FROM counts)",
)
def s1(t: Facts):
    cells = t.counts.selectExpr("dataset_id", "variant", "CASE WHEN cnt = 0 THEN 'NA' WHEN cnt < 20 THEN 'x' ELSE concat(' ', CAST(CAST(cnt AS BIGINT) AS STRING)) END AS cell")
    return rd.typed(cells.withColumn("value", F.col("cell")), ["value"])


@query("s2_variant_column_shares", "column:s share:d level:s")
def s2(t: Facts):
    table = written(t).selectExpr("variant", "concat('b', CAST(v AS STRING)) AS barcode")
    return rd.variant_shares(table, ["variant", "barcode"])


@query(
    "s3_suggest_roles",
    "sample:s role:s time:d bin:i replicate:i",
    """SELECT DISTINCT sample, CASE WHEN l = 'N' THEN 'timepoint' WHEN l = 'R' THEN 'bin' WHEN s = 'O' THEN 'input' ELSE 'output' END AS role, CASE WHEN l = 'N' THEN n WHEN l = 'A' AND s = 'O' THEN 0 END AS time, CASE WHEN l = 'R' THEN n END AS bin, n AS replicate FROM (
       SELECT l_returnflag AS l, l_linestatus AS s, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN concat('rep', CAST(l_linenumber AS STRING), CASE WHEN l_linestatus = 'O' THEN '_input' ELSE '_selected' END) WHEN 'N' THEN concat('rep', CAST(l_linenumber AS STRING), '_day', CAST(l_linenumber AS STRING))
       ELSE concat('rep', CAST(l_linenumber AS STRING), '_bin', CAST(l_linenumber AS STRING)) END AS sample FROM lineitem)""",
)
def s3(t: Facts):
    n = "CAST(l_linenumber AS STRING)"
    samples = t.table("lineitem").selectExpr(f"CASE l_returnflag WHEN 'A' THEN concat('rep', {n}, CASE WHEN l_linestatus = 'O' THEN '_input' ELSE '_selected' END) WHEN 'N' THEN concat('rep', {n}, '_day', {n}) ELSE concat('rep', {n}, '_bin', {n}) END AS sample").distinct()
    return rd.suggest_roles(samples)


@query(
    "s5_design_from_sheet",
    "dataset_id:s source_column:s role:s condition:s biological:i",
    """SELECT d.dataset_id, x.source_column, x.role, x.condition, x.biological FROM (SELECT DISTINCT dataset_id FROM targets) d, (VALUES ('in_base', 'input', 'base', 1), ('in_base', 'input', 'base', 2), ('in_drug', 'input', 'drug', 1), ('in_drug', 'input', 'drug', 2),
       ('out1', 'output', 'base', 1), ('out1', 'output', 'drug', 1), ('out2b', 'output', 'base', 2), ('out2d', 'output', 'drug', 2)) x(source_column, role, condition, biological)""",
)
def s5(t: Facts):
    rows = "'in_base', 'pre', '1;2', 'base', 'in_drug', 'Library', '', 'drug', 'out1', 'post', '1', 'base;drug', 'out2b', 'selected', '2', 'base', 'out2d', 'out', '2', 'drug'"
    sheet = t.datasets.selectExpr("dataset_id", f"stack(5, {rows}) AS (`sample name`, type, rep, treatment)")
    return rd.design_from_sheet(sheet)


@query("s6_join_samples", "dataset_id:s variant:s " + " ".join(f"{s}:d" for s in SAMPLES), "SELECT dataset_id, variant, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in SAMPLES) + " FROM wide_counts")
def s6(t: Facts):
    return rd.join_samples(t.counts, absent="zero", samples=SAMPLES)[0]


@query(
    "s6_duplicates_in_file",
    "dataset_id:s sample_id:s variant:s n_rows:i",
    "SELECT dataset_id, concat(replicate_id, '_', role) AS sample_id, variant, count(*) AS n_rows FROM (SELECT dataset_id, v, replicate_id, role, lane FROM lane_counts) JOIN names USING (v) GROUP BY ALL HAVING count(*) > 1",
)
def s6_dup(t: Facts):
    lanes = Facts.named(t.reads.groupBy("dataset_id", "v", "replicate_id", "role", "lane").agg(F.sum("cnt").alias("cnt"))).withColumn("sample_id", F.concat_ws("_", "replicate_id", "role"))
    return rd.join_samples(lanes, samples=SAMPLES)[1]


@query(
    "s7_pivot_variant_counts",
    "dataset_id:s library:s barcode_id:s substitutions:s pre:d",
    """WITH r AS (SELECT dataset_id, replicate_id AS library, barcode, variant, sum(CASE WHEN role = 'input' THEN cnt END) AS pre FROM reads JOIN names USING (v) GROUP BY ALL)
       SELECT dataset_id, library, CASE WHEN count(*) OVER (PARTITION BY dataset_id, barcode) > 1 THEN concat(library, '/', barcode) ELSE barcode END AS barcode_id, variant AS substitutions, pre FROM r""",
)
def s7(t: Facts):
    sums = Facts.named(t.reads.groupBy("dataset_id", "replicate_id", "barcode", "v", "role").agg(F.sum("cnt").alias("count")))
    rows = sums.selectExpr("dataset_id", "replicate_id AS library", "role AS sample", "barcode", "variant AS substitutions", "count")
    libs = [f"{role} (r{r})" for r in (1, 2, 3) for role in ("input", "output")]
    wide_, _ = rd.pivot_variant_counts(rows, libs)
    return wide_.withColumn("pre", F.coalesce(*[F.when(F.col("library") == f"r{r}", F.col(f"`input (r{r})`")) for r in (1, 2, 3)]))


@query("s8_read_published", "dataset_id:s variant:s score:d se:d ci_low:d ci_high:d", "SELECT dataset_id, variant, score, se, score - 2 * se AS ci_low, score + 2 * se AS ci_high FROM cond_score")
def s8(t: Facts):
    table = t.cond_score.selectExpr("dataset_id", "variant AS hgvs_pro", "0.0 AS sd", "score AS fitness", "se AS std_err", "score - 2 * se AS lower_ci", "score + 2 * se AS upper_ci")
    return rd.read_published(table, "hgvs_pro")


@query(
    "s9_read_features",
    "type:s pos_start:i pos_end:i label:s",
    "SELECT type, pos_start, pos_end, label FROM feature_of",
)
def s9(t: Facts):
    lines = t.table("nation").selectExpr("concat_ws('\t', 'P1', 'src', CASE WHEN n_regionkey < 2 THEN 'Binding' ELSE 'Domain' END, CAST(1 + n_nationkey % 20 AS STRING), CAST(3 + n_nationkey % 20 AS STRING), '.', '.', '.', concat('ID=f', CAST(n_nationkey AS STRING), ';Note=site%20', n_name)) AS value")
    return rd.read_features(lines)


@query(
    "s10_read_position_values",
    "dataset_id:s track:s position:i value:d",
    f"""WITH p AS (SELECT dataset_id, position + 105 AS rp, avg(score) AS mean_score, avg(se) AS mean_se FROM cond_score WHERE position IS NOT NULL GROUP BY ALL)
        SELECT dataset_id, 'mean_score' AS track, rp - 107 AS position, mean_score AS value FROM p WHERE rp - 107 BETWEEN 1 AND {N_POSITIONS} UNION ALL SELECT dataset_id, 'mean_se', rp - 107, mean_se FROM p WHERE rp - 107 BETWEEN 1 AND {N_POSITIONS}""",
)
def s10(t: Facts):
    table = t.cond_score.where("position IS NOT NULL").groupBy("dataset_id", (F.col("position") + 105).alias("ref_position")).agg(F.avg("score").alias("mean_score"), F.avg("se").alias("mean_se"))
    return rd.read_position_values(table, "ref_position", ["mean_score", "mean_se"], t.datasets.withColumn("length", F.lit(N_POSITIONS)), 107)


@query(
    "s11_read_annotations",
    "dataset_id:s key:s ref:s position:i alt:s value:d",
    f"SELECT dataset_id, variant AS key, {REF} AS ref, {POSITION} AS position, {ALT} AS alt, score AS value FROM second_scores JOIN (SELECT v, variant FROM names) USING (variant) WHERE v > 0",
)
def s11(t: Facts):
    table = second_scores(t).select("dataset_id", "variant", F.col("score").cast("string").alias("value"))
    return rd.read_annotations(table, "variants")


@query(
    "s11_read_matrix",
    "dataset_id:s key:s position:i value:d",
    "SELECT dataset_id, variant AS key, position, score AS value FROM cond_score JOIN names USING (variant, position, alt) WHERE position IN (1, 2, 3)",
)
def s11_matrix(t: Facts):
    refs = ["ARNDCQEGHILKMFPSTWYV"[(p * 7) % 20] for p in (1, 2, 3)]
    table = t.cond_score.where("position IN (1, 2, 3)").groupBy("dataset_id", F.col("alt").alias("residue")).agg(*[F.max(F.when(F.col("position") == p, F.col("score"))).alias(f"{r}{p}") for p, r in zip((1, 2, 3), refs)])
    return rd.read_matrix(table, "residue")


@query("s12_read_profile_json", "dataset_id:s ref_position:i residue:s p:d")
def s12(t: Facts):
    freq = t.cond_score.where("alt IS NOT NULL AND alt <> '*'").groupBy("dataset_id", "position", "alt").agg(F.count(F.lit(1)).alias("n"))
    cols = [F.collect_list(F.when(F.col("alt") == a, 1.0).otherwise(0.0)).alias(f"probability_{a}") for a in rd.PROFILE_LETTERS]
    doc = freq.groupBy("dataset_id").agg(F.collect_list("position").alias("index"), *cols)
    body = F.struct("index", *[f"probability_{a}" for a in rd.PROFILE_LETTERS])
    return rd.read_profile_json(doc.select("dataset_id", F.to_json(F.struct(body.alias("data"))).alias("value")))


@query("s12_read_feature_json", "dataset_id:s type:s pos_start:i pos_end:i label:s", "SELECT DISTINCT dataset_id, type, pos_start, pos_end, label FROM feature_of, (SELECT dataset_id FROM targets)")
def s12_features(t: Facts):
    at = lambda c: F.struct(F.col(c).alias("value"))
    f = F.struct("type", F.col("label").alias("description"), F.struct(at("pos_start").alias("start"), at("pos_end").alias("end")).alias("location"))
    doc = features(t).groupBy("dataset_id").agg(F.collect_list(f).alias("features"))
    return rd.read_feature_json(doc.select("dataset_id", F.to_json(F.struct("features")).alias("value")))


def exported(t: Facts):
    from assaylake.plans.scoring import slice0_scores

    return slice0_scores(t)


REPS = ["r1", "r2", "r3"]


@query(
    "s13_scores_table",
    "dataset_id:s hgvs_pro:s score:d SE:d ci95_lower:d ci95_upper:d replicates:i replicates_expected:i status:s flags:s score_r1:d SE_r1:d score_r3:d",
    """WITH r AS (SELECT dataset_id, variant, max(CASE WHEN replicate_id = 'r1' THEN score END) AS score_r1, max(CASE WHEN replicate_id = 'r1' THEN se END) AS SE_r1, max(CASE WHEN replicate_id = 'r3' THEN score END) AS score_r3, count(*) FILTER (state = 'used') AS k, count(*) AS e,
         count(*) FILTER (state <> 'not counted') AS c, max(CASE WHEN state = 'used' AND ct = 0 THEN 1 ELSE 0 END) AS f1 FROM rep_score GROUP BY ALL)
       SELECT dataset_id, variant AS hgvs_pro, CASE WHEN r.k >= 2 THEN score END AS score, CASE WHEN r.k >= 2 THEN se END AS SE, CASE WHEN r.k >= 2 THEN score - 1.959963984540054 * se END AS ci95_lower, CASE WHEN r.k >= 2 THEN score + 1.959963984540054 * se END AS ci95_upper,
         r.k AS replicates, e AS replicates_expected, CASE WHEN c = 0 THEN 'not measured' WHEN r.k = 0 THEN 'filtered: input-count' WHEN r.k < 2 THEN 'filtered: replicates' WHEN f1 = 1 OR r.k < e THEN 'low confidence' ELSE 'scored' END AS status,
         CASE WHEN r.k >= 2 THEN concat_ws('; ', CASE WHEN f1 = 1 THEN 'no reads after selection in a replicate: the score rests on the pseudocount' END, CASE WHEN r.k < e THEN 'scored in fewer replicates than the design has' END) ELSE '' END AS flags, score_r1, SE_r1, score_r3
       FROM r LEFT JOIN (SELECT dataset_id, variant, score, se FROM cond_score) USING (dataset_id, variant)""",
)
def s13(t: Facts):
    return wr.scores_table(exported(t), t.rep_score, REPS)


@query("s14_counts_table", "dataset_id:s hgvs_pro:s " + " ".join(f"{s}:d" for s in SAMPLES), "SELECT variant AS hgvs_pro, * FROM wide_counts")
def s14(t: Facts):
    return wr.counts_table(t.counts, SAMPLES)


@query(
    "s14_qc_variants_table",
    "dataset_id:s hgvs_pro:s before_r1:d after_r1:d used_r1:s used_r2:s",
    """SELECT dataset_id, variant AS hgvs_pro, max(CASE WHEN replicate_id = 'r1' THEN c0 END) AS before_r1, max(CASE WHEN replicate_id = 'r1' THEN ct END) AS after_r1, max(CASE WHEN replicate_id = 'r1' THEN CASE WHEN state = 'used' THEN 'yes' ELSE state END END) AS used_r1,
       max(CASE WHEN replicate_id = 'r2' THEN CASE WHEN state = 'used' THEN 'yes' ELSE state END END) AS used_r2 FROM rep_score GROUP BY ALL""",
)
def s14_qc(t: Facts):
    return wr.qc_variants_table(t.rep_score, REPS)


@query(
    "s14_barcodes_table",
    "dataset_id:s barcode:s hgvs_pro:s before_r1:d after_r1:d used_r1:s",
    """SELECT dataset_id, barcode, variant AS hgvs_pro, max(c0) FILTER (replicate_id = 'r1') AS before_r1, max(ct) FILTER (replicate_id = 'r1') AS after_r1,
       max(CASE WHEN c0 IS NULL OR ct IS NULL THEN 'not counted' WHEN c0 < 1 THEN 'input count' ELSE 'yes' END) FILTER (replicate_id = 'r1') AS used_r1 FROM barcode_pairs GROUP BY ALL""",
)
def s14_barcodes(t: Facts):
    from assaylake.plans.scoring import barcode_scores

    return wr.barcodes_table(barcode_scores(t).withColumn("z", F.lit(None).cast("double")).withColumn("outlier", F.lit(False)), REPS)


@query(
    "s14_selection_table",
    "dataset_id:s hgvs_pro:s score:d SE:d status:s",
    """SELECT l.dataset_id, l.variant AS hgvs_pro, CASE WHEN k >= 2 THEN score END AS score, CASE WHEN k >= 2 THEN se END AS SE, CASE WHEN r.variant IS NULL THEN 'not in the table' WHEN c = 0 THEN 'not measured' WHEN k = 0 THEN 'filtered: input-count' WHEN k < 2 THEN 'filtered: replicates' WHEN f1 = 1 OR k < e THEN 'low confidence' ELSE 'scored' END AS status
       FROM (SELECT dataset_id, variant FROM second_scores) l LEFT JOIN (SELECT dataset_id, variant, count(*) FILTER (state = 'used') AS k, count(*) AS e, count(*) FILTER (state <> 'not counted') AS c, max(CASE WHEN state = 'used' AND ct = 0 THEN 1 ELSE 0 END) AS f1 FROM rep_score GROUP BY ALL) r USING (dataset_id, variant)
       LEFT JOIN (SELECT dataset_id, variant, score, se FROM cond_score) s USING (dataset_id, variant)""",
)
def s14_selection(t: Facts):
    return wr.selection_table(second_scores(t).select("dataset_id", F.col("variant").alias("key")), exported(t))


@query(
    "s15_deposit_columns",
    "dataset_id:s column_name:s n_values:i",
    "SELECT dataset_id, 'score' AS column_name, count(score) AS n_values FROM cond_score GROUP BY ALL UNION ALL SELECT dataset_id, 'se', count(se) FROM cond_score GROUP BY ALL UNION ALL SELECT dataset_id, 'notes', 0 FROM cond_score GROUP BY ALL",
)
def s15(t: Facts):
    table = t.cond_score.selectExpr("dataset_id", "variant", "score", "se", "CAST(NULL AS STRING) AS notes")
    return wr.deposit_table(table, "variant")[1].withColumnRenamed("column", "column_name")
