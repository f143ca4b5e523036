"""Variant names: read, classified, checked against targets, translated, written from sequences.

Names repeat in every sample and dataset, so each distinct name is read once and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.expressions import settle
from assaylake.functions.lineage import cut, spread
from assaylake.operators.qc import BASES, GENETIC_CODE, translated

# Residues in map order, one letter and three; names that mean none or the wild type.
ONE = "ARNDCQEGHILKMFPSTWYV*"
THREE = ["Ala", "Arg", "Asn", "Asp", "Cys", "Gln", "Glu", "Gly", "His", "Ile", "Leu", "Lys", "Met", "Phe", "Pro", "Ser", "Thr", "Trp", "Tyr", "Val", "Ter"]
BLANK = ("", "NA", "N/A", "NaN", "null", "None")
WILD_TYPE_WORDS = ("_wt", "wt", "WT", "wild-type", "wildtype")
AA3 = "(?:" + "|".join(THREE) + ")"
POS = "[1-9][0-9]*"
ONE_LETTER = r"^([ACDEFGHIKLMNPQRSTVWY*])([1-9][0-9]*)([ACDEFGHIKLMNPQRSTVWY*=])$"
NT_POS = r"(?:[-*]?[1-9][0-9]*(?:[+-][1-9][0-9]*)?)"
PROTEIN_FORMS = [
    f"{AA3}{POS}{AA3}", f"{AA3}{POS}fs", rf"{AA3}{POS}(?:_{AA3}{POS})?(?:del|dup|=)", f"{AA3}{POS}_{AA3}{POS}ins{AA3}+", f"{AA3}{POS}(?:_{AA3}{POS})?delins{AA3}+",
]
NT_FORMS = [f"{NT_POS}[ACGT]>[ACGT]", f"{NT_POS}(?:_{NT_POS})?(?:del|dup|=)", f"{NT_POS}_{NT_POS}ins[ACGT]+", f"{NT_POS}(?:_{NT_POS})?delins[ACGT]+"]


def three_of(one: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in THREE]), F.nullif(F.instr(F.lit(ONE), one), F.lit(0)))


def one_of(three: Column) -> Column:
    at = F.instr(F.lit("".join(THREE)), three)
    return F.when((at > 0) & (F.length(three) == 3) & (at % 3 == 1), F.lit(ONE).substr(((at - 1) / 3 + 1).cast("int"), F.lit(1)))


def _first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"([1-9][0-9]*)", 1).try_cast("int")


HEAD = r"^(?:[A-Za-z0-9_.-]+:)?[cgmnopr]\."


def _in_three(letters: Column) -> Column:
    """A one-letter substitution (residue, position, residue or =) in three letters."""
    side = lambda group: F.regexp_extract(letters, ONE_LETTER, group)
    return F.concat(three_of(side(1)), side(2), F.when(side(3) == "=", "=").otherwise(three_of(side(3))))


def _read(text: Column, default_prefix: str) -> tuple[Column, Column]:
    """Head (target and prefix, empty where there is none) and components of a name in any accepted form.

    Accepted are words for the wild type, predictions in parentheses, residues in one letter, alone or several, and a three-letter
    substitution without its prefix. Of several components equal ones count once and bare equalities not; they are ordered by position.
    """
    word = F.when(text.isin(*WILD_TYPE_WORDS), F.lit(f"{default_prefix}.=")).when(text == "_sy", F.lit("p.(=)")).otherwise(text)
    written = F.regexp_extract(word, HEAD, 0)
    tail = F.substring(word, F.length(written) + 1, F.length(word))
    predicted = (written != "") & tail.rlike(r"^\(.+\)$") & (tail != "(=)")
    body = F.when(predicted, F.regexp_extract(tail, r"^\((.+)\)$", 1)).otherwise(tail)
    letters = F.filter(F.split(F.regexp_replace(body, r"^\[|\]$", ""), r"[\s;]+"), lambda x: x != "")
    by_letters = written.isin("", "p.") & (F.size(letters) > 0) & F.forall(letters, lambda x: x.rlike(ONE_LETTER) & ~x.startswith("*"))
    in_names = (written == "") & body.rlike(f"^{AA3}{POS}(?:{AA3}|=)$")
    head = F.when(by_letters | in_names, "p.").otherwise(written)
    given = F.when(head == "", F.array(F.lit(""))).otherwise(F.split(F.regexp_replace(body, r"^\[(.*)\]$", "$1"), ";"))
    spelled = F.when(by_letters, F.transform(letters, _in_three)).otherwise(F.transform(given, lambda x: F.regexp_replace(x, r"([A-Z][a-z]{2}[1-9][0-9]*)\*", "$1Ter")))
    different = F.array_distinct(spelled)
    telling = F.filter(different, lambda x: ~x.isin("=", "(=)"))
    kept = F.when(F.size(different) == 1, different).when(F.size(telling) == 0, F.array(F.lit("="))).otherwise(telling)
    placed = F.transform(
        kept,
        lambda x, i: F.struct(F.coalesce(_first_number(x), F.lit(0)).alias("at"), i.alias("i"), F.regexp_replace(x, r"^([A-Z][a-z]{2})([1-9][0-9]*)\1$", r"$1$2=").alias("text")),
    )
    return head, F.transform(F.array_sort(placed), lambda x: x["text"])


def parse_variants(names: DataFrame, column: str = "variant", default_prefix: str = "p") -> DataFrame:
    """Distinct names with ``key, prefix, target, parts, n_parts, kind, position, ref, alt, status``.

    ``status``: valid, read leniently, or invalid (then ``key`` is NULL).
    """
    distinct = names.select(F.col(column).alias("variant")).distinct()
    text = F.trim(F.col("variant"))
    head, parts = _read(text, default_prefix)
    df = settle(distinct, __head=head, parts=parts)
    df = settle(df, prefix=F.nullif(F.regexp_extract("__head", r"([cgmnopr])\.$", 1), F.lit("")), target=F.nullif(F.regexp_extract("__head", r"^(.+):", 1), F.lit("")))
    number = lambda p: F.regexp_extract_all(p, F.lit(r"([1-9][0-9]*)"), 1)
    ends = F.transform("parts", lambda p: F.array_max(F.transform(number(F.regexp_replace(p, r"(ins|delins).*$", "")), lambda d: d.try_cast("int"))))
    df = settle(df, n_parts=F.size("parts"), starts=F.transform("parts", _first_number), ends=ends)
    is_p = F.col("prefix") == "p"
    form = lambda p, forms: p.rlike("^(?:" + "|".join(forms) + ")$") | p.isin("=")
    well_formed = F.when(is_p, F.forall("parts", lambda p: form(p, PROTEIN_FORMS) | p.isin("(=)"))).otherwise(F.forall("parts", lambda p: form(p, NT_FORMS)))
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_parts") - 2)), lambda i: i < F.col("n_parts") - 1)
    apart = F.forall(pairs, lambda i: F.get("starts", i + 1) > F.get("ends", i))
    shifts = F.size(F.filter("parts", lambda p: p.endswith("fs")))
    last_shift = F.element_at("parts", -1).endswith("fs")
    consistent = (F.col("n_parts") == 1) | (apart & ((shifts == 0) | ((shifts == 1) & last_shift)))
    ok = F.col("prefix").isNotNull() & ~F.coalesce(text.isin(*BLANK), F.lit(True)) & F.coalesce(well_formed & consistent, F.lit(False))
    joined = F.when(F.col("n_parts") > 1, F.concat(F.lit("["), F.array_join("parts", ";"), F.lit("]"))).otherwise(F.get("parts", F.lit(0)))
    key = F.concat(F.coalesce(F.concat("target", F.lit(":")), F.lit("")), F.col("prefix"), F.lit("."), joined)
    df = settle(df, key=F.when(ok, key))
    status = F.when(F.col("key").isNull(), "invalid").when(F.col("key") == F.col("variant"), "valid").otherwise("read leniently")
    first = F.get("parts", F.lit(0))
    sub = rf"^({AA3})({POS})({AA3}|=)$"
    single = (F.col("n_parts") == 1) & (F.col("prefix") == "p") & F.col("key").isNotNull()
    ref3, alt3 = F.regexp_extract(first, sub, 1), F.regexp_extract(first, sub, 3)
    df = settle(
        df, status=status, position=F.when(F.col("key").isNotNull(), F.get("starts", F.lit(0))), ref=F.when(single, one_of(ref3)),
        alt=F.when(single, one_of(F.when(alt3 == "=", ref3).otherwise(alt3))),
    )
    return settle(df, kind=F.when(F.col("key").isNotNull(), variant_kind())).drop("__head", "starts", "ends")


def variant_kind() -> Column:
    """The class of a parsed name, from ``prefix, parts, n_parts, ref, alt, position``."""
    first = F.get("parts", F.lit(0))
    is_p = F.col("prefix") == "p"
    numbers = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit(rf"({NT_POS})(?=[_ACGTdi=]|$)"), 1)))
    offsets = F.filter(numbers, lambda x: x.rlike(r"[0-9][+-][0-9]"))
    near = F.exists(offsets, lambda x: F.regexp_extract(x, r"[+-]([0-9]+)$", 1).try_cast("int") <= 2)
    some_exonic = F.size(offsets) < F.size(numbers)
    nt = (
        F.when((F.size(offsets) > 0) & (near | some_exonic), "splice site")
        .when(F.size(offsets) > 0, "intronic")
        .when((F.col("prefix") == "c") & (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.startswith("-")), "5' UTR")
        .when((F.col("prefix") == "c") & (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.startswith("*")), "3' UTR")
    )
    return _kind(is_p, nt, first)


def _kind(is_p: Column, nt: Column, first: Column) -> Column:
    return F.coalesce(
        F.when(~is_p, nt),
        F.when(F.col("n_parts") > 1, "multi-variant")
        .when(first == "(=)", "synonymous")
        .when(first.endswith("=") & is_p & (first != "="), "synonymous")
        .when(first.endswith("="), "wild type")
        .when(first.endswith("del"), "deletion")
        .when(first.contains("delins"), "deletion-insertion")
        .when(first.contains("ins"), "insertion")
        .when(first.endswith("dup"), "duplication")
        .when(first.endswith("fs"), "frameshift")
        .when(~is_p & first.contains(">"), "nucleotide substitution")
        .when(~is_p, "other")
        .when(F.col("alt") == "*", "nonsense")
        .when(F.col("ref") == "*", "stop lost")
        .when((F.col("position") == 1) & (F.col("ref") == "M"), "start lost")
        .otherwise("missense"),
    )


def same_variant_key(key: Column) -> Column:
    """The key under which two names are one variant: p.Ala12Ala is p.Ala12=."""
    return F.regexp_replace(key, r"^(p\.)([A-Z][a-z]{2})([1-9][0-9]*)\2$", "$1$2$3=")


def duplicate_variants(rows: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Keys written on more than one row of a dataset's table: ``key, n_rows``."""
    keyed = rows.where("key IS NOT NULL").withColumn("key", same_variant_key(F.col("key")))
    return keyed.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_target(variants: DataFrame, target_pos: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Parsed protein variants against the target: a wrong residue or a position beyond it is invalid."""
    length = target_pos.groupBy(*by).agg(F.max("position").alias("__len"))
    here = target_pos.select(*by, "position", "ref_aa")
    out = variants.join(length, list(by)).join(here, [*by, "position"], "left")
    message = (
        F.when(F.col("status") == "invalid", "not a variant name")
        .when(F.col("position") > F.col("__len"), F.concat(F.lit("position "), F.col("position"), F.lit(" is beyond the target")))
        .when(F.col("ref").isNotNull() & (F.col("ref") != F.col("ref_aa")), F.concat(F.lit("the target has "), three_of(F.col("ref_aa")), F.lit(" at "), F.col("position")))
    )
    return out.withColumn("message", message).withColumn("status", F.when(F.col("message").isNotNull(), "invalid").otherwise(F.col("status"))).drop("__len", "ref_aa")


def other_target(variants: DataFrame, labels: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Names whose prefix is none of their dataset's target labels: ``labels(dataset_id, label)``."""
    prefixed = variants.where("target IS NOT NULL")
    return prefixed.join(labels.withColumnRenamed("label", "target"), [*by, "target"], "left_anti")


def summarize_variants(variants: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Names by status and class, with the range of their positions."""
    return variants.groupBy(*by, "status", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def read_substitution(text: Column) -> dict[str, Column]:
    """A single protein substitution in any written form: columns ref, position, alt (one letter)."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z0-9_.]+:(?=p\.)", ""), r"^p\.\((.*)\)$", "p.$1")
    long, short = r"^p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|=|\*)$", r"^(?:p\.)?([ACDEFGHIKLMNPQRSTVWY])(\d+)([ACDEFGHIKLMNPQRSTVWY*X]|=)$"
    is_long = s.rlike(long)
    ref = F.when(is_long, one_of(F.regexp_extract(s, long, 1))).when(s.rlike(short), F.regexp_extract(s, short, 1))
    raw = F.when(is_long, F.regexp_extract(s, long, 3)).when(s.rlike(short), F.regexp_extract(s, short, 3))
    alt = F.when(raw == "=", ref).when(raw.isin("*", "X"), "*").when(is_long, one_of(raw)).otherwise(raw)
    position = F.when(is_long, F.regexp_extract(s, long, 2)).when(s.rlike(short), F.regexp_extract(s, short, 2)).try_cast("int")
    ok = ref.isNotNull() & alt.isNotNull()
    return {"ref": F.when(ok, ref), "position": F.when(ok, position), "alt": F.when(ok, alt)}


def substitution_key(ref: Column, position: Column, alt: Column) -> Column:
    """p.Ala12Val, p.Ala12Ter or p.Ala12= of a substitution."""
    return F.concat(F.lit("p."), three_of(ref), position.cast("string"), F.when(ref == alt, "=").otherwise(three_of(alt)))


def n_substitutions(key: Column) -> Column:
    """Substitutions in a key: 0 for the wild type, synonymous protein changes not counted, −1 without one."""
    body = F.regexp_replace(F.regexp_replace(key, r"^[a-z]\.", ""), r"^\[(.*)\]$", "$1")
    changed = F.filter(F.split(body, ";"), lambda p: ~(key.startswith("p.") & p.endswith("=")))
    return F.when(key.isNull() | (key == ""), -1).when(key.isin("p.=", "c.=", "p.(=)"), 0).otherwise(F.size(changed))


def normalise_names(text: Column, style: str) -> Column:
    """Other tools' names in canonical form: 'letters' ("A2V K3*"), 'codons' ("GCT2GCC"), 'listed' ("p.Thr11Ala, p.Val14Leu")."""
    if style == "letters":
        pat = r"^([A-Z*])([1-9]\d*)([A-Z*])$"
        parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
        one = lambda t, i: F.regexp_extract(t, pat, i)
        named = F.transform(parts, lambda t: F.concat(three_of(one(t, 1)), one(t, 2), F.when(one(t, 1) == one(t, 3), "=").otherwise(three_of(one(t, 3)))))
        readable = F.forall(parts, lambda t: t.rlike(pat))
    elif style == "codons":
        pat = r"^([ACGT]{3})([1-9]\d*)([ACGT]{3})$"
        parts = F.filter(F.split(F.upper(F.trim(text)), r"\s+"), lambda t: t != "")
        named = F.transform(parts, lambda t: F.concat(three_of(translated(F.regexp_extract(t, pat, 1))), F.regexp_extract(t, pat, 2), F.lit("=")))
        readable = F.forall(parts, lambda t: t.rlike(pat))
    elif style == "listed":
        pat = r"^p\.([A-Z][a-z]{2}-?\d+[A-Z][a-z]{2})$"
        parts = F.split(F.trim(text), ", ")
        named = F.transform(parts, lambda t: F.regexp_replace(F.regexp_extract(t, pat, 1), r"^([A-Z][a-z]{2})(\d+)\1$", "$1$2="))
        readable = F.forall(parts, lambda t: t.rlike(pat))
    else:
        raise ValueError(f"unknown style {style!r}")
    complete = readable & F.forall(named, lambda x: x.isNotNull())
    return (
        F.when(F.size(parts) == 0, "p.=")
        .when(~F.coalesce(complete, F.lit(False)), F.lit(None))
        .when(F.size(parts) == 1, F.concat(F.lit("p."), F.get(named, F.lit(0))))
        .otherwise(F.concat(F.lit("p.["), F.array_join(named, ";"), F.lit("]")))
    )


def place_on_target(items: DataFrame, target_pos: DataFrame, offset: Column, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Reference-numbered rows on the target: ``position`` and ``placement`` (placed, outside, disagrees)."""
    here = target_pos.select(*by, "position", "ref_aa")
    rows = items.withColumn("position", F.col("ref_position") - offset).join(here, [*by, "position"], "left")
    placement = F.when(F.col("ref_aa").isNull(), "outside").when(F.col("ref").isNotNull() & (F.col("ref") != F.col("ref_aa")), "disagrees").otherwise("placed")
    return rows.withColumn("placement", placement)


def placement_summary(placed: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """How many rows are outside or disagree, and whether the offset looks wrong (over a tenth of five or more)."""
    inside = F.col("placement") != "outside"
    s = placed.groupBy(*by).agg(
        F.count(F.when(~inside, 1)).alias("outside"), F.count(F.when(inside & F.col("ref").isNotNull(), 1)).alias("compared"), F.count(F.when(F.col("placement") == "disagrees", 1)).alias("disagree")
    )
    return s.withColumn("problem", (F.col("compared") >= 5) & (F.col("disagree") > F.col("compared") / 10))


EDIT = r"^([1-9][0-9]*)([ACGT])>([ACGT])$"


def consequence_subs(names: DataFrame, codons: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """What coding substitutions (c.4A>G, c.[4A>G;6T>C]) do to the protein.

    ``names(dataset_id, variant)``, ``codons(dataset_id, position, codon)``. Returns ``pro_key,
    class, position, ref, alt, codons_changed, changed, mixed`` and ``problem`` (a reference base
    that disagrees, a position beyond the target, another kind of change).
    """
    keys = [*by, "variant"]
    body = F.regexp_replace(F.regexp_replace("variant", r"^c\.", ""), r"^\[(.*)\]$", "$1")
    edits = names.select(*keys).distinct().withColumn("e", F.explode(F.split(body, ";")))
    n = F.regexp_extract("e", EDIT, 1).try_cast("int")
    edits = edits.where("variant <> 'c.='").select(
        *keys, n.alias("n"), F.regexp_extract("e", EDIT, 2).alias("from"), F.regexp_extract("e", EDIT, 3).alias("to"),
        F.floor((n - 1) / 3 + 1).cast("int").alias("position"), ((n - 1) % 3 + 1).alias("at"),
    )
    at = edits.join(codons, [*by, "position"], "left")
    wrong = F.col("n").isNull() | F.col("codon").isNull() | (F.col("codon").substr(F.col("at"), F.lit(1)) != F.col("from"))
    per = at.groupBy(*keys, "position").agg(
        F.max("codon").alias("codon"), F.max(wrong.cast("int")).alias("wrong"), *[F.max(F.when(F.col("at") == i, F.col("to"))).alias(f"b{i}") for i in (1, 2, 3)]
    )
    new = F.concat(*[F.coalesce(f"b{i}", F.substring("codon", i, 1)) for i in (1, 2, 3)])
    per = settle(per, new=new)
    per = settle(per, r=translated(F.col("codon")), a=translated(F.col("new")))
    step = F.struct("position", F.col("r").alias("r"), F.col("a").alias("a"), (F.col("new") != F.col("codon")).alias("moved"))
    got = per.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("s"), F.max("wrong").alias("wrong"))
    got = settle(got, s=F.filter("s", lambda x: x["moved"]))
    diffs = F.filter("s", lambda x: x["r"] != x["a"])
    stop = F.array_position(F.transform("d", lambda x: x["a"]), "*")
    got = settle(got, d=diffs)
    got = settle(got, x=F.when(stop > 0, F.slice("d", F.lit(1), stop.cast("int"))).otherwise(F.col("d")))
    write = lambda xs, f: F.when(F.size(xs) == 1, F.concat(F.lit("p."), F.get(F.transform(xs, f), F.lit(0)))).otherwise(F.concat(F.lit("p.["), F.array_join(F.transform(xs, f), ";"), F.lit("]")))
    name = lambda x: F.concat(three_of(x["r"]), x["position"].cast("string"), three_of(x["a"]))
    quiet = lambda x: F.concat(three_of(x["r"]), x["position"].cast("string"), F.lit("="))
    x0, s0, one = F.get("x", F.lit(0)), F.get("s", F.lit(0)), F.size("x") == 1
    start = (x0["position"] == 1) & (x0["r"] == "M")
    cls = (
        F.when(F.size("s") == 0, "wild type").when(F.size("x") == 0, "synonymous").when(start, "start lost").when(~one, "multi-variant")
        .when(x0["r"] == "*", "stop lost").when(x0["a"] == "*", "nonsense").otherwise("missense")
    )
    key = F.when(F.size("s") == 0, "p.=").when(F.size("x") == 0, write(F.col("s"), quiet)).when(one | ~start, write(F.col("x"), name))
    ok = F.col("wrong") == 0
    out = got.select(
        *keys,
        F.when(ok, key).alias("pro_key"),
        F.when(ok, cls).alias("class"),
        F.when(ok, F.coalesce(x0["position"], s0["position"])).alias("position"),
        F.when(ok & one, x0["r"]).when(ok & (F.size("x") == 0), s0["r"]).alias("ref"),
        F.when(ok & one, x0["a"]).when(ok & (F.size("x") == 0), s0["r"]).alias("alt"),
        F.when(ok, F.size("s")).alias("codons_changed"),
        F.when(ok, F.size("x")).alias("changed"),
        F.when(ok, (F.size("x") > 0) & (F.size("s") > F.size("d"))).alias("mixed"),
        F.when(~ok, "not a substitution that agrees with the target").alias("problem"),
    )
    wild = names.select(*keys).distinct().where("variant = 'c.='").selectExpr(
        *keys, "'p.=' AS pro_key", "'wild type' AS class", "CAST(NULL AS INT) AS position", "CAST(NULL AS STRING) AS ref", "CAST(NULL AS STRING) AS alt", "0 AS codons_changed", "0 AS changed", "false AS mixed", "CAST(NULL AS STRING) AS problem"
    )
    return out.unionByName(wild)


def protein(dna: Column) -> Column:
    """One letter for every whole codon."""
    codons = F.when(F.length(dna) >= 3, F.sequence(F.lit(1), F.floor(F.length(dna) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(codons, lambda i: F.coalesce(translated(F.substr(dna, 3 * i - 2, F.lit(3))), F.lit("X"))), "")


def _up_to_stop(residues: Column, least: Column | None = None) -> Column:
    """Residues up to the first stop that stands at ``least`` (from 1) or later, all where there is none."""
    stop = F.locate("*", residues, 1) if least is None else F.call_function("locate", F.lit("*"), residues, least)
    return F.when(stop > 0, F.substr(residues, F.lit(1), stop)).otherwise(residues)


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a).cast("long")).cast("int")


def _three(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.coalesce(three_of(x), F.lit("Xaa"))), "")


INDEL = r"^c\.(\d+)(?:_(\d+))?(delins|del|dup|ins)([ACGT]*)$"


def consequence_indels(names: DataFrame, targets: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """What coding deletions, insertions, duplications and replacements do to the protein, once per distinct name: ``class, pro_key, position``.

    ``targets(dataset_id, sequence)`` holds the coding sequence from its first base. Both proteins are compared as letters: what they share at the beginning,
    then at the end, leaves the residues removed and those put in, and these say what the change is called. A replacement by as many bases is compared codon by codon.
    Names of other kinds get the class of their region (introns, untranslated ends), unreadable ones nulls.
    """
    # What a name does depends on its target alone: assays of one target share the work, once per name and different target.
    given = targets.select(*by, F.upper("sequence").alias("_dna"))
    different = cut(given.select(F.col("_dna").alias("dna")).distinct().withColumn("_target", F.monotonically_increasing_id()))
    of = cut(given.join(different, F.col("_dna").eqNullSafe(F.col("dna"))).select(*by, "_target"))
    asked = cut(names.select(*by, "variant").distinct().join(of, list(by)))
    rows = spread(cut(asked.select("_target", "variant").distinct())).join(different, "_target")
    part = lambda i: F.regexp_extract("variant", INDEL, i)
    start = part(1).try_cast("int")
    rows = settle(rows, kind=F.nullif(part(3), F.lit("")), s=start, e=F.coalesce(part(2).try_cast("int"), start), bases=part(4))
    inside = (F.col("s") >= 1) & (F.col("e") >= F.col("s")) & (F.col("e") <= F.length("dna"))
    # The bases kept before the change, the first base kept after it, and what is put between.
    kept = F.when(F.col("kind") == "dup", F.col("e")).when(F.col("kind") == "ins", F.col("s")).otherwise(F.col("s") - 1)
    again = F.when(F.col("kind").isin("dup", "ins"), kept + 1).otherwise(F.col("e") + 1)
    put = F.when(F.col("kind") == "dup", F.substr("dna", F.col("s"), F.col("e") - F.col("s") + 1)).otherwise(F.col("bases"))
    rows = settle(rows, known=F.coalesce(inside, F.lit(False)), kept=kept, altered=F.concat(F.substr("dna", F.lit(1), kept), put, F.substr("dna", again)))
    change = F.length("altered") - F.length("dna")
    rows = settle(rows, r=_up_to_stop(protein(F.col("dna"))), whole=protein(F.col("altered")), change=change, moved=F.pmod(change, F.lit(3)) != 0, swap=(F.col("kind") == "delins") & (change == 0))
    ends = F.col("r").endswith("*")
    # In frame, the protein ends where the reference's now ends, or at a stop there or later; without its stop it goes on to the next.
    now = F.substr("whole", F.lit(1), F.length("r") + F.floor(F.col("change") / 3).cast("int"))
    framed = F.when(F.locate("*", F.substr(now, F.length("r"))) > 0, _up_to_stop(now, F.length("r"))).when(ends & ~now.endswith("*"), _up_to_stop(F.col("whole"), F.length(now) + 1)).otherwise(now)
    rows = settle(rows, n=F.when(F.col("moved"), _up_to_stop(F.col("whole"))).otherwise(framed))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = settle(rows, rs=letters(F.col("r")), ns=letters(F.col("n")))
    rows = settle(rows, k=_shared(F.col("rs"), F.col("ns")))
    tail = F.least(_shared(F.reverse("rs"), F.reverse("ns")), F.least(F.size("rs"), F.size("ns")) - F.col("k"))
    middle = lambda text, size: F.substr(text, F.col("k") + 1, size - F.col("k") - F.col("tail"))
    rows = settle(rows, tail=tail)
    rows = settle(rows, gone=middle("r", F.size("rs")), put=_up_to_stop(middle("n", F.size("ns"))))

    p = F.col("k") + 1
    at = lambda i: _three(F.substr("r", i, F.lit(1)))
    number = lambda i: F.concat(at(i), i.cast("string"))
    span = lambda i, n: F.when(n > 1, F.concat(number(i), F.lit("_"), number(i + n - 1))).otherwise(number(i))
    told = lambda cls, key, place: F.struct(F.lit(cls).alias("class"), key.cast("string").alias("pro_key"), place.cast("int").alias("position"))
    p_ = lambda *parts: F.concat(F.lit("p."), *parts)
    none = F.lit(None)
    n_gone, n_put = F.length("gone"), F.length("put")
    methionine, stop_here = F.col("r").startswith("M"), ends & (p == F.size("rs"))
    first = F.floor(F.col("kept") / 3).cast("int") + 1
    before = F.col("k") - n_put + 1
    fs = F.least(p, F.size("rs"))
    stops = F.col("put").startswith("*")
    # Replacements of as many bases: the codons that change, and their residues up to a stop they make.
    codon = lambda c, i: F.substr(c, 3 * i - 2, F.lit(3))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("rs"), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substr("r", i, F.lit(1)).alias("r"), F.substr("whole", i, F.lit(1)).alias("a"), (codon("dna", i) != codon("altered", i)).alias("c")))
    rows = settle(rows, steps=F.when(F.col("swap"), F.filter(steps, lambda x: x["c"])))
    rows = settle(rows, diffs=F.filter("steps", lambda x: x["r"] != x["a"]))
    stop_at = F.array_position(F.transform("diffs", lambda x: x["a"]), "*").cast("int")
    rows = settle(rows, diffs=F.when(stop_at > 0, F.slice("diffs", F.lit(1), stop_at)).otherwise(F.col("diffs")))
    listed = lambda xs, f: F.when(F.size(xs) == 1, p_(F.get(F.transform(xs, f), 0))).otherwise(p_(F.lit("["), F.array_join(F.transform(xs, f), ";"), F.lit("]")))
    d0, n_diffs = F.get("diffs", 0), F.size("diffs")
    changes = lambda x: F.concat(_three(x["r"]), x["i"].cast("string"), _three(x["a"]))
    swapped = (
        F.when(F.size("steps") == 0, told("wild type", F.lit("p.="), none))
        .when(n_diffs == 0, told("synonymous", listed("steps", lambda x: F.concat(_three(x["r"]), x["i"].cast("string"), F.lit("="))), F.get("steps", 0)["i"]))
        .when((d0["i"] == 1) & methionine, told("start lost", F.when(n_diffs == 1, listed("diffs", changes)), F.lit(1)))
        .when(n_diffs > 1, told("multi-variant", listed("diffs", changes), d0["i"]))
        .when(d0["r"] == "*", told("stop lost", listed("diffs", changes), d0["i"]))
        .when(d0["a"] == "*", told("nonsense", listed("diffs", changes), d0["i"]))
        .otherwise(told("missense", listed("diffs", changes), d0["i"]))
    )
    shifted = (
        F.when((F.col("k") < F.size("rs")) & F.substr("n", p, F.lit(1)).eqNullSafe("*"), told("nonsense", p_(number(p), F.lit("Ter")), p))
        .when(stop_here & (F.size("ns") > F.col("k")), told("stop lost", p_(number(p), _three(F.substr("n", p, F.lit(1)))), p))
        .otherwise(told("frameshift", p_(number(fs), F.lit("fs")), fs))
    )
    in_frame = (
        F.when(stops & (F.col("k") >= F.size("rs")), told("synonymous", p_(F.lit("Ter"), p.cast("string"), F.lit("=")), p))
        .when(stops, told("nonsense", p_(number(p), F.lit("Ter")), p))
        .when(stop_here, told("stop lost", p_(number(p), F.coalesce(F.nullif(_three(F.substr("put", F.lit(1), F.lit(1))), F.lit("")), F.lit("Xaa"))), p))
        .when((n_gone == 1) & (n_put == 1), told("missense", p_(number(p), _three(F.col("put"))), p))
        .when((n_gone > 0) & (n_put > 0), told("deletion-insertion", p_(span(p, n_gone), F.lit("delins"), _three(F.col("put"))), p))
        .when((n_gone > 0) & ends & (p + n_gone == F.size("rs")), told("nonsense", p_(number(p), F.lit("Ter")), p))
        .when(n_gone > 0, told("deletion", p_(span(p, n_gone), F.lit("del")), p))
        .when((before >= 1) & (F.substr("r", before, n_put) == F.col("put")), told("duplication", p_(span(before, n_put), F.lit("dup")), before))
        .otherwise(told("insertion", p_(number(F.col("k")), F.lit("_"), number(p), F.lit("ins"), _three(F.col("put"))), F.col("k")))
    )
    coding = (
        F.when(F.col("swap"), swapped)
        .when((F.col("r") == F.col("n")) & (first > F.size("rs")), told("synonymous", F.lit("p.="), none))
        .when(F.col("r") == F.col("n"), told("synonymous", p_(number(first), F.lit("=")), first))
        .when((F.size("ns") == 0) | ((F.col("k") == 0) & methionine), told("start lost", none, F.lit(1)))
        .when(F.col("moved"), shifted)
        .otherwise(in_frame)
    )
    offsets = F.transform(F.regexp_extract_all("variant", F.lit(r"\d([+-]\d+)"), 1), lambda x: F.abs(x.cast("int")))
    region = (
        F.when(F.col("variant").rlike(r"^c\.\S*\d[+-]\d"), F.when(F.exists(offsets, lambda x: x <= 2), "splice site").otherwise("intronic"))
        .when(F.col("variant").rlike(r"^c\.-\d+_\d+(del|delins)"), "start lost").when(F.col("variant").rlike(r"^c\.-\d"), "5' UTR").when(F.col("variant").rlike(r"^c\.\*\d"), "3' UTR")
    )
    out = settle(rows, told=F.when(F.col("kind").isNull(), F.struct(region.alias("class"), none.cast("string").alias("pro_key"), none.cast("int").alias("position"))).when(F.col("known"), coding))
    told_of = cut(out.select("_target", "variant", "told.class", "told.pro_key", "told.position"))
    return asked.join(told_of, ["_target", "variant"], "left").select(*by, "variant", "class", "pro_key", "position")


def combine_codons(counts: DataFrame, consequences: DataFrame, by: Sequence[str] = ("dataset_id",)) -> tuple[DataFrame, DataFrame]:
    """Codon variants at protein level: (counts summed per protein variant and sample, conflicts).

    ``counts(dataset_id, row_no, variant, sample_id, cnt)``. A name on several rows with the same
    counts is read once; with different counts it is a conflict, left out and listed.
    """
    vector = F.array_sort(F.collect_list(F.struct("sample_id", "cnt")))
    rows = counts.groupBy(*by, "variant", "row_no").agg(vector.alias("vector"))
    names = rows.groupBy(*by, "variant").agg(F.min("vector").alias("vector"), F.max("vector").alias("__top"), F.count(F.lit(1)).alias("n_rows"))
    same = F.col("vector") == F.col("__top")
    once = names.where(same).select(*by, "variant", F.inline("vector"))
    summed = (
        once.join(consequences.where("pro_key IS NOT NULL").select(*by, "variant", "pro_key"), [*by, "variant"])
        .groupBy(*by, "pro_key", "sample_id")
        .agg(F.sum("cnt").alias("cnt"), F.count_distinct("variant").alias("n_codons"))
    )
    return summed, names.where(~same).select(*by, "variant", "n_rows")


def names_from_sequences(df: DataFrame, wt: str, column: str = "sequence") -> DataFrame:
    """Adds ``nt_key`` and ``pro_key`` of a whole coding sequence, compared with the wild type ``wt``."""
    s = F.upper(column)
    ok = (F.length(s) == len(wt)) & s.rlike("^[ACGT]+$")
    letter = lambda text, i: F.lit(text).substr(i, F.lit(1))
    moved = F.filter(F.sequence(F.lit(1), F.lit(len(wt))), lambda i: F.substr(s, i, F.lit(1)) != letter(wt, i))
    nt = F.transform("__m", lambda i: F.concat(i.cast("string"), letter(wt, i), F.lit(">"), F.substr(s, i, F.lit(1))))
    codons = F.array_distinct(F.transform("__m", lambda i: F.floor((i - 1) / 3 + 1).cast("int")))
    residues = F.transform(codons, lambda k: F.struct(k.alias("k"), translated(F.lit(wt).substr(3 * k - 2, F.lit(3))).alias("r"), translated(F.substr(s, 3 * k - 2, F.lit(3))).alias("a")))
    write = lambda p, xs: F.when(F.size(xs) == 1, F.concat(F.lit(p), F.get(xs, F.lit(0)))).otherwise(F.concat(F.lit(p + "["), F.array_join(xs, ";"), F.lit("]")))
    changed = F.transform(F.filter("__r", lambda x: x["r"] != x["a"]), lambda x: F.concat(three_of(x["r"]), x["k"].cast("string"), three_of(x["a"])))
    quiet = F.transform("__r", lambda x: F.concat(three_of(x["r"]), x["k"].cast("string"), F.lit("=")))
    out = settle(settle(df, __m=F.when(ok, moved)), __r=residues)
    none = F.size("__m") == 0
    return (
        out.withColumn("nt_key", F.when(ok, F.when(none, "c.=").otherwise(write("c.", nt))))
        .withColumn("pro_key", F.when(ok, F.when(none, "p.=").when(F.size(changed) > 0, write("p.", changed)).otherwise(write("p.", quiet))))
        .drop("__m", "__r")
    )
