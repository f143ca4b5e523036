"""Quality rules with cross-document line frequency; columns and SQL functions only.

Lines are normalised and hashed. A line found in more than ``limit`` different texts of one host (the
``source``) counts as shared and is removed everywhere but in the host's document of smallest id that has it. A document of which too little
is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut
from assaylake.llm.common import SPACE, WORD, let, table
from assaylake.llm.registry import query

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
LINE_LIMIT = 20
LEFT_PERCENT = 20


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that the text has twice or more; windows are compared by a 64-bit hash."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - at[i - 1])))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(pairs: Column) -> Column:
        n = F.size(pairs)
        alike = lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(F.filter(pairs, alike), lambda x: x["i"])), covered)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
        some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)
        )
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, some))

    return let(words, of)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for a null text."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def _plain(text: Column) -> Column:
    """The normalised lines of a text, blank ones too."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))


def _lines(text: Column) -> Column:
    """Distinct normalised lines of a text: hash h, words n of all its occurrences."""
    kept = F.transform(F.filter(_plain(text), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n")))
    return kept


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in ``gone``; the other lines, blank ones too, as they are."""
    hashes = F.transform(_plain(text), lambda x: F.when(x != "", F.xxhash64(x)))
    stays = lambda h: F.filter(F.split(text, "\n"), lambda x, i: F.get(h, i).isNull() | ~F.array_contains(gone, F.get(h, i)))
    return F.array_join(let(hashes, stays), "\n")


def shared_lines(rows: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """host, h, first_id: lines in more than ``limit`` different texts of a host.

    ``rows`` has doc_id, host, content (a hash of the text) and an array of lines. Exact copies of a text count once. Both
    aggregates combine before they shuffle, so a line that most documents have is a row per task.
    """
    lines = rows.select("doc_id", "host", "content", F.explode("lines").alias("line")).select("doc_id", "host", "content", "line.h")
    texts = lines.groupBy("host", "h", "content").agg(F.min("doc_id").alias("doc_id"))
    return texts.groupBy("host", "h").agg(F.count("*").alias("_texts"), F.min("doc_id").alias("first_id")).where(F.col("_texts") > limit).drop("_texts")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _judged(docs: DataFrame, limit: int, left_percent: int) -> DataFrame:
    """The columns of ``judge``, and gone: the hashes of the lines that are removed, null where there are none."""
    keyed = docs.select("doc_id", _host().alias("host"), F.xxhash64("text").alias("content"), "text")
    key = ["doc_id", "host", "content"]
    rows = cut(keyed.select(*key, _lines(F.col("text")).alias("lines"), measures(F.col("text")).alias("m")))
    shared = shared_lines(rows, limit)
    each = rows.select(*key, F.explode("lines").alias("line")).groupBy(*key, F.col("line.h").alias("h")).agg(F.sum("line.n").alias("n"), F.count("*").alias("_k"))
    copies = rows.groupBy(*key).agg(F.count("*").alias("_copies"))
    removed = each.join(shared, ["host", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(*key).agg(F.sum("n").alias("_removed"), F.collect_list("h").alias("gone"))
    removed = removed.join(copies, [removed[k].eqNullSafe(copies[k]) for k in key]).select(*[removed[k].alias(f"_{k}") for k in key], (F.col("_removed") / F.col("_copies")).cast("long").alias("removed_words"), "gone")
    base = rows.select(*key, "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        base.withColumn("base_failed", failed)
        .join(removed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (100 * left >= left_percent * F.col("n_words")))
        .select("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "gone")
    )


def judge(docs: DataFrame, limit: int = LINE_LIMIT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """A row per input row: doc_id, the measures, base_failed, removed_words (in shared lines) and kept.

    base_failed: fewer than ten words, or over 20% of the words in repeated windows. kept: not
    base_failed, and of the words at least ten and ``left_percent`` in a hundred are left after shared lines are removed. A null
    text has no words and fails; null sources are one host. Rows of equal id, source and text get equal results. Texts are read
    once: measures and line hashes are written, and the steps across documents start from there.
    """
    return _judged(docs, limit, left_percent).drop("gone")


def cleaned(docs: DataFrame, limit: int = LINE_LIMIT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, in the same columns, their texts without the lines it counts as removed."""
    key = ["doc_id", "host", "content"]
    kept = _judged(docs, limit, left_percent).where("kept").dropDuplicates(key).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("gone").alias("_gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (_host() == F.col("_host")) & (F.xxhash64("text") == F.col("_content"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_gone")))
    return docs.join(kept, same).withColumn("text", text).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM d, unnest(range(1, len(ws) - 3)) AS t(i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
pos AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM pos GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS x FROM d),
ln AS (SELECT doc_id, sum((regexp_matches(x, '[^\x20\x09-\x0D]'))::INT) - count(DISTINCT CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN x END) AS n FROM raw GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM raw),
shared AS (SELECT host, x, min(doc_id) AS first_id FROM norm WHERE x <> '' GROUP BY host, x HAVING count(DISTINCT text) > 20),
rem AS (SELECT n.doc_id, sum(length(n.x) - length(replace(n.x, ' ', '')) + 1) AS n FROM norm n JOIN shared s ON n.host = s.host AND n.x = s.x WHERE n.doc_id <> s.first_id GROUP BY n.doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(ln.n AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND n_words - removed_words >= 10 AND 100 * (n_words - removed_words) >= 20 * n_words AS kept FROM b
"""


@query("op7_line_frequency_rules", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "content")
