"""Quality rules, line first: rules judge each line, failing lines go, then documents that lose too much text are rejected.

Everything is a DataFrame expression: no Python runs on the executors and nothing is shuffled, so cost is linear in the text and one
document never meets another.

Defined results: a null text has no words and fails; an empty text likewise. Null ids and repeated rows pass through, one output row
per input row. Columns beside doc_id and text are ignored by ``measure``; ``keep`` passes on what the line rules
left of each text and changes n_chars with it, all other columns stay unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

#: What the rules look for.
SYMBOL = r"[#*$%&|<>]"
ENDED = r"[.!?:;…。！？][)\]}\"'»”’]*[\x20\x09-\x0D]*$"
SEPARATOR = r"(^|[\x20\x09-\x0D])[|»›>·•/\-–—]+([\x20\x09-\x0D]|$)"
MARKED = r"[#*$%&<>!?]{2,}"
LOWER = r"[a-zà-öø-ÿß]"
UPPER = r"[A-ZÀ-ÖØ-Þ]"
PHRASE = r"(?i)(all rights reserved|cookie|privacy policy|terms of (use|service)|click here|sign (in|up)|log ?in|subscribe|javascript|lorem ipsum|licensed under|is licensed|public license|copyright|share (on|this)|read more)"
#: A line without an ending mark fails below this many words.
UNENDED_WORDS = 20
#: A line with such a phrase fails up to this many words.
PHRASE_WORDS = 25
#: A document is rejected if it loses more than this share, in percent, of its word characters.
MOST_LOST = 40
#: Gates before the line rules: fewest words, and the largest share in percent of words in repeated 3-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule on punctuation, navigation or boilerplate."""
    n = F.regexp_count(line, F.lit(WORD))
    punctuation = (~line.rlike(ENDED) & (n < UNENDED_WORDS)) | (F.regexp_count(line, F.lit(MARKED)) * 3 > n)
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) >= 3) & (F.regexp_count(line, F.lit(SEPARATOR)) * 5 > n)
    boilerplate = ((n <= PHRASE_WORDS) & line.rlike(PHRASE)) | (~line.rlike(LOWER) & (F.regexp_count(line, F.lit(UPPER)) >= 10))
    return punctuation | navigation | boilerplate


def measure(documents: DataFrame) -> DataFrame:
    """One row per row of documents: the base figures, what the line rules leave, and the verdict."""
    chars = lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))
    base = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    split = base.select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        chars(F.col("t")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    # A window is its hash and its place; sorted, equal windows are neighbours.
    placed = split.select(
        "doc_id", "lines", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.size("w") >= 3, F.sort_array(F.transform(F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))), lambda x, i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), x).alias("h"), i.alias("i"))))).alias("s"),
    )
    same = lambda x, k: (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"])
    found = placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("s", same).alias("r"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(line_fails(x), chars(x)).otherwise(0)).alias("lost"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    counted = found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.coalesce(F.size("r"), F.lit(0)) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"), "lost")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost") <= MOST_LOST * F.col("word_chars")))


def cleaned(text: Column) -> Column:
    """The text without its failing lines; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)), "\n")


def keep(documents: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns: text without its failing lines, and n_chars brought up to date where the table has it."""
    own = [F.col(f"`{c}`") for c in documents.columns]
    judged = measure(documents.select(F.struct(*own).alias("doc_id"), F.col("text")))
    # A filter would be pushed below all projections, each expression copied into the next; a generator keeps each computed once.
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id"))).alias("row"))
    edited = kept.select("row", cleaned(F.col("row")["text"]).alias("_text"))
    now = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        now["n_chars"] = F.when(F.col("row")["n_chars"].isNotNull(), F.length("_text")).cast(documents.schema["n_chars"].dataType)
    return edited.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def op7_quality_rules(spark, sf_dir):
    return measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    count = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
    n = count("l", WORD)
    fails = (
        f"((NOT regexp_matches(l, {q(ENDED)}) AND {n} < {UNENDED_WORDS}) OR {count('l', MARKED)} * 3 > {n}"
        f" OR ({count('l', SEPARATOR)} >= 3 AND {count('l', SEPARATOR)} * 5 > {n})"
        f" OR ({n} <= {PHRASE_WORDS} AND regexp_matches(l, {q(PHRASE)})) OR (NOT regexp_matches(l, {q(LOWER)}) AND {count('l', UPPER)} >= 10))"
    )
    chars = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    return f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, {q(WORD)}) AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {q(WORD)})) AS lines FROM b),
p AS (SELECT rid, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, i, n, concat_ws(' ', x, lead(x, 1) OVER z, lead(x, 2) OVER z) AS g FROM p WINDOW z AS (PARTITION BY rid ORDER BY i)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM g WHERE i <= n - 2) WHERE k > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(j) GROUP BY rid),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, {chars('t')}::BIGINT AS word_chars, {count('t', SYMBOL)}::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 coalesce(list_sum(list_transform(lines, lambda l: CASE WHEN {fails} THEN {chars('l')} ELSE 0 END)), 0) AS lost
 FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
 (NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost <= {MOST_LOST} * word_chars) AS kept FROM m
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {"op7_quality_rules": _sql()}
