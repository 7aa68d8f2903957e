"""Line-first cleaning in DataFrame expressions alone: rules judge lines, documents that lose too much text are rejected.

Everything is a narrow projection over one row; nothing is shuffled. A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.

Defined cases: a null text has no words and fails the base rules; texts are read whole; a null ``doc_id`` is kept as null;
repeated rows are judged each; an empty table gives no rows; further columns are ignored. Five-word windows are compared
by a 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import only

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Phrases of pages that aren't their text.
BOILERPLATE = (
    "all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie policy|accept cookies|enable javascript|"
    "click here|sign up|log in|subscribe to|share this|read more|powered by|skip to content|back to top|lorem ipsum"
)
#: A short line must end like a sentence.
SENTENCE_END, SHORT_LINE = "[.!?:;…\"'”»)\\]]\\s*$", 40
#: Shares of a line's characters, as one in so many: symbols, navigation bars, exclamation marks.
SYMBOL_IN, BAR_IN, SHOUT_IN = 10, 20, 12


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line."""
    bars, n = count_of(line, "|"), F.length(line)
    return ~(
        (count_of(line, SYMBOLS) * SYMBOL_IN > n)
        | ((bars >= 3) & (bars * BAR_IN >= n))
        | (count_of(line, "!") * SHOUT_IN > n)
        | ((n < SHORT_LINE) & ~line.rlike(SENTENCE_END))
        | F.lower(line).rlike(BOILERPLATE)
    )


def clean(docs: DataFrame, *, least_share: float = 0.5) -> DataFrame:
    """``doc_id`` and ``text``, with the lines that pass only (null where fewer than ``least_share`` of the characters do)."""
    rows = only(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    lines = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    good = lines.withColumn("good", F.filter("lines", line_passes))
    return good.select("doc_id", F.when(_chars("good") >= least_share * _chars("lines"), F.array_join("good", "\n")).alias("text"))


def _chars(lines: str) -> Column:
    return F.length(F.array_join(lines, ""))


def judge(docs: DataFrame, *, least_words: int = 10, most_repeated: int = 20, least_share: float = 0.5) -> DataFrame:
    """Counts and verdicts for each document: ``base_failed`` for few words or over ``most_repeated`` percent of them in
    repeated windows, ``kept`` if neither that nor under ``least_share`` of the characters of its lines are left."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, doc_id=F.col("doc_id").cast("long"), text=text)
    split = rows.select(
        "doc_id",
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _chars("lines").cast("long").alias("line_chars"),
        F.length(F.array_join(F.filter("lines", line_passes), "")).cast("long").alias("good_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    hashed = counted.withColumn("windows", F.when(F.size("hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    repeated = hashed.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).otherwise(F.array().cast("array<bigint>")))
    ordered = repeated.withColumn("windows", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.transform("windows", lambda x, k: F.when((F.get("windows", k - 1)["h"] == x["h"]) | (F.get("windows", k + 1)["h"] == x["h"]), x["i"]))
    places = ordered.withColumn("windows", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("windows") - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get("windows", k) - F.get("windows", k - 1)))
    n_repeat = F.when(F.size("windows") > 1, covered).otherwise(0).cast("long")
    out = places.withColumn("n_repeat_words", n_repeat).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    left = F.col("good_chars") >= least_share * F.col("line_chars")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & left).alias("kept"), "line_chars", "good_chars")


def oracle() -> str:
    """DuckDB SQL for :func:`judge` over ``documents``."""
    def count(text: str, chars: str) -> str:
        return f"(length({text}) - length(translate({text}, '{chars}', '')))"

    line = f"""NOT ({count("x", SYMBOLS)} * {SYMBOL_IN} > length(x) OR ({count("x", "|")} >= 3 AND {count("x", "|")} * {BAR_IN} >= length(x))
      OR {count("x", "!")} * {SHOUT_IN} > length(x) OR (length(x) < {SHORT_LINE} AND NOT regexp_matches(x, '{SENTENCE_END.replace("'", "''")}'))
      OR regexp_matches(lower(x), '{BOILERPLATE}'))"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM p) GROUP BY r),
m AS (SELECT s.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {count("text", SYMBOLS)}::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(array_to_string(lines, ''))::BIGINT AS line_chars, length(array_to_string(list_filter(lines, lambda x: {line}), ''))::BIGINT AS good_chars
  FROM s LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good_chars >= 0.5 * line_chars AS kept, line_chars, good_chars FROM f"""
