"""Quality rules per document, judged together per host.

Each document is tested by rules on its own text.  Rule failures are summed by
host, each host's failure rate is shrunk towards all hosts by a beta prior that
is fitted to the hosts themselves (method of moments), and the host verdict is
joined back to the documents.  All steps are DataFrame functions.

The verdict follows from the host's posterior.  A host is ``bad``, and loses all
its documents, if its rate is surely (by ``SURE`` standard deviations) more than
``BAD_TIMES`` the mean of all hosts, or more than half way from that mean to 1
where this is less.  A host is ``suspect`` if its shrunk rate is above the mean:
its documents must pass the soft rules too, while hosts that do no worse than the
mean (``trusted``) may break them.  So no limit is fixed beforehand.

Defined results: null text has no words and fails; a null host is a host of its
own; repeated rows count as often as they occur; with one host, or equal rates,
the prior weighs one document; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import durable, sums

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT = 50, 50, 10
SURE, BAD_TIMES = 3.0, 2.0
#: What rounding may add to a rate that equals the mean.
MARGIN = 1e-9


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the
    positions of neighbours that agree are the repeated windows, and the union
    of three words from each is counted from the sorted positions.
    """
    m = n - 2
    windows = F.sort_array(F.arrays_zip(
        F.slice(words, 1, m).alias("a"), F.slice(words, 2, m).alias("b"), F.slice(words, 3, m).alias("c"), F.sequence(F.lit(0), m - 1).alias("at")
    ))
    return F.when(n < 3, F.array().cast("array<struct<a:string,b:string,c:string,at:int>>")).otherwise(windows)


def _union_of_threes(sorted_windows: Column) -> Column:
    m = F.size(sorted_windows)
    pairs = F.arrays_zip(F.slice(sorted_windows, 1, m - 1).alias("x"), F.slice(sorted_windows, 2, m - 1).alias("y"))
    same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["at"], p["y"]["at"])))))
    none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.when(m < 2, F.lit(0)).otherwise(F.aggregate(places, none, step, lambda acc: acc["n"]))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host and what the rules look at, from one read of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = base.select(
        "id", "host", _words(F.col("text")).alias("words"), lines.alias("lines"),
        F.char_length(F.regexp_replace("text", BLANK_RUN, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("words"), F.size("words")).alias("windows"),
    )
    return counted.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", _union_of_threes(F.col("windows")).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", sure: float = SURE, bad_times: float = BAD_TIMES) -> DataFrame:
    """Measures, ``base_failed``, ``failed`` (any rule), the host's ``host_docs``, ``host_failed``, shrunk ``host_rate`` and ``host_verdict``, and ``kept``."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = measures(docs, id_col, text_col, host_col).withColumn("base_failed", (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n))
    failed = F.col("base_failed") | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
    base = durable(base.withColumn("failed", failed))
    hosts = base.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    mean, spread = sums(hosts, F.avg(rate), F.var_samp(rate))  # one row, however many hosts
    mean = 0.0 if mean is None else mean
    strength = mean * (1 - mean) / spread - 1 if spread else 1.0
    strength = max(strength, 1.0)
    hosts = hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength)))
    rate = F.col("host_rate")
    spread = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + F.lit(strength + 1)))
    verdict = F.when(rate - sure * spread > min(bad_times * mean, (1 + mean) / 2), "bad").when(rate > mean + MARGIN, "suspect").otherwise("trusted")
    hosts = hosts.withColumn("host_verdict", verdict)
    theirs = hosts.withColumnRenamed("host", "their_host")
    both = base.join(theirs, F.col("host").eqNullSafe(F.col("their_host")), "left")
    kept = ~F.col("base_failed") & F.when(F.col("host_verdict") == "suspect", ~F.col("failed")).otherwise(F.col("host_verdict") == "trusted")
    return both.select(F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "host_docs", "host_failed", "host_rate", "host_verdict", kept.alias("kept"))


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS soft_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS f FROM judged GROUP BY source),
moments AS (
  SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS s FROM moments),
rates AS (
  SELECT source, m, n + s AS seen, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate - 3 * sqrt(rate * (1 - rate) / (seen + 1)) <= least(2 * m, (1 + m) / 2) AND (rate <= m + 1e-9 OR NOT soft_failed) AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""
