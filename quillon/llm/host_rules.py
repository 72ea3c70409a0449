"""Quality rules with host-level verdicts. DataFrame functions only.

Each text is measured and judged by two rules; failures are summed by host (`source`), each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts by the
method of moments, and the verdict of the host joins back to its documents: documents of a host
whose shrunk rate exceeds `max_rate` go, besides those that fail themselves.

The prior: m = failures / documents, v = mean over hosts of (rate - m)^2, s = m(1-m)/v - 1 where
that is defined and positive, else 1; alpha = m s, beta = (1-m) s; shrunk rate =
(failures + alpha) / (documents + s).

Defined results: null text has no words and fails; null is a host of its own; repeated rows are
judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, count_rows, documents, materialize, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.8


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every text.

    Repeated 3-word windows are found within the row: windows with their positions are sorted, and
    neighbours that are equal are repeats; a word counts once however many windows cover it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", lines).withColumn("n", F.size("w"))
    windows = F.when(F.col("n") < 3, F.array().cast("array<struct<g:string,i:int>>")).otherwise(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.cast("int").alias("i"))))
    )
    base = base.withColumn("s", windows)
    twice = F.filter("s", lambda x, k: (F.coalesce(F.get("s", k - 1)["g"] == x["g"], F.lit(False))) | (F.coalesce(F.get("s", k + 1)["g"] == x["g"], F.lit(False))))
    base = base.withColumn("twice", F.transform(twice, lambda x: x["i"]))
    covered = F.array_distinct(F.concat("twice", F.transform("twice", lambda i: i + 1), F.transform("twice", lambda i: i + 2)))
    return base.select(
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )


def judge(measured: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return measured.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host_key (never null), docs, failures, shrunk_rate, host_ok. Partial sums go before the shuffle."""
    hosts = judged.groupBy("host_key").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = materialize(hosts, "host-sums")
    got = hosts.agg(F.sum("docs"), F.sum("failures")).first()
    m = got[1] / got[0] if got[0] else 0.0
    v = hosts.agg(F.avg(F.pow(F.col("failures") / F.col("docs") - F.lit(m), F.lit(2.0)))).first()[0] or 0.0
    s = m * (1 - m) / v - 1 if v > 0 else 0.0
    s = s if s > 0 else 1.0
    rate = (F.col("failures") + F.lit(m * s)) / (F.col("docs") + F.lit(s))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_ok", F.col("shrunk_rate") <= F.lit(max_rate))


def host_rules(docs: DataFrame, max_rate: float = MAX_RATE, **cols) -> DataFrame:
    """One row per row of `docs`: the counts, base_failed, kept, and the host's shrunk_rate."""
    judged = judge(measure(docs, **cols)).withColumn("host_key", F.when(F.col("host").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("host").cast("string"))))
    judged = materialize(judged, "host-judged")
    met = attach_groups(judged, host_verdicts(judged, max_rate), "host_key", "docs", count_rows(judged))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "shrunk_rate")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(documents(spark, sf_dir)).drop("shrunk_rate")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, w.source, CAST(len(w.w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM j GROUP BY source),
m AS (SELECT sum(f) * 1.0::DOUBLE / sum(n) AS m FROM h),
v AS (SELECT any_value(m) AS m, avg(pow(f * 1.0::DOUBLE / n - m, 2)) AS v FROM h, m),
s AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v > 1 THEN m * (1 - m) / v - 1 ELSE 1.0::DOUBLE END AS s FROM v),
k AS (SELECT source, (f + m * s) / (n + s) <= 0.8 AS host_ok FROM h, s)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_ok AS kept
FROM j JOIN k ON k.source IS NOT DISTINCT FROM j.source
"""
