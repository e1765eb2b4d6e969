"""Quality rules of documents and of their hosts, in DataFrame expressions only.

Documents are tested by rules on their words, symbols, lines and repeated 5-word windows. The failures
are summed by host (the column `source` of `documents`), each host's failure rate is shrunk towards the
rate of all hosts by a beta prior fitted to the hosts, and hosts whose shrunk rate exceeds a limit
are refused together with all their documents.

Defined results: a null text counts as empty and so fails (no words); a null host is a host of its own;
repeated rows count as often as they occur; a text of any length is tested whole, in one row's expressions; an empty table gives an
empty result; columns of the names METRICS are replaced, others are kept if they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, keep, shared_dir

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Symbols a word, and share of repeated lines, from which a document counts as a failure of its host.
MAX_SYMBOLS = 1.0
MAX_DUP_LINES = 0.5
#: Shrunk failure rate above which a host is refused.
MAX_HOST_RATE = 0.9
#: Strength of the prior, in documents: the limits of the fit, and the value for hosts that don't differ.
PRIOR = (1.0, 10_000.0, 2.0)
#: Refused hosts up to this number (of names, so a few MB) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 10_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed")


def _repeats(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words. Expects __words and n_words.

    Windows are compared by hash first; only documents where hashes repeat compare the windows' words.
    """
    at = lambda i, k: F.get("__words", i + k)
    starts = lambda: F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    frame = frame.withColumn("__h", F.when(F.col("n_words") > WINDOW, F.transform(starts(), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))))
    frame = frame.withColumn("__again", F.coalesce(F.size(F.array_distinct("__h")) < F.size("__h"), F.lit(False)))
    window = lambda i: F.struct(F.get("__h", i).alias("h"), F.concat_ws(" ", *(at(i, k) for k in range(WINDOW))).alias("w"), i.alias("i"))
    frame = frame.withColumn("__s", F.when(F.col("__again"), F.sort_array(F.transform(starts(), window))))

    def same(j: Column, k: Column) -> Column:
        a, b = F.get("__s", j), F.get("__s", k)
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    twice = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    frame = frame.withColumn("__d", F.when(F.col("__again"), F.sort_array(F.transform(twice, lambda j: F.get("__s", j)["i"]))))
    gaps = F.aggregate(
        F.when(F.size("__d") > 1, F.sequence(F.lit(0), F.size("__d") - 2)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.get("__d", k + 1) - F.get("__d", k)),
    )
    return frame.withColumn("n_repeat_words", F.when(F.size("__d") > 0, gaps + WINDOW).otherwise(F.lit(0).cast("long"))).drop("__h", "__again", "__s", "__d")


def rule_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns METRICS; columns of these names are replaced."""
    frame = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__c", F.btrim("__t", F.lit(SPACE)))
    frame = frame.withColumn("__words", F.when(F.col("__c") == "", F.array().cast("array<string>")).otherwise(F.split("__c", SPACES)))
    frame = frame.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    frame = frame.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.regexp_replace("__t", f"{SYMBOLS}+", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_lines": F.size("__lines"),
        }
    )
    frame = _repeats(frame)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    frame = frame.withColumn("base_failed", base)
    failed = F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("__n_lines"))
    return frame.withColumn("failed", failed).drop("__t", "__c", "__words", "__lines", "__n_lines")


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: host, n_docs, n_failed, rate, shrunk. The prior's mean is the rate of all rows, its
    strength follows from the spread of the hosts' rates (method of moments, hosts weighted by their rows)."""
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    sums = hosts.agg(
        F.sum("n_docs").cast("double").alias("n"),
        F.sum("n_failed").cast("double").alias("f"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    ).first()
    low, high, strength = PRIOR
    mean = sums["f"] / sums["n"] if sums["n"] else 0.0
    spread = sums["ff"] / sums["n"] - mean * mean if sums["n"] else 0.0
    if spread > 1e-12 and 0 < mean < 1:
        strength = min(high, max(low, mean * (1 - mean) / spread - 1))
    return hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs")).withColumn("shrunk", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + F.lit(strength)))


def quality_rules(spark: SparkSession, docs: DataFrame, columns: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """The named columns of `docs`, the METRICS, `host_failed` and `kept` of every row."""
    path = shared_dir(spark)
    named = [F.col(c) for c in columns if c not in (*METRICS, "__host", "host_failed", "kept")]
    rows = rule_columns(docs, text).withColumn("__host", F.col(host)).select(*named, *METRICS, "__host")
    rows = keep(spark, rows, f"{path}/rules")
    hosts = keep(spark, host_rates(rows, "__host"), f"{path}/hosts")
    bad = hosts.filter(F.col("shrunk") > MAX_HOST_RATE).select(F.col("host").alias("__bad"))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    rows = rows.join(bad.withColumn("__hit", F.lit(True)), F.col("__host").eqNullSafe(F.col("__bad")), "left")
    rows = rows.withColumn("host_failed", F.coalesce("__hit", F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("__host", "__bad", "__hit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(spark, documents(spark, sf_dir, "doc_id", "text", "source"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(0, 5)) AS k) WHERE c.n > 1 GROUP BY r),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_lines AS failed FROM b),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS x FROM f GROUP BY source),
s AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-12 AND mean > 0 AND mean < 1
        THEN least({PRIOR[1]}, greatest({PRIOR[0]}, mean * (1 - mean) / spread - 1)) ELSE {PRIOR[2]} END AS k FROM s),
v AS (SELECT host FROM h, q WHERE (x + mean * k) / (n + k) > {MAX_HOST_RATE})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM v WHERE v.host IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
