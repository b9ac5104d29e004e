"""Quality rules with host-level verdicts (native DataFrame functions only).

Each text is judged by base rules. Failures are summed by host, each host's
failure rate is shrunk towards all hosts' with an empirical beta prior, and
hosts whose shrunk rate is too high are rejected with all their documents.

Defined results: a null or blank text has no words and fails the base rules. A
null host has no rate and is never rejected. Repeated rows count and are judged
one by one. Empty tables give no rows; other columns play no part and may have
any name. A text is held whole with its words and their three-word windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, table, words, written


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    #: Most words, in percent, that may stand in repeated three-word windows.
    max_repeat_percent: int = 50
    #: A host is rejected at a shrunk failure rate above this.
    max_rate: float = 0.5
    #: Up to so many rejected hosts are broadcast; more are joined by a shuffle.
    broadcast_hosts: int = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it, and however Spark moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _third(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]


def n_repeat_words(w: Column) -> Column:
    """The number of words of the array w in three-word windows that occur twice or more.

    Hashes only rule out texts without repeats; windows are compared by their
    words, sorted together with their places, each next to its equals.
    """
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(_third(w, i))], i.alias("at"))
    same = lambda a, b: F.coalesce((a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))

    def covered(r: Column) -> Column:
        place = lambda k: _let(F.get(r, k), lambda x: F.when(same(x, F.get(r, k - 1)) | same(x, F.get(r, k + 1)), x["at"]))
        hits = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(r) - 1), place))
        return _let(hits, lambda h: F.size(F.array_distinct(F.concat(h, F.transform(h, lambda p: p + 1), F.transform(h, lambda p: p + 2)))))

    repeats = lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), _let(F.sort_array(F.transform(starts, window)), covered)).otherwise(0)
    return F.when(F.size(w) < 4, 0).otherwise(_let(F.transform(starts, lambda i: F.xxhash64(*_third(w, i))), repeats)).cast("long")


def _fails(n_words: Column, repeated: Column, rules: HostRules) -> Column:
    return (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)


def base_failed(text: Column, rules: HostRules = HostRules()) -> Column:
    return _let(words(text), lambda w: _fails(F.size(w), n_repeat_words(w), rules))


def text_features(docs: DataFrame, rules: HostRules = HostRules(), key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_words = _let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        F.col(key).alias("key"), F.col(host).alias("host"), by_words.alias("x"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    df = df.select("key", "host", "x.n_words", "x.word_chars", "n_symbols", "n_dup_lines", "x.n_repeat_words")
    return df.withColumn("base_failed", _fails(F.col("n_words"), F.col("n_repeat_words"), rules))


def shrunk(hosts: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """hosts (host, host_docs, host_failed; a written table) with host_rate and host_rejected.

    The beta prior's mean is the failure rate of all rows, its weight follows
    from how much more the hosts' rates differ than chance explains.
    """
    s = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_failed") ** 2 / F.col("host_docs")).alias("f2"), F.count("*").alias("h")).first()
    if not s["n"]:
        a = b = 1.0
    else:
        mean = min(max(s["f"] / s["n"], 1e-6), 1 - 1e-6)
        between = s["f2"] / s["n"] - (s["f"] / s["n"]) ** 2 - mean * (1 - mean) * s["h"] / s["n"]
        weight = min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e6)
        a, b = mean * weight, (1 - mean) * weight
    rate = (F.col("host_failed") + a) / (F.col("host_docs") + a + b)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > rules.max_rate)


def host_verdicts(judged: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_rejected) from rows (host, base_failed)."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    return shrunk(written(hosts), rules)


def with_verdicts(features: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """features with host_rate (null without a host), host_rejected and kept. Hosts are broadcast; beyond the bound they are joined by a shuffle."""
    hosts = host_verdicts(features, rules).select("host", "host_rate", "host_rejected")
    out = features.join(broadcast_if_small(hosts, rules.broadcast_hosts), "host", "left")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that pass their own and their host's verdict, with docs' columns.

    Texts are judged once and not shuffled: rows that pass are written, and a
    host's failures are its rows less those.
    """
    of, total, good = fresh(docs, "of", "total", "good")
    passed = written(docs.where(~base_failed(F.col(f"`{text}`"), rules)))
    counts = lambda df, name: df.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias(of)).agg(F.count("*").alias(name))
    hosts = counts(docs, total).join(counts(passed, good), of, "left")
    hosts = shrunk(written(hosts.select(F.col(of).alias("host"), F.col(total).alias("host_docs"), (F.col(total) - F.coalesce(good, F.lit(0))).alias("host_failed"))), rules)
    bad = hosts.where("host_rejected").select(F.col("host").alias(of))
    return passed.join(broadcast_if_small(bad, rules.broadcast_hosts), F.col(f"`{host}`") == F.col(of), "left_anti")


def op4_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(text_features(table(spark, sf_dir, "documents")))
    return with_verdicts(features).withColumnRenamed("key", "doc_id").withColumn("host_rate", F.round("host_rate", 9)).drop("host")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c
  FROM (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1) GROUP BY doc_id),
f AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM j WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n) AS n, sum(x) AS x, sum(x * x / n::DOUBLE) AS x2, count(*) AS h, least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS m FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(x2 / n - (x / n) ** 2 - m * (1 - m) * h / n, 1e-9) - 1, 1), 1e6) AS k FROM s),
r AS (SELECT source, (x + m * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(rate, 9) AS host_rate, coalesce(rate > 0.5, false) AS host_rejected, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM j LEFT JOIN r USING (source)
"""
