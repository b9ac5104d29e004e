"""URL rules answered by Bloom filter cascades (native DataFrame functions only).

A rule is a host and a path prefix; it fits its host, all subdomains and every
path that starts with its own. The keys of a url are all pairs of a suffix of
its host and a prefix of its path that a rule could have; the longest listed
key decides. The cascade's first filter holds the listed keys, the second the
keys of the corpus that the first takes for listed, the third the listed keys
that the second takes for those, and so on until nothing is left to tell apart.
Over the keys of the corpus the answer is then exact, and no join is needed.

Defined results: a null url or one without '://' has an empty host and path and
fits no rule; a url that fits no rule is allowed; repeated rows are judged
alike; rules repeated with different verdicts are refused; empty tables give no
rows; other columns play no part and may have any name. A filter is bytes of
seven bits, one literal of the plan that goes to every task: about 1.65 bits for
each listed key and halving of the false positives, so 100 million rules take
some 100 MB.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


#: Bits of one part of a filter. Filters of more bits have several parts, chosen by a hash of the key.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: the bytes of each part, seven bits in each so that a byte is an ASCII character, the number of its hashes, its level as the hashes' seed."""

    parts: list[bytes]
    hashes: int
    level: int

    @property
    def bits(self) -> int:
        return 7 * len(self.parts[0])

    def holds(self, key: Column) -> Column:
        own = [F.lit(p) for p in self.parts]  # one literal for each part, whatever the number of hashes
        held = own[0] if len(own) == 1 else F.get(F.array(*own), _part(key, self.level, len(own)))
        out = F.lit(True)
        for place in _places(key, self.hashes, self.level, self.bits):
            byte = F.ascii(F.substring(held, _byte(place) + 1, F.lit(1)).cast("string"))
            out = out & (F.getbit(byte, (place % 7).cast("int")) == 1)
        return out


def _byte(place: Column) -> Column:
    return ((place - place % 7) / 7).cast("int")


def _places(key: Column, hashes: int, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)).cast("long") for j in range(hashes)]


def _part(key: Column, level: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit("part"), key), F.lit(parts)).cast("int")


def _filter(keys: DataFrame, n: int, rate: float, level: int, most: int = MAX_BITS) -> Filter:
    """A filter of the n keys (key) with about that rate of false positives. Only its bytes come to the driver, one part at a time."""
    rate = min(max(rate, 1e-6), 0.5)
    bits = max(63, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    parts = -(-bits // (most - most % 7))  # whole bytes of seven bits
    size = -(-bits // (7 * parts))
    hashes = min(max(1, round(7 * size * parts / max(n, 1) * math.log(2))) if n else 1, 20)
    place = keys.select(_part(F.col("key"), level, parts).alias("part"), F.explode(F.array(*_places(F.col("key"), hashes, level, 7 * size))).alias("p"))
    mask = F.expr("shiftleft(1, cast(p % 7 as int))")
    held = written(place.groupBy("part", _byte(F.col("p")).alias("at")).agg(F.bit_or(mask).alias("bits")))
    out = []
    for k in range(parts):
        got, own = held.where(F.col("part") == k).select("at", "bits").toArrow(), np.zeros(size, np.uint8)
        own[got["at"].to_numpy()] = got["bits"].to_numpy()
        out.append(own.tobytes())
    return Filter(out, hashes, level)


class Cascade:
    """Exact membership of the keys of a known universe in a list."""

    def __init__(self, filters: list[Filter]):
        self.filters = filters

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most: int = 64, bits: int = MAX_BITS) -> Cascade:
        """listed, universe: tables of distinct keys (key). Listed keys that the universe lacks are held as well."""
        inside, outside = listed, written(universe.join(listed, "key", "left_anti"))
        n, others = inside.count(), outside.count()
        filters: list[Filter] = []
        while n and len(filters) < most:
            rate = n / max(others, 1) * math.sqrt(0.5) if not filters else 0.5
            f = _filter(inside, n, rate, len(filters), bits)
            filters.append(f)
            false = written(outside.where(f.holds(F.col("key"))))
            inside, outside, others = false, inside, n
            n = false.count()
        if n:
            raise ValueError("the cascade does not end")
        return cls(filters)

    def holds(self, key: Column) -> Column:
        """The first filter that lacks the key decides: lacking an odd level means not listed."""
        out = F.lit(len(self.filters) % 2 == 1)
        for f in reversed(self.filters):
            out = F.when(f.holds(key), out).otherwise(F.lit(f.level % 2 == 1))
        return out


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _keys(rules: DataFrame, lengths: list[int]) -> tuple[Column, Column]:
    """All keys of columns (host, path), longest first, and the keys' shape: every host suffix with every path prefix of a rule's length."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return suffixes, prefixes


def with_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """urls (host, path, ..) with keys, the longest first. A url without a host has none."""
    suffixes, prefixes = _keys(urls, lengths)
    urls = urls.withColumn("suffixes", suffixes).withColumn("prefixes", prefixes)
    pairs = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: F.concat(s, p))))
    longest = F.transform(F.sort_array(F.transform("all", lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])
    urls = urls.withColumn("all", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(pairs))
    return urls.withColumn("keys", longest).drop("suffixes", "prefixes", "all")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row of pages. rules: (host, path, verdict), verdict allow or block."""
    rules = written(rules.select((F.concat("host", "path")).alias("key"), "verdict", F.char_length("path").alias("n")).distinct())
    if not rules.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a rule has two verdicts")
    lengths = sorted((r["n"] for r in rules.select("n").distinct().collect()), reverse=True)  # as many as path lengths among rules
    urls = pages.select(F.col(f"`{key}`").alias("id"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    if not lengths:
        return urls.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    urls = with_keys(urls, lengths)
    universe = written(urls.select(F.explode("keys").alias("key")).distinct())
    block, allow = (Cascade.build(written(rules.where(F.col("verdict") == v).select("key")), universe) for v in ("block", "allow"))
    fits = F.filter("keys", lambda k: block.holds(k) | allow.holds(k))
    urls = urls.withColumn("rule", F.get(fits, F.lit(0)))
    verdict = F.when(F.col("rule").isNotNull() & block.holds(F.col("rule")), "block").otherwise("allow")
    return urls.select("id", "host", "path", "rule", verdict.alias("verdict"))


#: The contract's rules, fixed values.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP9_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
b AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)
"""
