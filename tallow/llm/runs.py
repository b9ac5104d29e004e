"""Periodic runs of words by a harmonic grid of common-extension queries.

A run is a stretch of words of smallest period q that holds three periods and
some words at least, and that no neighbouring word extends. For every period p
the grid points jp and (j+1)p are held against each other: how far the words
from them on are alike (forward) and how far those before them (backward). Both
are range minima over the common prefixes of neighbouring suffixes in a suffix
array, of the words and of the reversed words. A run of period p covers such a
pair, so the extensions give it whole.

A pair's query is asked only where the next few words from both points on have
the same hash (nine words, for the usual rules): at a run's first pair of grid
points so many are alike, so no run is lost, and a hash that misleads costs a
query. Texts without a
surviving pair have no runs, and no suffix array. Texts are taken some at a time
as one sequence with a separator of its own between any two.

Defined results: a null text has no words and no runs; repeated rows are judged
one by one; a null id stays null; an empty table gives no rows; other columns
play no part and may have any name. A text is held whole in one task: its words,
and about a hundred numbers for each of its words if it has repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words


@dataclass(frozen=True)
class RunRules:
    #: Words and periods that a run holds at least.
    min_words: int = 24
    min_periods: int = 3


#: Words of a sequence of texts, and grid pairs looked at in one step.
_BLOCK, _PAIRS = 1 << 17, 1 << 20


def gram(rules: RunRules) -> int:
    """How many words from a run's first grid pair on are alike at least, for the worst period."""
    return min(max(rules.min_words, rules.min_periods * p) - 2 * p + 1 for p in range(1, rules.min_words + 2))


class Extensions:
    """Common prefixes of any two suffixes of a sequence of numbers, by suffix array and range minima."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels, k = [rank], 1
        while rank.max() < n - 1 and k < n:  # prefix doubling
            second = np.zeros(n, np.int64)
            second[:-k] = rank[k:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            levels.append(rank)
            k *= 2
        order = np.argsort(rank)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):  # the prefixes that neighbours share, from the ranks of halves
            step = 1 << level
            fit = np.flatnonzero(np.maximum(a, b) + step <= n)
            same = fit[levels[level][a[fit]] == levels[level][b[fit]]]
            a[same] += step
            b[same] += step
            common[same] += step
        self.minima = [common.astype(np.int32)]
        while 1 << len(self.minima) < n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            if len(last) <= half:
                break
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lengths of the common prefixes of the suffixes at i and at j, i and j not equal."""
        a, b = self.rank[i], self.rank[j]
        low, width = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            own = level == k
            m = self.minima[k]
            out[own] = np.minimum(m[low[own]], m[low[own] + width[own] - (1 << int(k))])
        return out


def _hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size numbers from each place on; places too near the end are left out."""
    h = np.zeros(max(len(x) - size + 1, 0), np.uint64)
    y = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    y ^= y >> np.uint64(29)
    for d in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + y[d : d + len(h)]
    return h ^ (h >> np.uint64(31))


def _grid(h: np.ndarray, n: int, rules: RunRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, periods) of the grid pairs of a text of n words whose hashes agree, in ascending periods."""
    most = n // rules.min_periods
    p = np.arange(1, most + 1)
    pairs = np.maximum((len(h) - 1) // p, 0)  # jp and (j + 1)p both have a hash
    upto = np.concatenate([[0], np.cumsum(pairs)])
    at = 0
    while at < most:
        end = max(int(np.searchsorted(upto, upto[at] + _PAIRS, "right")) - 1, at + 1)
        period = np.repeat(p[at:end], pairs[at:end])
        point = (np.arange(upto[at], upto[end]) - np.repeat(upto[at:end], pairs[at:end])) * period
        same = h[point] == h[point + period]
        yield point[same], period[same]
        at = end


def _runs_of(texts: list[np.ndarray], rules: RunRules) -> list[np.ndarray]:
    """For each text (its words as numbers) the rows start, length, period of its runs, by start, then period."""
    size, none = gram(rules), np.empty((0, 3), np.int64)
    out, found = [none] * len(texts), []
    for k, x in enumerate(texts):
        h = _hashes(x, size)
        if len(x) < rules.min_words or len(np.unique(h)) == len(h):
            continue
        got = [g for g in _grid(h, len(x), rules) if len(g[0])]
        if got:
            found.append((k, *(np.concatenate(y) for y in zip(*got, strict=True))))
    while found:  # as many texts as fit in a block, one at least
        n, total = 0, 0
        while n < len(found) and (not n or total + len(texts[found[n][0]]) < _BLOCK):
            total += len(texts[found[n][0]])
            n += 1
        for k, rows in _extended(texts, found[:n], rules):
            out[k] = rows
        found = found[n:]
    return out


def _extended(texts: list[np.ndarray], found: list, rules: RunRules) -> Iterator[tuple[int, np.ndarray]]:
    top, parts, begins, at = max(int(texts[k].max()) for k, *_ in found) + 1, [], [], 0
    for m, (k, *_) in enumerate(found):
        parts += [np.array([top + m]), texts[k]]
        begins.append(at + 1)
        at += 1 + len(texts[k])
    x = np.concatenate([*parts, [top + len(found)]]).astype(np.int64)
    a = np.concatenate([p + b for (_, p, _), b in zip(found, begins, strict=True)])
    period = np.concatenate([q for *_, q in found])
    owner = np.repeat(np.arange(len(found)), [len(p) for _, p, _ in found])
    forward = Extensions(x).query(a, a + period)
    backward = Extensions(x[::-1]).query(len(x) - a, len(x) - a - period)  # the word before a, from the other end
    start, length = a - backward, backward + forward + period
    fit = length >= np.maximum(rules.min_words, rules.min_periods * period)
    rows = np.stack([owner, start - np.array(begins)[owner], length, period], axis=1)[fit]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)  # the same stretch has its smallest period once, then multiples
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for m, (k, *_) in enumerate(found):
        yield k, rows[rows[:, 0] == m, 1:]


def collapsed(split: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(split)
    edge = np.zeros(len(split) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([split[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def best_run(runs: np.ndarray) -> tuple | None:
    """Of rows by start, then period, the one of the greatest exact length / period; of ties the first."""
    return max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows and, but for a longer text, so many bytes of its column 1."""
    at, total = 0, 0
    for k in range(batch.num_rows):
        own = len(batch.column(1)[k].as_py() or b"")
        if k > at and (k - at == rows or total + own > size):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += own
    yield batch.slice(at)


def _judged(rules: RunRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                number: dict[bytes, int] = {}
                split = [(t.as_py() or b"").split() for t in part.column(1)]
                runs = _runs_of([np.fromiter((number.setdefault(w, len(number)) for w in s), np.int64, len(s)) for s in split], rules)
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                every = np.concatenate(runs) if len(runs) else np.empty((0, 3), np.int64)
                struct = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], names=["start", "length", "period"])
                best = pa.array([r and dict(zip(("start", "length", "period"), r, strict=True)) for r in map(best_run, runs)], struct.type)
                text = pa.array([collapsed(s, r) for s, r in zip(split, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in split], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), struct), best, text], names=["id", "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs by start and period, best, collapsed) of each row of docs; best is the run of the greatest exponent."""
    if min(rules.min_words, rules.min_periods) < 3 or gram(rules) < 1:
        raise ValueError("runs hold three words and three periods at least")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind, run = rows.schema["id"].dataType.simpleString(), "struct<start: long, length: long, period: long>"
    return rows.mapInArrow(_judged(rules), f"id {kind}, n_words long, runs array<{run}>, best {run}, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text of the contract: where crc32 of the id is a multiple of ten, its words from some place on repeat with a period. A null id has no crc32."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        start = (g % F.greatest(n, F.lit(1))).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        some = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < start, i).otherwise(start + (i - start) % period)))
        return F.when(n > 0, F.array_join(some, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
