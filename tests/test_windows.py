"""Sequences over bits, block permutations and frequent sets, each against a scan."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.functions import patterns
from tallow.operators import motifs, nulls

HOUR = 3_600_000_000


@pytest.mark.parametrize("window,tolerance,order", [(5, 0, "ab"), (60, 0, "aba"), (63, 1, "abc"), (64, 0, "cab"), (130, 1, "abcab"), (None, 0, "abc")])
def test_sequences_are_those_of_a_scan(spark, window, tolerance, order):
    rng = np.random.default_rng(4)
    share = 0.02 if window and window > 50 else 0.4
    masks = {s: {c: rng.random(230) < share for c in "abc"} for s in "XY"}
    rows = [(s, k, *[bool(m[c][k]) for c in "abc"]) for s, m in masks.items() for k in range(230)]
    df = spark.createDataFrame(rows, "symbol string, ts long, a boolean, b boolean, c boolean")
    df = df.withColumns({x: F.lit(1.0) for x in ("open", "high", "low", "close", "volume")})
    spec = {"name": "SEQUENCE", "params": {"tolerance": tolerance} | ({"window": window} if window else {}), "children": list(order)}
    got = {(r.symbol, r.ts): r.hit for r in patterns.evaluate(df, spec, "hit", {c: c for c in "abc"}).collect()}
    size, want = max(window or 0, len(order)), {}
    for s, m in masks.items():
        for t in range(230):
            at, missed = max(0, t - size + 1), 0
            for c in order:
                place = next((i for i in range(at, t + 1) if m[c][i]), None)
                at, missed = (at, missed + 1) if place is None else (place + 1, missed)
            want[s, t] = missed <= tolerance
    assert got == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("n,block,splits", [(60, 5, 4), (61, 7, 6), (50, 24, 3), (40, 1, 5), (40, 100, 4), (30, 20, 6)])
def test_permutations_are_those_of_moved_rows(spark, n, block, splits):
    """Blocks within a fold, over several folds, longer than the series."""
    rng = np.random.default_rng(n)
    ret = np.round(rng.normal(0.001, 0.01, n), 5)
    df = spark.createDataFrame([("S", HOUR * k, float(x)) for k, x in enumerate(ret)], "symbol string, ts long, ret double")
    order = lambda run, b: F.pmod(b * 7 + run * 3, F.lit(11))
    got = {r.run: r.sharpe for r in nulls.permuted(df, 5, block, splits, order).collect()}
    cut = [ret[k : k + block] for k in range(0, n, block)]
    for run in range(5):
        moved = np.concatenate([cut[b] for b in sorted(range(len(cut)), key=lambda b: ((b * 7 + run * 3) % 11, b))])
        parts = np.array_split(moved, splits)
        want = np.mean([p.mean() / p.std() * np.sqrt(31_557_600 / 3600) if p.std() > 1e-12 else 0.0 for p in parts])
        assert got[run] == pytest.approx(want, rel=1e-9)


def test_constant_returns_permute_to_nothing(spark):
    df = spark.createDataFrame([("S", HOUR * k, 0.001) for k in range(60)], "symbol string, ts long, ret double")
    assert {r.sharpe for r in nulls.permuted(df, 4, 7, 6).collect()} == {0.0}


@pytest.mark.parametrize("by", [None, "key"])
def test_frequent_sets_are_those_of_a_scan(spark, by):
    rng = np.random.default_rng(2)
    items = [f"i{k}" for k in range(9)]
    rows = [("ab"[k % 2], int(rng.integers(-1, 2)), *[bool(rng.random() < 0.1 * (j + 1)) if rng.random() > 0.05 else None for j in range(9)]) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, y int, " + ", ".join(f"{i} boolean" for i in items))
    got = {((r.key,) if by else ()) + (tuple(r["items"]), r.direction): (r.support, r.lift, r.purity, r.name) for r in motifs.mine(df, items, min_support=0.05, min_lift=1.05, by=by).collect()}
    want = {}
    for key in "ab" if by else [None]:
        own = [r for r in rows if by is None or r[0] == key]
        base = {d: sum(r[1] == d for r in own) / len(own) or 1e-6 for d in (1, -1)}
        for size in (1, 2, 3):
            for s in itertools.combinations(range(9), size):
                held = [r for r in own if all(r[2 + j] for j in s)]
                for d in (1, -1):
                    good = sum(r[1] == d for r in held)
                    if held and len(held) / len(own) >= 0.05 and good and good / len(held) / base[d] >= 1.05:
                        names = tuple(items[j] for j in s)
                        want[((key,) if by else ()) + (names, d)] = (pytest.approx(len(held) / len(own)), pytest.approx(good / len(held) / base[d]), pytest.approx(good / len(held)), "_".join(names) + ("__LONG" if d > 0 else "__SHORT"))
    assert got == want and Counter(len(k[-2]) for k in want)[3] > 3
    assert motifs.mine(df.where("false"), items, by=by).isEmpty()
