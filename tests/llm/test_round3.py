"""The operators on vectors, periodic runs and licenses, each against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tallow.llm import centroids, licenses, runs


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- vectors


def plain_clusters(vectors, rules):
    """(cluster, distance) of each (id, vector), and the centroids, in Python's whole numbers."""
    q = [[math.floor(rules.scale * x) for x in v] for _, v in vectors]
    order = sorted(range(len(q)), key=lambda k: (hashlib.sha256(f"{rules.seed}:{'' if vectors[k][0] is None else vectors[k][0]}".encode()).hexdigest(), q[k]))
    c = [q[k] for k in order[: rules.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x in enumerate(c))
    for _ in range(rules.rounds):
        of = [near(v)[1] for v in q]
        for k in range(len(c)):
            own = [v for v, x in zip(q, of) if x == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own)]
    return [near(v)[::-1] for v in q], c


def odd_vectors(size, seed=1):
    rng = random.Random(seed)
    good = [(k, [rng.gauss(k % 3, 0.4) for _ in range(size)]) for k in range(60)]
    good += [(7, good[7][1]), (7, good[8][1]), (None, good[9][1]), (99, [0.0] * size), (100, [1e4, *[-1e4] * (size - 1)])]
    bad = [(200, None), (201, []), (202, [1.0] * (size - 1)), (203, [float("nan")] * size), (204, [float("inf")] * size), (205, [None, *[1.0] * (size - 1)]), (206, [3e38] * size)]
    return good, bad


@pytest.mark.parametrize("size,segment,clusters", [(64, 8, 8), (5, 2, 3), (4, 8, 100)])
def test_clusters_are_those_of_brute_force(spark, size, segment, clusters):
    rules = centroids.ClusterRules(size=size, segment=segment, clusters=clusters, rounds=4)
    good, bad = odd_vectors(size)
    good = [(k, np.float32(v).tolist()) for k, v in good]
    df = spark.createDataFrame([(k, v, 1.0, "x") for k, v in good + bad], "vec_id long, embedding array<float>, distance double, `q.x` string").repartition(3)
    want, c = plain_clusters(good, rules)
    out, got_c = centroids.clustered(df, rules)
    assert got_c.tolist() == c
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, [(r["id"], r["cluster"], r["distance"]) for r in rows(out)])) == sorted(map(key, [(k, *x) for (k, _), x in zip(good, want)]))


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op11_block_norms(spark, str(tmp_path)).isEmpty()


def test_norms_spare_distances():
    rng = np.random.default_rng(2)
    c = (np.repeat(rng.integers(0, 900, (8, 8)), 8, axis=1)).astype(np.int64)
    q = c[rng.integers(0, 8, 500)] + rng.integers(-20, 20, (500, 64))
    near, dist, taken = centroids.nearest(q, centroids.segment_norms(q, 8), c, 8)
    every = ((q[:, None] - c) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all() and taken < 1000


def test_cluster_query_is_its_sql(spark, tmp_path):
    good, bad = odd_vectors(64, 4)
    good = [(k, v) for k, v in enumerate(v for _, v in good)]
    spark.createDataFrame([(k, v, 0) for k, v in good + bad if v is None or None not in v if v != [3e38] * 64], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(centroids.OP11_SQL)
    assert sorted(tuple(r[c] for c in want.columns) for r in rows(centroids.op11_block_norms(spark, str(tmp_path)))) == sorted(want.fetchall())


# --- periodic runs


def plain_runs(w, least=24, periods=3):
    """(start, length, period) by start, then period: maximal stretches that keep a period, each with its smallest."""
    out = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        rules = runs.RunRules(rng.choice([3, 6, 12, 24]), rng.choice([3, 4]))
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 120), rng.choice([1, 2, 3, 5])
            x = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            texts.append(x)
        got = runs._runs_of([np.array(x, np.int64) for x in texts], rules)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(x, rules.min_words, rules.min_periods) for x in texts]


def test_runs_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [np.tile(rng.integers(0, 50, int(p)), 5) for p in rng.integers(5, 40, 30)]
    whole = runs._runs_of(texts, runs.RunRules())
    monkeypatch.setattr(runs, "_BLOCK", 64)
    monkeypatch.setattr(runs, "_PAIRS", 10)
    parts = runs._runs_of(texts, runs.RunRules())
    assert all((a == b).all() for a, b in zip(whole, parts)) and all(map(len, whole))


def test_periodic_runs(spark, odd, none):
    more = spark.createDataFrame([(60, "one two three " * 8 + "end", "en", "a", 1, 7), (61, ("b " * 30 + "a ") * 4, "en", "a", 1, 7), (62, " ".join(["x"] * 40000), "en", "a", 1, 7)], odd.schema)
    docs = odd.union(more)
    want = []
    for r in docs.collect():
        w = (r.text or "").encode().split()
        found = plain_runs(w) if r.doc_id != 62 else [(0, 40000, 1)]
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want.append((r.doc_id, len(w), found, best, plain_collapsed(w, found).decode()))
    got = [(r["id"], r["n_words"], [tuple(x.values()) for x in r["runs"]], r["best"] and tuple(r["best"].values()), r["collapsed"]) for r in rows(runs.periodic_runs(docs))]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(len(x[2]) > 2 for x in want)
    assert runs.periodic_runs(none).isEmpty()


def test_run_query(spark, odd, tmp_path):
    rng = random.Random(8)
    more = [(300 + k, " \n".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 300))), "en", "a", 1, 7) for k in range(60)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in docs.collect():
        w, h = (r.text or "").encode().split(), None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        want.append((r.doc_id, len(w), len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(plain_collapsed(w, found)).hexdigest()))
    got = [tuple(r.values()) for r in rows(runs.op12_periodic_runs(spark, str(tmp_path)))]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] > 0 for x in want) > 2


# --- licenses


def plain_words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def plain_licenses(text, rules=licenses.RULES, phrases=licenses.PHRASES):
    w = plain_words(text)
    t = f" {'  '.join(w)} "
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(licenses.spaced(r.pattern), t):
            start = t[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2, r.priority, k))
    holds = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and a[2] >= b[2] and (a[:2] != b[:2] or (-a[2], a[3]) < (-b[2], b[3]))
    kept = sorted((f[0], f[1], rules[f[3]].label, f[3]) for f in found if not any(holds(g, f) for g in found))
    score = max([rules[f[3]].weight for f in kept] + [licenses.PHRASE_WEIGHT] * bool(places), default=0.0)
    return len(w), places, kept, sorted({x[1] for x in places} | {x[2] for x in kept}), score


TEXTS = [
    "Released under the MIT License. Under the mit-license; UNDER THE MIT LICENSE!", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc sa 4.0 cc by-nc-nd",
    "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, or any later version", "GNU Lesser General Public License v2.1, LGPLv3, GPL 3",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "see https://creativecommons.org/licenses/by-nc-sa/4.0/ and http://www.apache.org/licenses/LICENSE-2.0", "BSD 3-Clause license; 2 clause BSD", "das ist mit dem Hund", "Kelvin mit license", "İ under the mit license", "émit license mité",
    "Mozilla Public License 1.1 or MPL 2.0, EPL-2.0. All rights reserved.", " ".join(["under the mit license"] * 3000), "a\x00b under\x00the mit license",
]


@pytest.mark.parametrize("own", [False, True])
def test_licenses_are_those_of_brute_force(spark, odd, own):
    phrases = {"a b a": "aba", "under the mit license": "mit"} if own else licenses.PHRASES
    rules = [licenses.Rule("x", ("a",), "a b a", 1, 0.2), licenses.Rule("y", ("b",), "(?:a )?b", 2, 0.3), licenses.Rule("z", ("a",), "a b", 2, 0.4)] if own else licenses.RULES
    more = spark.createDataFrame([(100 + k, t, "en", "a", 1, 7) for k, t in enumerate([*TEXTS, TEXTS[0], "a b a b a c a b", "b"])], odd.schema)
    docs = odd.union(more).withColumnRenamed("size", "found.x")
    got = [(r["id"], r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), [(d["start"], d["end"], d["label"], d["rank"]) for d in r["detections"] or []], r["labels"], r["score"]) for r in rows(licenses.licensed(docs, rules, phrases))]
    want = [(r.doc_id, *plain_licenses(r.text, rules, phrases)) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_licenses(none):
    assert licenses.licensed(none).isEmpty()


def test_license_query_is_its_sql(spark, odd, tmp_path):
    more = spark.createDataFrame([(100 + k, t, "en", "a", 1, 7) for k, t in enumerate(TEXTS)], odd.schema)
    odd.union(more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.OP13_SQL)
    got = [tuple(r[c] for c in want.columns) for r in rows(licenses.op13_license_rules(spark, str(tmp_path)))]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    labels = {r[0]: r[want.columns.index("labels")] for r in want.fetchall()}
    assert labels[102] == "cc-by-nc,cc-by-nc-4" and labels[104] == "gpl-3" and labels[110] == ""


def test_every_rule_needs_words_that_its_matches_hold():
    assert len(licenses.RULES) > 300
    for r in licenses.RULES:
        plain = re.sub(r"\(\?:[^()]*\)\?", " ", re.sub(r"\(\?:[^()]*\)\?", " ", r.pattern)).replace("[cs]", "?")
        words = set(re.findall(r"[a-z0-9]+", plain.replace("v?", " "))) | {x for x in ("license", "licence") if f"{x}" in r.pattern}
        assert set(r.needs) <= words, r
