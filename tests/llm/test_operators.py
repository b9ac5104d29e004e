import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallow.llm import classlm, decontaminate, langid, minmax, mixing, quality, sharding, tokencount, toxicity, urlfilter


def rows(df):
    return [r.asDict() for r in df.collect()]


def split(text):
    return (text or "").encode().lower().split()


def test_quality(odd, none):
    got = Counter((r["key"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in rows(quality.text_features(odd)))
    want = Counter()
    for r in odd.collect():
        w = (r.text or "").encode().split()
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {p for k, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for p in range(k, k + 3)}
        want[r.doc_id, len(w), len(covered), len(w) < 50 or 2 * len(covered) > len(w)] += 1
    assert got == want
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k[0] for k, n in want.items() for _ in range(n) if not k[3])
    assert quality.keep_good(none).isEmpty() and quality.with_verdicts(quality.text_features(none)).isEmpty()


def test_a_bad_host_goes(spark, tmp_path):
    """The query's SQL sees hosts that go and hosts that stay; rows of a bad host go with it."""
    good = " ".join(f"word{k}" for k in range(60))
    docs = [(k, "short text" if k % 10 else good, "en", "bad") for k in range(100)] + [(100 + k, good if k % 5 else "x", "en", f"h{k % 4}") for k in range(200)] + [(999, good, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(quality.op4_quality_hosts(spark, str(tmp_path)))
    assert {r["doc_id"] for r in got if r["host_rejected"]} == set(range(100)) and sum(r["kept"] for r in got) == 161
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(quality.OP4_SQL)
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())
    kept = quality.keep_good(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def shingles(text, n):
    w = split(text)
    return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} - {()}


def near_components(docs, n):
    """For each (id, text) the numbers of all rows that it reaches by links."""
    sets, comp = [shingles(t, n) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[a] if c == comp[b] else c for c in comp]
    return [[k for k in range(len(docs)) if comp[k] == c] for c in comp]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_groups(odd, none, kind):
    more = odd.sparkSession.createDataFrame([(10, "quite another text under a used id", "en", "a", 1, 7), (None, None, "en", "a", 1, 7), (None, "lost words here", "en", "a", 1, 7)], odd.schema)
    docs = odd.union(more).withColumn("doc_id", F.col("doc_id").cast(kind))
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    comp = [min((plain[k][0] for k in c if plain[k][0] is not None), default=None) for c in near_components(plain, 2)]
    got = Counter((r["id"], r["n"], r["comp"]) for r in rows(minmax.near_groups(docs)))
    assert got == Counter((i, len(shingles(t, 2)), c) for (i, t), c in zip(plain, comp))
    kept = minmax.drop_near(docs)
    assert kept.columns == docs.columns
    groups = {tuple(c): min((plain[k][0] is None, plain[k][0]) for k in c) for c in near_components(plain, 5)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for _, i in groups.values())
    assert minmax.near_groups(none).isEmpty() and minmax.drop_near(none).isEmpty()


@pytest.mark.parametrize("rules", [minmax.NearRules(pivots=0), minmax.NearRules(pivots=0, block=4), minmax.NearRules(pivots=1, block=4), minmax.NearRules()])
def test_pairs_that_pivots_leave_over(spark, rules):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"x{rng.integers(999)}" if rng.random() < 0.05 else w for w in base[: 60 - k % 9]) for k in range(40)]
    docs = list(enumerate(texts))
    comp = [min(c) for c in near_components(docs, 2)]
    assert 1 < len(set(comp)) < 40
    assert {r["id"]: r["comp"] for r in rows(minmax.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), rules))} == dict(enumerate(comp))


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.comp for r in minmax.components(links).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def brute_overlaps(docs, items):
    """(id, item) where the whole item or, of longer ones, 13 tokens in a row agree in 80 % with the document at one placing."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, item in items:
        t = tokens(item)
        n = min(13, len(t))
        for d, text in docs:
            w = tokens(text)
            for shift in range(-len(t), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == t[k] for k in range(len(t))]
                if n and i is not None and any(100 * sum(same[s : s + n]) >= 80 * n for s in range(len(t) - n + 1)):
                    out.add((d, i))
    return out


def test_decontamination(spark, odd, none):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    changed = [w if k % 7 else "other" for k, w in enumerate(passage)]
    docs = spark.createDataFrame([(1, "before " + " ".join(passage).upper() + "! after"), (2, " ".join(["so"] * 20 + changed)), (3, " ".join(passage[:6]) + " and nothing else that is alike in any way at all here"), (4, None), (None, " ".join(passage)), (None, "clean"), (4, " ".join(passage))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage)), (8, "a tiny item it is"), (9, ""), (None, "x")], "item_id long, text string")
    assert sorted((str(r["id"]), r["item"]) for r in rows(decontaminate.overlaps(docs, items))) == [("1", 7), ("2", 7), ("4", 7), ("None", 7)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert Counter(map(tuple, kept.collect())) == Counter([(3, docs.collect()[2].text), (4, None), (None, "clean")])
    dotted = docs.withColumnRenamed("text", "a.text").withColumn("hit", F.lit(1)).withColumn("item", F.lit(1))
    assert decontaminate.drop_contaminated(dotted, items, text="a.text").columns == dotted.columns
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count()
    assert decontaminate.overlaps(none, items).isEmpty() and decontaminate.overlaps(docs, items.limit(0)).isEmpty()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_overlaps_are_those_of_brute_force(spark, broadcast):
    """Items of 1 to 30 tokens, with substitutions up to and beyond what is allowed, ids null and repeated, by broadcast and by shuffle."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30])] + [(None, "w1 w2")]
    docs = []
    for i, item in items[:-1]:
        for changes in range(5):
            t = item.split()
            for p in rng.sample(range(len(t)), min(changes, len(t))):
                t[p] = "zz"
            docs.append((rng.choice([None, i, 7]), " ".join([word() for _ in range(rng.randrange(9))] + t + [word() for _ in range(rng.randrange(9))])))
    docs = [(k if d is not None else None, t) for k, (d, t) in enumerate(docs)] + [(3, docs[0][1]), (None, None), (5, "")]
    rules = decontaminate.SeedRules(broadcast_seeds=broadcast)
    got = {(r["id"], r["item"]) for r in rows(decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rules))}
    want = brute_overlaps(docs, items)
    assert got <= want and len(got) >= 0.99 * len(want) > 30
    short = {i for i, t in items if len(t.split()) <= 13}
    assert {p for p in got if p[1] in short} == {p for p in want if p[1] in short}


@pytest.mark.parametrize("length", range(1, 14))
def test_masks_hit_every_allowed_pattern(length):
    masks = decontaminate.SeedRules().masks if length == 13 else decontaminate.short_masks(length, 80)
    placed = [{x + at for x in m} for m in masks for at in range(length - m[-1])]
    for lost in itertools.combinations(range(length), length - -(-80 * length // 100)):
        assert any(not m & set(lost) for m in placed)


def test_decontamination_is_alike_by_broadcast_and_shuffle(spark):
    passage = [f"p{k}" for k in range(20)]
    texts = [(1, "before " + " ".join(passage)), (1, "quite other words that are long enough to have many seeds"), (2, " ".join(passage[:15])), (2, " ".join(passage[:15])), (None, " ".join(passage[3:])), (None, "nothing"), (3, " ".join(passage + passage))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage)), (8, " ".join(passage[2:19])), (9, "p3 p4 p5 p6 p7")], "item_id long, text string")
    got = [sorted(map(tuple, decontaminate.overlaps(docs, items, decontaminate.SeedRules(broadcast_seeds=b)).collect()), key=str) for b in (500_000, 0)]
    assert got[0] == got[1] and {(r[0], r[1]) for r in got[1]} == {(i, t) for i in (1, 2, 3, None) for t in (7, 8, 9)}
    spans = (5, 8, 9, 10)  # a whole passage has a hit of each mask at each place where it fits
    assert [r[2] for r in got[1] if r[:2] == (1, 7)] == [sum(20 - x + 1 for x in spans)] and [r[2] for r in got[1] if r[:2] == (2, 7)] == [2 * sum(15 - x + 1 for x in spans)]


def mix_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, target = {x: weights[k % 3] for k, x in enumerate(names)}, {}
    left = 1.5 * sum(sizes.values())
    while len(target) < len(names):
        level = left / sum(weight[x] for x in names if x not in target)
        full = [x for x in names if x not in target and 2 * sizes[x] <= weight[x] * level]
        target |= {x: 2.0 * sizes[x] for x in full} if full else {x: weight[x] * level for x in names if x not in target}
        left = 1.5 * sum(sizes.values()) - sum(target[x] for x in target)
    return target


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mixing(odd, none, block):
    rules = mixing.MixRules(block=block, shards=3)
    docs = odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    got = rows(mixing.mixed(docs, rules))
    place = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", mixing._place("doc_id", "text", rules.seed).alias("h")).collect()}
    plain = sorted(((r.source, place[r.doc_id, r.text], r.doc_id, len(split(r.text))) for r in docs.collect()), key=str)
    sizes = Counter()
    for s, _, _, n in plain:
        sizes[s] += n
    target = mix_targets(sizes)
    quota = Counter()
    for _ in range(round(sum(target.values()) / block)):
        quota[max(target, key=lambda s: (target[s] / (2 * quota[s] + 1), -sorted(target, key=lambda x: (x is None, x or "")).index(s)))] += 1
    want = Counter()
    for s in sizes:
        run = -(-sizes[s] // block)
        q = min(quota[s], 2 * run)
        passes, extra, offset = (q // run, q % run, 0) if run else (0, 0, 0)
        for _, h, i, n in sorted(x for x in plain if x[0] == s):
            want[i, n, sizes[s], round(target[s], 6), passes * n + max(0, min(offset + n, extra * block) - offset), q] += 1
            offset += n
    assert Counter((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["quota"]) for r in got) == want
    shards = defaultdict(Counter)
    for r in got:
        assert sum(p["words"] for p in r["parts"]) == r["taken"] <= 2 * r["size"]
        for p in r["parts"]:
            shards[r["source_size"], r["quota"]][p["shard"], p["block"], p["copy"]] += p["words"]
    for (_, q), taken in shards.items():  # of full blocks, each shard has as many as any other, but for one
        per = Counter(k[0] for k in taken)
        assert len(taken) == q and max(per.values()) - min(per[x] for x in range(3)) <= 1
    assert mixing.mixed(none).isEmpty() and mixing.take_mix(none).isEmpty()
    assert rows(mixing.mixed(docs).orderBy("id", "size", "taken")) == rows(mixing.mixed(docs.repartition(3)).orderBy("id", "size", "taken"))


def test_the_mix_takes_rows_as_often_as_their_words(odd):
    docs = odd.where("doc_id is not null and doc_id <> 12")
    taken = {r["id"]: r["taken"] / r["size"] if r["size"] else 0 for r in rows(mixing.mixed(docs))}
    got = mixing.take_mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: math.floor(x + 0.5) for i, x in taken.items() if x >= 0.5})


def test_apportionment_is_by_highest_quotients(spark):
    aims = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.5)]
    df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(aims)], "source string, target double, rank long")
    for seats in (1, 7, 50):
        q = Counter()
        for _ in range(seats):
            q[max(aims, key=lambda a: a[1] / (2 * q[a[0]] + 1))[0]] += 1
        assert {r.source: r.quota for r in mixing.apportioned(df, seats).collect()} == {s: q[s] for s, _ in aims}


def test_sharding(odd, none):
    got = rows(sharding.sharded(odd, sharding.TreeRules(shards=3)))
    assert len(got) == odd.count() and {r["shard"] for r in got} <= {0, 1, 2}
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sum(r["size"] for r in got) == sum(len((r.text or "").encode()) + 8 for r in odd.collect())
    placed = sharding.with_shards(odd.withColumns({"m": F.lit(1), "crc": F.lit(2), "Shard": F.lit(3)}), sharding.TreeRules(shards=3))
    assert placed.columns[:-1] == [*odd.columns, "m", "crc", "Shard"]
    assert Counter((r[0], r[-1]) for r in placed.collect()) == Counter((r["id"], r["shard"]) for r in got)
    assert sharding.sharded(none).isEmpty() and sharding.with_shards(none).isEmpty()


def kd(points, first, shards):
    """{place in points: shard} by weighted medians: points are (size, dims, crc, tie); a key is a point's place along the widest dimension."""
    if shards == 1 or not points:
        return dict.fromkeys(points, first)
    values = [[p[1][d] for p in points.values()] for d in range(3)]
    d = max(range(3), key=lambda x: (max(values[x]) - min(values[x]), -x))
    keys = {k: (int(p[1][d] * (2**20 - 1)) << 42) + (p[2] >> 8 << 18) + p[3] for k, p in points.items()}
    aim, best = sum(p[0] for p in points.values()) * (shards // 2) / shards, None
    upto = 0
    for key in sorted(set(keys.values())) + [1 << 62]:  # below key lie upto bytes
        if best is None or abs(upto - aim) < abs(best[1] - aim):
            best = key, upto
        upto += sum(points[k][0] for k in keys if keys[k] == key)
    low = {k: p for k, p in points.items() if keys[k] < best[0]}
    high = {k: p for k, p in points.items() if keys[k] >= best[0]}
    return kd(low, first, shards // 2) | kd(high, first + shards // 2, shards - shards // 2)


def test_shards_are_those_of_brute_force(odd):
    rules = sharding.TreeRules(shards=5, slack=0.0, whole=0.0)
    pts = odd.select("doc_id", "text", "source", "lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")).collect()
    least = {}
    for r in pts:
        m = (r.source or "", r.lang or "")
        least[r.text or ""] = min(m, least.get(r.text or "", m))
    unit = lambda x: zlib.crc32(x.encode()) / 2**32
    plain = {}
    for k, r in enumerate(pts):
        text = (r.text or "").encode()
        plain[k] = (len(text) + 8, (math.log2(len(text) + 8) / 40, *map(unit, least[r.text or ""])), zlib.crc32(text), (r.h & (1 << 64) - 1) >> 46)
    want = kd(plain, 0, 5)
    assert Counter((r["id"], r["text_crc32"], r["shard"]) for r in rows(sharding.sharded(odd, rules))) == Counter((r.doc_id, plain[k][2], want[k]) for k, r in enumerate(pts))


def test_shards_are_of_near_equal_bytes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.hash("id") % 50 + 60).cast("int")).alias("text"), (F.col("id") % 7).cast("string").alias("source"), F.when(F.col("id") % 3 > 0, "en").alias("lang"))
    sizes = [r.z for r in sharding.sharded(docs).groupBy("shard").agg(F.sum("size").alias("z")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 24
    small = sharding.TreeRules(target_bytes=5000)
    assert sharding.sharded(docs, small).select("shard").distinct().count() == -(-sum(sizes) // 5000)


def test_equal_texts_stay_together(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat((F.col("id") % 1000).cast("string"), F.lit(" word ")), 20).alias("text"), (F.col("id") % 7).cast("string").alias("source"), F.lit("en").alias("lang"))
    split_groups = sharding.sharded(docs).groupBy("text_crc32").agg(F.count_distinct("shard").alias("k")).where("k > 1").count()
    assert split_groups == 0


def test_token_counts(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(90, "end<|endoftext|> of  text\n\n don't 日本語 ١٢ ü\u2028x"), (91, "\x1c a\x85b ")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(extra)
    tok = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    assert Counter((r["id"], r["n_bytes"], r["n_tokens"]) for r in rows(tokencount.token_counts(docs, path))) == want
    assert tokencount.token_counts(none, path).isEmpty()


@pytest.mark.parametrize("head", [None, 30, 12])
def test_lm_scores(spark, odd, none, head):
    """Counts, classes and scores of plain Python, with words that have numbers and words that have none."""
    rng = np.random.default_rng(9)
    more = [(100 + k, " ".join(f"{'ab'[p % 2]}{int(x)}" for p, x in enumerate(rng.zipf(1.5, 40) % 25)), "en", "a", 1, 7) for k in range(60)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    rules = classlm.ClassRules(seeded=8, classes=4, least=3)
    got = rows(classlm.lm_scores(docs, rules, head=head))
    plain = [(r.doc_id, split(r.text)) for r in docs.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = [w for i, w in plain if not held(i)]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()) + len(train), len(c) + 1

    order = sorted(c, key=lambda w: (-c[w], w))
    levels, floor, upto = defaultdict(list), 1 << 62, 0
    for w in order:
        levels[math.floor(math.log2(c[w]) * 16)].append(c[w])
    for x in sorted(levels, reverse=True):
        upto += len(levels[x])
        if upto > (head or 1 << 18):
            break
        floor = min(levels[x])
    words = [w for w in order if c[w] >= floor]
    seeded = {w: k for k, w in enumerate(words[:8])}
    m = len(seeded)
    big = np.zeros((m + 2, m + 2))
    for d in train:
        line = [m + 1, *(seeded.get(w, m) for w in d), m + 1]
        for a, b in zip(line, line[1:]):
            big[a, b] += 1
    at = classlm.exchange(big, 4, rules.passes)
    k = int(at[-1]) + 1
    cls = {w: int(at[j]) for w, j in seeded.items()}

    def matrix():
        g = np.zeros((k, k))
        beside = defaultdict(lambda: np.zeros((2, k)))
        for d in train:
            line = [k - 1, *(cls.get(w, k - 2) for w in d), k - 1]
            for p, (a, b) in enumerate(zip(line, line[1:])):
                g[a, b] += 1
                if p:
                    beside[d[p - 1]][:, :] += [np.eye(k)[line[p - 1]], np.eye(k)[b]]
        return g, beside

    def moved(some):
        g, beside = matrix()
        out = {}
        for w in some:
            old = cls.get(w, k - 2)
            gain = classlm.gains(g, *beside[w], old)
            new = int(np.argmax(gain[: k - 2]))
            out[w] = new if old == k - 2 or gain[new] > gain[old] + 1e-9 else old
        cls.update(out)

    for _ in range(rules.sweeps):
        moved([w for w in words[8:] if c[w] >= 3])
    moved([w for w in order if 3 <= c[w] < floor])
    g, _ = matrix()
    alone = (g.sum(axis=0) + 0.1) / (g.sum() + 0.1 * k)
    step = np.log10(0.95 * (g + 0.1 * alone) / (g.sum(axis=1, keepdims=True) + 0.1) + 0.05 * alone)
    sizes, kinds = Counter(), Counter()
    for w in c:
        sizes[cls.get(w, k - 2)] += c[w]
        kinds[cls.get(w, k - 2)] += 1
    rare = sizes[k - 2] + 0.1 * (kinds[k - 2] + 1)
    want = []
    for i, d in plain:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in d) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        line = [k - 1, *(cls.get(w, k - 2) for w in d), k - 1]
        score = sum(step[a, b] for a, b in zip(line, line[1:])) + sum(math.log10((c[w] + 0.1) / rare if cls.get(w, k - 2) == k - 2 else c[w] / sizes[cls[w]]) for w in d)
        want.append((str(i), held(i), len(d) + 1, sum(c[x] > 0 for x in d) + 1, n, round(base, 6), round(score, 6), round(10 ** (-score / (len(d) + 1)), 4)))
    assert len(set(cls.values())) > 2
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6), round(r["perplexity"], 4)) for r in got) == sorted(want)
    assert classlm.lm_scores(none).isEmpty()


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    big = np.zeros((22, 22))
    for _ in range(4000):  # even words are followed by odd ones
        a, b = 2 * rng.integers(10), 2 * rng.integers(10) + 1
        big[a, b] += 1
        big[b, 2 * rng.integers(10)] += 1
    at = classlm.exchange(big, 2, 20)
    assert len({at[k] for k in range(0, 20, 2)}) == 1 and len({at[k] for k in range(1, 20, 2)}) == 1 and at[0] != at[1]


def test_languages(spark, odd, none):
    texts = {"en": "the house with these things and other words", "fr": "une maison avec des choses et autres mots là", "de": "das haus mit diesen sachen und anderen wörtern"}
    docs = spark.createDataFrame([(k, " ".join(np.random.default_rng(k).permutation(t.split())), lang) for k, (lang, t) in enumerate(list(texts.items()) * 30)], "doc_id long, text string, lang string")
    got = langid.languages(docs).join(docs, F.col("id") == F.col("doc_id")).where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    assert {r["lang_pred"] for r in rows(langid.languages(odd).where("id in (1, 2, 3)"))} == {"und"}
    assert langid.languages(none).isEmpty()


@pytest.mark.parametrize("share", [0.0, 0.08, 2.0])
def test_nearest_examples_are_exact(share):
    rng = np.random.default_rng(3)
    vectors = []
    for k in range(300):
        ids = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        vectors.append((k, int(k % 3 == 0), ids, rng.integers(1, 4, len(ids))))
    idf = rng.uniform(1, 5, 40)
    index = toxicity.BlockMaxIndex.build(vectors, idf, 16, share)
    assert {0.0: 40, 2.0: 0}.get(share, len(index.matrix)) == len(index.matrix)
    dense = np.zeros((300, 40))
    for k, v in enumerate(vectors):
        w = (1 + np.log(v[3])) * idf[v[2]]
        dense[k, v[2]] = w / np.sqrt((w * w).sum())
    asked = [v[2:] for v in vectors[:60]]
    for without in ([-1] * 60, list(range(60))):
        for k, (near, score) in enumerate(index.nearest(asked, 25, without)):
            cos = dense @ dense[k]
            want = sorted((x for x in range(300) if cos[x] > 0 and x != without[k]), key=lambda x: (-round(min(cos[x], 1.0), 12), x))[:25]
            assert list(near) == want and np.allclose(score, np.minimum(cos[want], 1.0))


def test_toxicity(spark, none):
    docs = spark.createDataFrame([(k, f"word{k % 13} and word{k % 7} " + ("scum here" if k % 4 == 0 else "fine here")) for k in range(400)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["id"]: r for r in rows(toxicity.toxicity(docs, labels))}
    assert len(got) == 402 and all(got[k]["predicted"] == int(k % 4 == 0) for k in range(400)) and got[900]["predicted"] == got[901]["predicted"] == 0
    assert toxicity.toxicity(none, labels).isEmpty()
    assert {r["score"] for r in rows(toxicity.toxicity(docs, labels.limit(0)))} == {0.0}
    named = toxicity.toxicity(docs.selectExpr("'d' || doc_id AS `a.id`", "text AS `the text`", "1 AS score"), labels.selectExpr("'d' || doc_id AS `a.id`", "toxic AS `is.toxic`"), key="a.id", text="the text", label="is.toxic")
    named = {r["id"]: r for r in rows(named)}
    assert len(named) == 402 and named["d8"]["predicted"] == 1 and named["d9"]["predicted"] == 0 and named["d8"]["nearest"][0].startswith("d")


def test_long_labelled_texts_teach_nothing(spark):
    long = "scum " + " ".join(f"w{k}x" for k in range(300_000))  # over 2 MB, and more words than a task remembers
    docs = spark.createDataFrame([(k, f"plain word{k % 9}" + (" scum" if k % 3 == 0 else "")) for k in range(60)] + [(100, long), (101, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(100, 0), (101, 0)], "doc_id long, toxic int")
    got = {r["id"]: r for r in rows(toxicity.toxicity(docs, labels))}
    assert not {100, 101} & {e for r in got.values() for e in r["nearest"]}
    assert got[100]["nearest"] == got[101]["nearest"] and all(got[100]["cosines"]) and got[100]["score"] == got[101]["score"]
    reader = toxicity._Reader(type("Broadcast", (), {"value": pa.array([b"^w299", b"scum"], pa.binary())}), (4,))
    assert reader.read(long.encode())[0].tolist() == [0, 1] and reader.read(b"scum Scum")[1].tolist() == [2]


@pytest.mark.parametrize("share", [0.06, 2.0])
def test_toxicity_is_that_of_brute_force(spark, share):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 12) % 400) + (" scum" if k % 5 == 0 else "") for k in range(200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = toxicity.VoteRules(dense=share, neighbours=10, block=8)
    got = {r["id"]: r for r in rows(toxicity.toxicity(docs, spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(150)], "doc_id long, toxic int"), rules))}
    tf = [toxicity.terms((t or "").encode(), rules.prefixes) for t in texts]
    df = Counter(t for c in tf for t in c)
    examples = [k for k in range(150) if not got[k]["held_out"]]
    known = {t for k in examples for t in tf[k] if df[t] < len(texts)}
    units = []
    for c in tf:
        v = {t: (1 + math.log(n)) * math.log(len(texts) / df[t]) for t, n in c.items() if t in known}
        z = math.sqrt(sum(x * x for x in v.values()))
        units.append({t: x / z for t, x in v.items()})

    def near(k, without=None):
        cos = {e: min(1.0, sum(x * units[e].get(t, 0.0) for t, x in units[k].items())) for e in examples if e != without}
        best = sorted((e for e in cos if cos[e] > 0), key=lambda e: (-round(cos[e], 12), e))[:10]
        return best, cos, sum(cos[e] * (e % 5 == 0) for e in best) / max(sum(cos[e] for e in best), 1e-300)

    alone = [(near(e, e)[2], e % 5 == 0) for e in examples if near(e, e)[0]]
    at, rate = toxicity.monotone(np.array([v for v, _ in alone]), np.array([float(y) for _, y in alone]))
    for k in range(len(texts)):
        best, cos, vote = near(k)
        assert got[k]["nearest"] == best[:3] and got[k]["cosines"] == pytest.approx([cos[e] for e in best[:3]])
        if best:
            assert got[k]["score"] == pytest.approx(float(np.interp(vote, at, rate)), abs=1e-6)


def test_url_rules(spark):
    urls = ["http://A.example.com/en/7x?q", "https://example.com/en/8", "http://x.example.net/de/8", "http://net/de/", "http://org/es", "x://y.org/es/#a", "no host", None, "http://example.comx/en/", "://com/en/", "http://.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = [(r["rule"], r["verdict"]) for r in sorted(rows(urlfilter.judged(pages, rules)), key=lambda r: r["id"])]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"), ("com/en/", "block")]
    assert urlfilter.judged(pages.limit(0), rules).isEmpty()
    assert {r["verdict"] for r in rows(urlfilter.judged(pages, rules.limit(0)))} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    cascade = urlfilter.Cascade.build(listed, universe)
    assert universe.where(cascade.holds(F.col("key")) != (F.col("key") % 7 == 0)).isEmpty()


@pytest.mark.parametrize("bits", [64, 1024])
def test_a_split_cascade_is_exact(spark, bits):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    cascade = urlfilter.Cascade.build(universe.where("key % 7 = 0"), universe, bits=bits)
    assert len(cascade.filters[0].parts) > 1 and all(f.bits <= bits for f in cascade.filters)
    assert universe.where(cascade.holds(F.col("key")) != (F.col("key") % 7 == 0)).isEmpty()


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f, pytest.raises(ValueError):
        tokencount.pre_tokens(f.read())
