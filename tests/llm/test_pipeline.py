import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallow.llm import common, mixing
from tests.llm.test_operators import brute_overlaps, mix_targets, near_components


def test_run_is_that_of_plain_python(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(20)]
    docs = []
    for k in range(120):
        text = [word() for _ in range(rng.choice([20, 60, 80, 200]))]
        if k % 17 == 0:
            text[30:30] = passage
        if k % 11 == 0:
            text = text[:3] * 40
        docs.append((k, " ".join(text), "en", f"s{k % 3}", k))
    docs += [(200 + k, docs[5 * k][1], "de", f"s{k % 4}", 0) for k in range(12)]
    docs += [(None, docs[1][1], "en", "s0", 0), (None, None, None, None, 0), (300, "", "en", None, 0), (7, " ".join(word() for _ in range(90)), "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, `a.b` long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(passage)), (None, "x y z")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(text):
        w = (text or "").split()
        windows = list(zip(w, w[1:], w[2:]))
        times = Counter(windows)
        return len(w) >= 50 and 2 * len({p for k, x in enumerate(windows) if times[x] > 1 for p in range(k, k + 3)}) <= len(w)

    left = [d for d in docs if good(d[1])]
    total, bad = Counter(d[3] for d in docs if d[3]), Counter(d[3] for d in docs if d[3] and not good(d[1]))
    assert all(bad[h] <= 0.5 * total[h] for h in total)  # no host goes
    groups = {tuple(c): min((left[k][0] is None, left[k][0], k) for k in c) for c in near_components([(d[0], d[1]) for d in left], 5)}
    left = [left[k] for _, _, k in groups.values()]
    hit = {k for k, _ in brute_overlaps([(k, d[1]) for k, d in enumerate(left)], items)}
    left = [d for k, d in enumerate(left) if k not in hit]
    place = {(r.doc_id, r.text): r.h for r in spark.createDataFrame([d[:2] for d in left], "doc_id long, text string").select("doc_id", "text", mixing._place("doc_id", "text", mixing.MixRules().seed).alias("h")).collect()}
    sizes = Counter()
    for d in left:
        sizes[d[3]] += len(d[1].split())
    target, quota, block = mix_targets(sizes), Counter(), mixing.MixRules().block
    names = sorted(target, key=lambda x: (x is None, x or ""))
    for _ in range(round(sum(target.values()) / block)):
        quota[max(target, key=lambda s: (target[s] / (2 * quota[s] + 1), -names.index(s)))] += 1
    want = Counter()
    for s in sizes:
        run = -(-sizes[s] // block)
        passes, extra, offset = *divmod(min(quota[s], 2 * run), run), 0
        for d in sorted((d for d in left if d[3] == s), key=lambda d: place[d[0], d[1]]):
            n = len(d[1].split())
            taken = passes * n + max(0, min(offset + n, extra * block) - offset)
            offset += n
            if copies := math.floor(taken / n + 0.5):
                want[d] += copies

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "a.b", "shard"]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 8
    assert set(sizes) <= set(range(24)) and max(sizes.values()) <= sum(sizes.values()) / 24 + 2 * max(len(d[1]) + 8 for d in want)


def test_tables_are_removed_from_a_mark_on(spark):
    first = common.written(spark.range(3))
    mark = common.tables_made()
    second = common.written(spark.range(3))
    common.clear(spark, mark)
    assert first.count() == 3 and common.tables_made() == mark
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        second.count()


def test_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_stages_give_the_columns_of_documents(spark, odd):
    docs = odd.withColumns({"id": F.lit(1), "row": F.lit(2), "h": F.lit(3), "key": F.lit(4)})
    from tallow.llm.minmax import drop_near
    from tallow.llm.quality import keep_good

    assert keep_good(docs).columns == drop_near(docs).columns == mixing.take_mix(docs).columns == docs.columns
