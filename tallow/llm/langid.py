"""Language identification with averaged hashed subword embeddings and a linear softmax.

Byte n-grams of the lower-cased text are hashed to rows of an embedding table;
their mean goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy on a bounded seeded sample of labelled texts; a
temperature fitted on texts kept out of training calibrates the probabilities.
For prediction the two layers are folded into one score table, and every text
is read whole. Texts under the rejection threshold are marked, not renamed.

Defined results: a null text or one without a letter is 'und' with score 0;
without labelled texts every text is 'und'; repeated rows are judged alike; a
null label teaches nothing; empty tables give no rows; other columns play no
part. A long text is read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table


@dataclass(frozen=True)
class LangRules:
    #: At most about so many labelled texts are learned from, a bound on the driver's memory.
    sample: int = 3000
    #: Longer texts, in bytes, teach nothing: the other part of that bound.
    longest: int = 1 << 16
    #: Rows of the embedding table (a power of two), and its width.
    buckets: int = 1 << 15
    width: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 4
    rate: float = 0.5
    seed: int = 5
    #: Texts whose best language is less likely than this are marked as rejected.
    reject: float = 0.6


_CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def grams(texts: list[bytes], sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, its n-grams' buckets) in pieces of _CHUNK bytes at most, so that a long text takes no more memory than others."""
    table = np.arange(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13]] = 32
    for k, text in enumerate(texts):
        a = table[np.frombuffer(text, np.uint8)]
        for begin in range(0, max(len(a), 1), _CHUNK):
            b = a[begin : begin + _CHUNK + max(sizes) - 1].astype(np.uint32)
            out = []
            for n in sizes:
                m = min(len(b) - n + 1, _CHUNK)
                if m > 0:
                    h = np.full(m, n, np.uint32)
                    for j in range(n):
                        h = h * np.uint32(0x01000193) + b[j : j + m] + np.uint32(1)
                    out.append(_mix(h) & np.uint32(buckets - 1))
            yield k, np.concatenate(out) if out else np.empty(0, np.uint32)


def lowered(text: str | None) -> bytes:
    return f" {(text or '').lower()} ".encode()


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages: what a gram adds to each language's score
    bias: np.ndarray
    temperature: float
    grams: tuple[int, ...]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for k, g in grams(texts, self.grams, len(self.table)):
            z[k] += self.table[g].sum(axis=0, dtype=np.float64)
            n[k] += len(g)
        return softmax((z / np.maximum(n, 1)[:, None] + self.bias) * self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], rules: LangRules) -> LangModel:
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    bags: list[list] = [[] for _ in texts]
    for k, g in grams(texts, rules.grams, rules.buckets):
        bags[k].append(g)
    bags = [np.unique(np.concatenate(b), return_counts=True) for b in bags]
    rng = np.random.default_rng(rules.seed)
    e = rng.uniform(-1, 1, (rules.buckets, rules.width)) / rules.width
    w, bias = np.zeros((rules.width, len(langs))), np.zeros(len(langs))
    kept = rng.random(len(texts)) < 0.85 if len(texts) >= 40 else np.ones(len(texts), bool)
    order = np.flatnonzero(kept)
    for epoch in range(rules.epochs):
        rate = rules.rate * (1 - epoch / rules.epochs)
        for k in rng.permutation(order):
            g, c = bags[k]
            share = c / c.sum()
            h = share @ e[g]
            p = softmax((h @ w + bias)[None])[0]
            p[y[k]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            bias -= rate * p
            e[g] -= rate * len(g) / 4 * np.outer(share, back)  # a mean over many n-grams gives each a small gradient: the rows' rate grows with their number
    out = LangModel(langs, (e @ w).astype(np.float32), bias, 1.0, rules.grams)
    held = np.flatnonzero(~kept) if (~kept).any() else order
    best = np.inf
    z = np.array([(bags[k][1] / bags[k][1].sum()) @ out.table[bags[k][0]] + bias for k in held]).reshape(len(held), -1)
    for t in np.geomspace(0.25, 4, 33):  # a few grains of doubt keep the scale finite where every text is right
        p = softmax(z * t) * 0.999 + 0.001 / len(langs)
        loss = -np.log(p[np.arange(len(held)), y[held]]).mean() + 1e-3 * t
        if loss < best:
            best, out.temperature = loss, float(t)
    return out


def train(docs: DataFrame, rules: LangRules = LangRules(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel | None:
    """A model of a seeded sample of the rows that have a label and a letter."""
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= rules.longest) & F.col(text).rlike(r"\p{L}"))
    n = docs.where(F.col(lang).isNotNull()).count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit(rules.seed), F.col(key), F.col(lang)), F.lit(1 << 30))
    got = rows.where(place < int(min(1.0, rules.sample / n) * (1 << 30))).select(F.col(text), F.col(lang), place.alias("place")).toArrow().sort_by("place")
    if not len(got):
        return None
    return fit([lowered(x) for x in got[0].to_pylist()], got[1].to_pylist(), rules)


def _predictor(model, reject: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if m and t and _LETTER.search(t)]
            for a in range(0, len(some), 256):
                part = some[a : a + 256]
                p = m.probabilities([lowered(texts[k]) for k in part])
                for k, row in zip(part, p, strict=True):
                    lang[k], score[k] = m.langs[int(row.argmax())], row.max()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(score < reject)], names=["id", "held_out", "lang_pred", "score", "rejected"])

    return run


def languages(docs: DataFrame, rules: LangRules = LangRules(), key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of each row; rows of fold held of folds (by crc32 of the id) teach nothing."""
    out = in_fold(F.col(key), folds, held)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~out), rules, key, text, lang))
    rows = docs.select(F.col(key).alias("id"), out.alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(model, rules.reject), f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op3_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
