"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings. Document frequencies are counted over all
texts. Every term of a bounded sample of labelled examples is a dimension; one
that all texts hold weighs nothing. A term weighs log(texts / holders) times
1 + log(frequency); the cosine is of a whole text with a whole example.

Examples are laid out so that like ones lie in one block. The index keeps, for
each term and block, the term's postings and their largest weight. Terms that a
large share of the examples hold have a posting for every example instead, rows
of a matrix, and many texts take their sums at once. The blocks' bounds for a
text are the largest of these sums and, for the other terms, sums of the largest
weights; the best blocks are summed exactly, then all others whose bound reaches
the k-th best sum, so the nearest are exact. They vote with their cosines as
weights; a monotone map fitted on the examples, each without itself, turns votes
into probabilities.

Examples are whole texts; labelled ones of more than a stated number of bytes
teach nothing, which with their number bounds what the driver holds.

Defined results: texts without a term of the examples, null and empty ones too,
get the rate of labelled examples of that kind, drawn to the rate of all; without
labels every score is 0; repeated rows are scored alike; several labels of one id
count as toxic if one of them is; ties go to the smaller id; empty tables give no
rows; other columns play no part. Texts are read some megabytes at a time, each
of their distinct words once; a longer text is held whole in one task.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table, written

#: ASCII punctuation counts as white space.
_BLANK = bytes(32 if x < 48 or 57 < x < 65 or 90 < x < 97 or 122 < x < 128 else x for x in range(256))


@dataclass(frozen=True)
class VoteRules:
    #: About so many labelled examples are learned from at most: the bound on the index.
    examples: int = 2_500
    #: Bytes of the word beginnings that are terms.
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    #: Labelled texts of more bytes are not learned from.
    longest: int = 1 << 17
    #: Terms of at least this share of the examples are rows of a matrix.
    dense: float = 0.06
    neighbours: int = 100
    block: int = 512
    threshold: float = 0.3
    seed: int = 3


def terms(text: bytes, prefixes: tuple[int, ...]) -> Counter:
    words = Counter(text.lower().translate(_BLANK).split())
    out: Counter = Counter(words)
    for w, n in words.items():
        for k in prefixes:
            if len(w) > k:
                out[b"^" + w[:k]] += n
    return out


def _example_terms(prefixes):
    """For mapInArrow over (text): the distinct terms of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()
        for batch in batches:
            for text in batch.column(0):
                found.update(terms(text.as_py() or b"", prefixes))
        yield pa.record_batch([pa.array(list(found), pa.binary())], names=["term"])

    return run


#: As _BLANK, with A-Z lower-cased.
_LETTERS = _BLANK.lower()
#: Bytes of texts that are read at once (a longer text alone).
_READ = 1 << 22


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and the number of words of each text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LETTERS), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # where words begin and end, by turns
    begins = edges[::2]
    offsets = np.append(0, np.cumsum(edges[1::2] - begins)).astype(np.int32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(begins, ends), prepend=0)


class _Reader:
    """Texts as terms of a vocabulary (a broadcast sorted array). dims: the number of each term, len(dims) or more for none."""

    def __init__(self, vocabulary, prefixes: tuple[int, ...], dims: np.ndarray | None = None):
        names = vocabulary.value
        self.none = len(names)
        numbers = np.append(np.arange(self.none) if dims is None else dims, self.none)
        begins = np.asarray(pc.starts_with(names, b"^"))
        length = np.where(begins, np.asarray(pc.binary_length(names)) - 1, 0)  # of a beginning, else 0
        self.known = []  # (bytes of a beginning, the known ones, their numbers and none); first the words, with 0 bytes
        for k in (0, *sorted(prefixes)):
            some = np.flatnonzero(begins & (length == k) if k else ~begins)
            terms = names.take(pa.array(some))
            self.known.append((k, pc.binary_slice(terms, 1, k + 1) if k else terms, numbers[np.append(some, self.none)]))

    def _keys(self, texts: list[bytes]) -> np.ndarray:
        """text * none + term for each place of a term, sorted. Each distinct word is looked up once, all of them together."""
        words, sizes = _words(texts)
        coded = words.dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary
        length, first = np.asarray(pc.binary_length(distinct)), np.repeat(np.arange(len(texts)) * self.none, sizes)
        keys = []
        for k, known, numbers in self.known:
            some = np.flatnonzero(length > k)
            asked = distinct.take(pa.array(some))
            found = pc.index_in(pc.binary_slice(asked, 0, k) if k else asked, value_set=known)
            term = np.full(len(distinct), self.none, np.int32)
            term[some] = numbers[pc.fill_null(found, len(known)).to_numpy()]
            held = np.flatnonzero((term < self.none)[place])
            keys.append(first[held] + term[place[held]])
        out = np.concatenate(keys)
        out.sort()
        return out

    def read_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bounds, ids, tf) of some of the texts after others: text j holds the terms ids[bounds[j] : bounds[j + 1]], sorted, with their frequencies."""
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _READ, "right")))
            keys = self._keys([x or b"" for x in texts.slice(at, end - at).to_pylist()])
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            own = keys[starts]
            bounds = np.searchsorted(own, np.arange(end - at + 1) * self.none)
            yield bounds, own - np.repeat(np.arange(end - at) * self.none, np.diff(bounds)), np.diff(starts, append=len(keys))
            at = end

    def each(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms, sorted, and their frequencies."""
        for bounds, ids, tf in self.read_all(texts):
            for a, b in pairwise(bounds.tolist()):
                yield ids[a:b], tf[a:b]

    def read(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """each for one text."""
        return next(self.each(pa.array([text], pa.binary())))


def _frequencies(vocabulary, prefixes):
    """For mapInArrow over (text): (t, n), numbers of a task's texts that hold term t; all its texts under t = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = _Reader(vocabulary, prefixes), 0
        df = np.zeros(reader.none, np.int64)
        for batch in batches:
            for _, ids, _ in reader.read_all(batch.column(0)):
                df += np.bincount(ids, minlength=len(df))
            total += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["t", "n"])

    return run


def _packed(ids: np.ndarray, tf: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate((np.diff(ids, prepend=0), tf)).astype("<i4").tobytes(), 1) if len(ids) else b""


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(vector), "<i4")
    return np.cumsum(both[: len(both) // 2], dtype=np.int32), both[len(both) // 2 :]


def _vectors(vocabulary, prefixes, dims):
    """For mapInArrow over (row, id, y, text): (row, id, y, vector) of each example, the vector packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(vocabulary, prefixes, dims.value)
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array([_packed(*x) for x in reader.each(batch.column(3))], pa.binary())], names=["row", "id", "y", "vector"])

    return run


def _unit(ids: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[ids]
    return w / max(np.sqrt((w * w).sum()), 1e-300)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _layout(example: np.ndarray, term: np.ndarray, n: int, terms: int, most: int = 64) -> np.ndarray:
    """An order of n examples in which those that share frequent terms are near: by the leading direction of the most frequent terms."""
    often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:most]
    column = np.full(terms, -1)
    column[often] = np.arange(len(often))
    held = column[term] >= 0
    x = np.zeros((n, max(len(often), 1)))
    x[example[held], column[term[held]]] = 1.0
    x -= x.mean(axis=0)
    return np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")


@dataclass
class BlockMaxIndex:
    """Examples' unit vectors by term, in blocks: entry e is one term in one block, with its postings and their largest weight."""

    idf: np.ndarray
    block: int
    names: list
    toxic: np.ndarray
    place: np.ndarray  # the given place of the example at a place of the layout
    row: np.ndarray  # a term's row of the matrix, or -1
    matrix: np.ndarray  # weights of the terms that many examples hold, by row and place
    first: np.ndarray  # entries of a term: first[t] to first[t + 1]
    entry_block: np.ndarray
    entry_max: np.ndarray
    postings: np.ndarray  # postings of an entry: postings[e] to postings[e + 1]
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple], idf: np.ndarray, block: int, dense: float = 0.06) -> BlockMaxIndex:
        """vectors: (id, toxic, ids, tf), sorted by id, none empty. dense: terms of at least this share of the examples are rows of the matrix."""
        n, none = len(vectors), np.empty(0, np.int64)
        term = np.concatenate([v[2] for v in vectors]).astype(np.int64) if n else none
        value = np.concatenate([_unit(v[2], v[3], idf) for v in vectors]) if n else np.empty(0)
        given = np.repeat(np.arange(n), [len(v[2]) for v in vectors]) if n else none
        place = _layout(given, term, n, len(idf)) if n else none
        at = np.empty(n, np.int64)
        at[place] = np.arange(n)
        example = at[given]
        often = np.flatnonzero(np.bincount(term, minlength=len(idf)) >= max(dense * n, 1))
        row = np.full(len(idf), -1)
        row[often] = np.arange(len(often))
        matrix, held = np.zeros((len(often), n)), row[term] >= 0
        matrix[row[term[held]], example[held]] = value[held]
        term, example, value = term[~held], example[~held], value[~held]
        order = np.lexsort((example, term))
        term, example, value = term[order], example[order], value[order]
        key = term * (n // block + 1) + example // block
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        first = np.searchsorted(term[starts], np.arange(len(idf) + 1))
        largest = np.maximum.reduceat(value, starts) if len(starts) else np.empty(0)
        names, toxic = [v[0] for v in vectors], np.array([v[1] for v in vectors], float)
        return cls(idf, block, names, toxic, place, row, matrix, first, example[starts] // block, largest, np.append(starts, len(term)), example, value)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (ids, tf) the k examples of largest cosine (fewer if others share no term), ties by given place: (given places, cosines). without: for each text a given place to leave out, or -1."""
        units, q = [_unit(ids, tf, self.idf) for ids, tf in texts], np.zeros((len(texts), len(self.matrix)))
        rows = [self.row[ids] for ids, _ in texts]
        for j, (unit, row) in enumerate(zip(units, rows, strict=True)):
            q[j, row[row >= 0]] = unit[row >= 0]
        sums, out = q @ self.matrix, []
        for j, ((ids, _), unit, row) in enumerate(zip(texts, units, rows, strict=True)):
            out.append(self._nearest(ids[row < 0], unit[row < 0], sums[j], k, without[j] if without else -1))
        return out

    def _nearest(self, ids: np.ndarray, unit: np.ndarray, sums: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """sums: those of the matrix; ids and unit: the other terms."""
        n = len(self.names)
        if not n:
            return np.empty(0, np.int64), np.empty(0)
        out = self.place == without if without >= 0 else slice(0, 0)
        sums[out] = 0.0
        lengths = self.first[ids + 1] - self.first[ids]
        entries, q = _ranges(self.first[ids], lengths), np.repeat(unit, lengths)
        blocks = self.entry_block[entries]
        bound = np.maximum.reduceat(sums, np.arange(0, n, self.block))
        bound = bound + np.bincount(blocks, q * self.entry_max[entries], len(bound))
        done = np.zeros(len(bound), bool)

        def add(some: np.ndarray) -> float:
            """Sums the blocks' other postings; the k-th best sum, from which blocks not summed are left to their matrix part."""
            nonlocal sums
            here = some[blocks]
            e = entries[here]
            sizes = self.postings[e + 1] - self.postings[e]
            p = _ranges(self.postings[e], sizes)
            sums = sums + np.bincount(self.example[p], np.repeat(q[here], sizes) * self.weight[p], n)
            sums[out] = 0.0
            return np.partition(sums, n - k)[n - k] - 1e-9 if n > k else 0.0

        done[np.argsort(-bound, kind="stable")[: -(-2 * k // self.block)]] = True
        least = add(done)
        rest = ~done & (bound >= least) & (bound > 0)
        if rest.any():
            least = add(rest)
        near = np.flatnonzero((sums > 0) & (sums >= least))
        score, given = np.round(np.minimum(sums[near], 1.0), 12), self.place[near]
        order = np.lexsort((given, -score))[:k]
        return given[order], score[order]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        return float((self.toxic[near] * cosine).sum() / cosine.sum()) if len(near) else -1.0


def monotone(votes: np.ndarray, labels: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(votes, probabilities) of a non-decreasing map: equal-sized bins of votes, smoothed rates, neighbours pooled while they fall."""
    order = np.argsort(votes, kind="stable")
    groups = [[votes[p].mean(), labels[p].sum() + 0.5, len(p) + 1.0] for p in np.array_split(order, min(bins, max(1, len(order) // 10))) if len(p)]
    out: list[list] = []
    for g in groups:
        out.append(g)
        while len(out) > 1 and (out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2] or out[-2][0] == out[-1][0]):
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2]])
    return np.array([g[0] for g in out]), np.array([g[1] / g[2] for g in out])


_BUILT: dict[str, BlockMaxIndex] = {}


def _index(taught) -> BlockMaxIndex:
    """The index of the broadcast examples, built once in each Python worker; the driver holds only packed vectors."""
    token, names, toxic, vectors, idf, block, dense = taught.value
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = BlockMaxIndex.build([(i, y, *_unpacked(v)) for i, y, v in zip(names, toxic, vectors, strict=True)], idf, block, dense)
    return _BUILT[token]


#: Texts whose sums over the matrix are taken at once.
_AT_ONCE = 64


def _voter(taught, place, k: int):
    """For mapInArrow over (row, vector) of examples: (row, vote), each without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(taught)
        for batch in batches:
            for some in (batch.slice(j, _AT_ONCE) for j in range(0, batch.num_rows, _AT_ONCE)):
                rows, vectors = (c.to_pylist() for c in some.columns)
                near = index.nearest([_unpacked(v) for v in vectors], k, [place.get(r, -1) for r in rows])
                yield pa.record_batch([some.column(0), pa.array([index.vote(*x) for x in near], pa.float64())], names=["row", "vote"])

    return run


def _scorer(taught, vocabulary, dims, at, rate, none, prefixes, k: int, threshold: float):
    """For mapInArrow over (id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, reader = _index(taught), _Reader(vocabulary, prefixes, dims.value)
        for batch in batches:
            p, near = np.full(batch.num_rows, none), []
            read = reader.each(batch.column(2))
            while some := list(islice(read, _AT_ONCE)):
                near += index.nearest(some, k)
            for j, (e, c) in enumerate(near):
                if len(e):
                    p[j] = np.interp(index.vote(e, c), at, rate)
            names = pa.array([[index.names[x] for x in e[:3]] for e, _ in near], pa.list_(batch.column(0).type))
            cosines = pa.array([c[:3].tolist() for _, c in near], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), names, cosines], names=["id", "held_out", "score", "predicted", "nearest", "cosines"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rules: VoteRules = VoteRules(), key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, score, predicted, nearest, cosines) of each row of docs, ids of any ordered type; labels of fold held of folds (by crc32 of the id) teach nothing."""
    spark = docs.sparkSession
    sort = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    known = labels.select(F.col(f"`{key}`").cast(sort).alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(~in_fold(F.col("id"), folds, held)).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    share = int(min(1.0, rules.examples / max(n, 1)) * (1 << 30))
    sample = F.broadcast(written(known.where(F.pmod(F.xxhash64(F.lit(rules.seed), "id"), F.lit(1 << 30)) < share)))  # about rules.examples rows
    texts = docs.select(F.col(f"`{key}`").alias("id"), in_fold(F.col(f"`{key}`"), folds, held).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= rules.longest
    taught = texts.where(short).join(sample, "id").select(F.monotonically_increasing_id().alias("row"), "id", (F.col("y") > 0).cast("int").alias("y"), "text")
    taught = written(taught.repartition(24))  # about rules.examples rows of rules.longest bytes at most
    names = taught.select("text").mapInArrow(_example_terms(rules.prefixes), "term binary").distinct().toArrow()["term"].combine_chunks()  # the sample's terms
    names = names.take(pc.sort_indices(names))
    vocabulary = spark.sparkContext.broadcast(names)

    df = np.zeros(len(names) + 1)  # the last for t = -1
    counts = texts.select("text").mapInArrow(_frequencies(vocabulary, rules.prefixes), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the sample
    df[counts["t"].to_numpy()] = counts["n"].to_numpy()
    weighs = df[:-1] < df[-1]
    dims = spark.sparkContext.broadcast(np.where(weighs, np.cumsum(weighs) - 1, len(names)))
    idf = np.log(df[-1] / df[:-1][weighs])

    examples = written(taught.mapInArrow(_vectors(vocabulary, rules.prefixes, dims), f"row long, id {sort}, y int, vector binary"))
    got = examples.toArrow().sort_by([("id", "ascending"), ("row", "ascending")])  # about rules.examples rows
    row, y, vectors = got["row"].to_pylist(), got["y"].to_numpy(), got["vector"].to_pylist()
    bare = np.array([not v for v in vectors], bool)
    kept, twins = [], Counter()
    for j, v in enumerate(vectors):
        if v and twins[v] <= rules.neighbours:  # of equal vectors no more can be among the nearest
            kept.append(j)
            twins[v] += 1
    none = float((y[bare].sum() + (y.sum() + 0.5) / (len(y) + 1)) / (bare.sum() + 1)) if n else 0.0
    ids = got["id"].to_pylist()
    index = spark.sparkContext.broadcast((uuid.uuid4().hex, [ids[j] for j in kept], y[kept], [vectors[j] for j in kept], idf, rules.block, rules.dense))
    votes = np.full(len(y), -1.0)
    if kept:
        place = {row[j]: k for k, j in enumerate(kept)}
        voted = examples.where(F.length("vector") > 0).select("row", "vector").repartition(24).mapInArrow(_voter(index, place, rules.neighbours), "row long, vote double").toArrow()
        where = {r: j for j, r in enumerate(row)}
        votes[[where[r] for r in voted["row"].to_pylist()]] = voted["vote"].to_numpy()
    able = votes >= 0
    at, rate = monotone(votes[able], y[able]) if able.any() else (np.array([0.0]), np.array([none]))
    return texts.mapInArrow(_scorer(index, vocabulary, dims, at, rate, none, rules.prefixes, rules.neighbours, rules.threshold), f"id {sort}, held_out boolean, score double, predicted int, nearest array<{sort}>, cosines array<double>")


def op2_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
