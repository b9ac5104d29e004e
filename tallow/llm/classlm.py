"""Perplexity under a class-based bigram model, with exchange clustering.

Words are dealt to classes so that the likelihood of the class bigrams is
highest. The most frequent ones lay the classes out: word after word moves to
the class where it gains most, until no word moves. Then every other word of
some frequency moves, in sweeps, to the class where its own bigrams gain most
against those of the classes; a sweep is one pass over the coded texts, a sum
for each word and neighbour class, and a gain for each word, all in tasks. Words
that are rarer form one class more, the end of text another. A token's
probability is that of its class after the last token's, times that of the word
in its class; both are smoothed, and words never seen have their share of the
rare words' class.

Texts are coded once: frequent words, a number with a bound, by number, the
others as they are. Tables of the others, with their counts and classes, are
joined and never gathered; the driver holds the frequent words, their classes
and the classes' bigrams.

Defined results: a null or blank text is its end token alone; repeated rows
count and are scored one by one; without training texts the base score and the
model's emissions rest on smoothing alone; empty tables give no rows; other
columns play no part and may have any name. A text is held whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table, written
from .terms import head_floor, term_counter


@dataclass(frozen=True)
class ClassRules:
    #: Words that lay the classes out, exchanged one by one, and the classes.
    seeded: int = 1000
    classes: int = 40
    passes: int = 8
    #: Every word that training texts hold so often gets a class of its own choice.
    least: int = 5
    sweeps: int = 1
    #: Added to counts.
    add: float = 0.1
    #: Weight of the class bigram against the class alone.
    bigram: float = 0.95


#: Texts that a task holds as numbers at a time: some hundred words each, with a dozen arrays of eight bytes a word beside them.
_TEXTS = 1000


def _few(run):
    """run over slices of _TEXTS rows, so that a task's memory does not follow from the size of Arrow batches."""
    return lambda batches: run(b.slice(a, _TEXTS) for b in batches for a in range(0, b.num_rows, _TEXTS))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class _Numbers(dict):
    """Words' numbers; a word without one has -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _coder(words):
    """For mapInArrow over (id, held_out, text): (id, held_out, codes, tail): a frequent word's number, or -1 and the word in tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers((w, k) for k, w in enumerate(words.value))
        for batch in batches:
            codes, tail, ends, tails = [np.empty(0, np.int32)], [], [0], [0]
            for text in batch.column(2):
                w = tokens(text.as_py() or b"")
                own = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
                codes.append(own)
                tail += [w[k] for k in np.flatnonzero(own < 0)]
                ends.append(ends[-1] + len(w))
                tails.append(len(tail))
            codes = np.concatenate(codes)
            parts = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((ends, pa.array(codes)), (tails, pa.array(tail, pa.binary())))]
            yield pa.record_batch([*batch.columns[:2], *parts], names=["id", "held_out", "codes", "tail"])

    return run


def _line(codes: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' codes in one line with end before, between and after; each one's text; each text's length."""
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(sizes)), sizes)
    line = np.full(len(text) + len(sizes) + 1, end, np.int64)
    line[np.arange(len(text)) + text + 1] = codes.flatten().to_numpy(zero_copy_only=False)
    return line, text, sizes


def _pairs(classes, words_too: int):
    """For mapInArrow over (codes): (key, c), how often classes follow each other and, if words_too >= 0, words from that number on stand beside them.

    classes: of each frequent word, then of the end of text, then of all other
    words. Keys: -1 - (class * k + class) of two in a row; word * 2 k + class
    before it; word * 2 k + k + class after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, k = classes.value
        both, keys, held = np.zeros(k * k, np.int64), [], 0

        def summed() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.record_batch([pa.array(own), pa.array(n.astype(np.int64))], names=["key", "c"])

        for batch in batches:
            line, _, _ = _line(batch.column(0), len(cls) - 2)
            c = cls[line]
            both += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
            if words_too >= 0:
                at = np.flatnonzero((line >= words_too) & (line < len(cls) - 2))
                keys += [line[at] * (2 * k) + c[at - 1], line[at] * (2 * k) + k + c[at + 1]]
                held += 2 * len(at)
                if held > 4_000_000:
                    yield summed()
                    keys, held = [], 0
        if keys:
            yield summed()
        some = np.flatnonzero(both)
        yield pa.record_batch([pa.array(-1 - some), pa.array(both[some])], names=["key", "c"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """The class of each of n words: words of bigrams (n + 2) x (n + 2), whose last two rows keep classes of their own.

    The likelihood is the sum of f over class bigrams less that of f over class
    counts as left and as right neighbours, f(x) = x log x.
    """
    n = len(bigrams) - 2
    k = min(classes, n)
    counts = bigrams[:n].sum(axis=1)
    at = np.empty(n + 2, np.int64)
    at[:n][np.argsort(-counts, kind="stable")] = np.arange(n) % max(k, 1)
    at[n:] = k, k + 1
    size = k + 2
    onto = np.zeros((n + 2, size))
    onto[np.arange(n + 2), at] = 1
    right, left = bigrams @ onto, bigrams.T @ onto  # by class of the next, of the previous word
    g = onto.T @ right
    for _ in range(passes):
        moved = 0
        for w in range(n):
            old, r, l, self = at[w], right[w], left[w], bigrams[w, w]
            # Out of its class: w's bigrams leave its row and column.
            g[old] -= r
            g[:, old] -= l
            g[old, old] += self
            r2, l2 = r.copy(), l.copy()
            r2[old] -= self
            l2[old] -= self
            rows, cols, diag = g[:k], g[:, :k].T, np.arange(k)
            gain = (_f(rows + r2) - _f(rows)).sum(axis=1) + (_f(cols + l2) - _f(cols)).sum(axis=1)
            d = g[diag, diag]
            gain += _f(d + r2[:k] + l2[:k] + self) + _f(d) - _f(d + r2[:k]) - _f(d + l2[:k])
            out, into = g.sum(axis=1)[:k] + l2[:k], g.sum(axis=0)[:k] + r2[:k]  # with w's neighbours, wherever w goes
            a, b = r2.sum() + self, l2.sum() + self
            gain -= _f(out + a) - _f(out) + _f(into + b) - _f(into)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            g[new] += r2
            g[:, new] += l2
            g[new, new] += self
            if new != old:
                moved += 1
                at[w] = new
                right[:, old] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, old] -= bigrams[w]
                left[:, new] += bigrams[w]
        if not moved:
            break
    return at


def gains(g: np.ndarray, left: np.ndarray, right: np.ndarray, old: int) -> np.ndarray:
    """What the likelihood of class bigrams g gains in each class by a word of class old with these classes before and after it, g being taken without the word."""
    g = g.copy()
    g[old] -= right
    g[:, old] -= left
    g = np.maximum(g, 0.0)  # a word beside itself is taken away twice
    n, out, into = left.sum(), g.sum(axis=1), g.sum(axis=0)
    r, l = np.flatnonzero(right), np.flatnonzero(left)  # the others gain nothing
    rows, columns = (_f(g[:, r] + right[r]) - _f(g[:, r])).sum(axis=1), (_f(g[l] + left[l, None]) - _f(g[l])).sum(axis=0)
    return rows + columns - (_f(out + n) - _f(out)) - (_f(into + n) - _f(into))


def _mover(state, open_classes: int):
    """For mapInArrow over (word, old, beside: array of (code, c)): (word, class) with the class of the highest gain; the old one stays if none is higher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = state.value
        k = len(g)
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))))
            code, c = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
            best = np.empty(batch.num_rows, np.int64)
            for j, old in enumerate(batch.column(1).to_pylist()):
                beside = np.bincount(code[ends[j] : ends[j + 1]], c[ends[j] : ends[j + 1]], 2 * k)
                gain = gains(g, beside[:k], beside[k:], old)
                new = int(np.argmax(gain[:open_classes]))
                best[j] = new if old >= open_classes or gain[new] > gain[old] + 1e-9 else old
            yield pa.record_batch([batch.column(0), pa.array(best)], names=["word", "class"])

    return run


def _swept(coded: DataFrame, at: np.ndarray, k: int, first: int, last: int) -> np.ndarray:
    """at, the classes of frequent words, with those of words first to last moved once against the classes' bigrams."""
    sc = coded.sparkSession.sparkContext
    got = written(coded.select("codes").mapInArrow(_few(_pairs(sc.broadcast((at, k)), first)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    g = _matrix(got.where("key < 0"), k)
    beside = got.where((F.col("key") >= 0) & (F.col("key") < last * 2 * k)).groupBy(F.floor(F.col("key") / (2 * k)).alias("word")).agg(F.collect_list(F.struct((F.col("key") % (2 * k)).alias("code"), "c")).alias("beside"))  # 2 k at most
    old = F.get(F.lit(at[first:last].tolist()), (F.col("word") - first).cast("int")) if last - first <= 10_000 else None
    if old is None:
        table = coded.sparkSession.createDataFrame(pa.table({"word": np.arange(first, last), "old": at[first:last]}))
        beside = beside.join(F.broadcast(table), "word").select("word", "old", "beside")
    else:
        beside = beside.select("word", old.cast("long").alias("old"), "beside")
    moved = beside.mapInArrow(_mover(sc.broadcast(g), k - 2), "word long, class long").toArrow()  # terms.HEAD rows at most
    at = at.copy()
    at[moved["word"].to_numpy()] = moved["class"].to_numpy()
    return at


def _matrix(pairs: DataFrame, k: int) -> np.ndarray:
    got = pairs.toArrow()  # k * k rows at most
    g = np.zeros(k * k)
    g[-1 - got["key"].to_numpy()] = got["c"].to_numpy()
    return g.reshape(k, k)


def _tails(classes):
    """For mapInArrow over (row, held_out, codes, tail): (row, held_out, term, before, after, next) of each word that has no number; a neighbour's class, or -1 and, after, the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, _ = classes.value
        for batch in batches:
            line, text, _ = _line(batch.column(2), len(cls) - 2)
            place = np.arange(len(text)) + text + 1
            here = np.flatnonzero(line[place] < 0)
            if not len(here):
                continue
            p = place[here]
            before, after = np.where(line[p - 1] < 0, -1, cls[line[p - 1]]), np.where(line[p + 1] < 0, -1, cls[line[p + 1]])
            term = batch.column(3).flatten()
            following = term.take(pa.array(np.minimum(np.arange(len(here)) + 1, len(here) - 1), mask=after >= 0))
            own = pa.array(text[here])
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), term, pa.array(before, pa.int32()), pa.array(after, pa.int32()), following], names=["row", "held_out", "term", "before", "after", "next"])

    return run


def _scored(model):
    """(row, n_tokens, n_head, base, score) of each text, without the words that have no number and the steps to and from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, base, emit, step, end_base = model.value
        base, emit = np.append(base, [0.0, 0.0]), np.append(emit, [0.0, 0.0])
        for batch in batches:
            line, text, sizes = _line(batch.column(1), len(cls) - 2)
            n, own = len(sizes), np.arange(len(text)) + text + 1
            codes, c = line[own], cls[line]
            known = (line[:-1] >= 0) & (line[1:] >= 0)
            steps = np.where(known, step[c[:-1], c[1:]], 0.0)
            ends = np.concatenate(([0], np.cumsum(sizes + 1)))  # a text's steps: from the end before it to the end after it
            sums = [np.bincount(text, x[codes], n) for x in (base, emit)]
            score = sums[1] + (np.add.reduceat(steps, ends[:-1]) if n else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(sizes + 1, pa.int64()), pa.array(np.bincount(text, codes >= 0, n).astype(np.int64)), pa.array(sums[0] + end_base), pa.array(score)], names=["row", "n_tokens", "n_head", "base", "score"])

    return run


def lm_scores(docs: DataFrame, rules: ClassRules = ClassRules(), key: str = "doc_id", text: str = "text", folds: int = 10, held: int = 0, head: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row; rows of fold held of folds (by crc32 of the id) teach nothing.

    head: most words that have numbers, terms.HEAD if None; it changes the way, not the result but for the order in which words move.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    own = F.col(f"`{key}`")
    texts = docs.select(own.alias("id"), in_fold(own, folds, held).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))
    train = texts.where(~F.col("held_out")).select("text")
    counts = written(train.mapInArrow(term_counter(tokens), "term binary, c long").groupBy("term").agg(F.sum("c").alias("c")))
    n_docs = train.count()
    s = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words_n, distinct = s["n"] or 0, s["v"] + (n_docs > 0)
    total = words_n + n_docs
    add, denominator = rules.add, total + rules.add * (distinct + 1)

    floor = head_floor(counts) if head is None else head_floor(counts, head)
    numbered = counts.where(F.col("c") >= floor).toArrow()  # terms.HEAD rows at most
    words, c = np.array(numbered[0].to_pylist(), dtype=object), numbered[1].to_numpy()
    order = np.lexsort((words.astype("S") if len(words) else words, -c))
    words, c = words[order], c[order]
    kind = texts.schema["id"].dataType.simpleString()
    coded = texts.mapInArrow(_few(_coder(sc.broadcast(words.tolist()))), f"id {kind}, held_out boolean, codes array<int>, tail array<binary>")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()))
    taught = coded.where(~F.col("held_out"))

    # The seeded words' classes, then those of all frequent words. The last two classes are of rare words and of the end of text.
    n = min(rules.seeded, len(words))
    places = np.append(np.minimum(np.arange(len(words)), n), [n + 1, n])  # of the end of text, of words without numbers
    pairs = taught.select("codes").mapInArrow(_few(_pairs(sc.broadcast((places, n + 2)), -1)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    at = exchange(_matrix(pairs, n + 2), rules.classes, rules.passes)
    k = int(at[-1]) + 1
    rare, end = k - 2, k - 1
    cls = np.full(len(words) + 2, rare)
    cls[:n], cls[-2] = at[:n], end
    last = int((c >= rules.least).sum())
    for _ in range(rules.sweeps if last > n and k > 2 else 0):
        cls = _swept(taught, cls, k, n, last)
    classes = sc.broadcast((cls, k))

    # The classes of words without numbers that are frequent enough, against the same bigrams.
    tails = written(coded.select("row", "held_out", "codes", "tail").mapInArrow(_few(_tails(classes)), "row long, held_out boolean, term binary, before int, after int, next binary"))
    rest = counts.where(F.col("c") < floor)
    g = _matrix(taught.select("codes").mapInArrow(_few(_pairs(classes, -1)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), k)
    if floor > rules.least and k > 2:
        near = lambda x: F.when(F.col(x) < 0, rare).otherwise(F.col(x)).cast("long")
        sides = tails.where("not held_out").groupBy("term", near("before").alias("a"), (k + near("after")).alias("b")).agg(F.count("*").alias("c"))
        sides = sides.groupBy(F.col("term").alias("word")).agg(F.sum("c").alias("n"), F.collect_list(F.struct("a", "b", "c")).alias("x"))  # k * k at most
        code = lambda x, side: F.struct(x[side].alias("code"), x["c"].alias("c"))
        beside = sides.where(F.col("n") >= rules.least).select("word", F.lit(rare).cast("long").alias("old"), F.flatten(F.transform("x", lambda x: F.array(code(x, "a"), code(x, "b")))).alias("beside"))
        found = beside.mapInArrow(_mover(sc.broadcast(g), k - 2), "word binary, class long")
        rest = rest.join(found.withColumnsRenamed({"word": "term"}), "term", "left")
    else:
        rest = rest.withColumn("class", F.lit(None).cast("long"))
    rest = written(rest.select("term", "c", F.coalesce("class", F.lit(rare)).cast("int").alias("class")))
    tails = tails.join(rest, "term", "left").select("row", "held_out", "before", "after", "next", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(rare)).alias("class"))
    two = tails.where("next is not null").join(rest.select(F.col("term").alias("next"), F.col("class").alias("second")), "next", "left").withColumn("second", F.coalesce("second", F.lit(rare)))
    tails = written(tails.where("next is null").withColumn("second", F.lit(None).cast("int")).unionByName(two).drop("next"))

    # The final bigrams: where a word without a number stood for the rare class, its own class takes the place.
    own_class, before, after = F.col("class"), F.col("before"), F.col("after")
    pair = lambda a, b, sign: F.struct((a * k + b).alias("pair"), F.lit(sign).alias("c"))
    steps = F.array(
        F.when(before >= 0, pair(before, own_class, 1)), F.when(before >= 0, pair(before, F.lit(rare), -1)),
        F.when(after >= 0, pair(own_class, after, 1)), F.when(after >= 0, pair(F.lit(rare), after, -1)),
        F.when(F.col("second").isNotNull(), pair(own_class, F.col("second"), 1)), F.when(F.col("second").isNotNull(), pair(F.lit(rare), F.lit(rare), -1)),
    )
    changed = tails.where(~F.col("held_out")).select(F.explode(F.array_compact(steps)).alias("x")).groupBy("x.pair").agg(F.sum("x.c").alias("c")).toArrow()  # k * k rows at most
    g = g.reshape(-1)
    g[changed["pair"].to_numpy()] += changed["c"].to_numpy()
    g = g.reshape(k, k)
    alone = (g.sum(axis=0) + add) / (g.sum() + add * k)
    step = np.log10(rules.bigram * (g + add * alone) / (g.sum(axis=1, keepdims=True) + add) + (1 - rules.bigram) * alone)

    in_class, kinds = np.bincount(cls[:-2], c, k), np.bincount(cls[:-2], minlength=k).astype(float)
    for r in rest.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # k rows at most
        in_class[r["class"]] += r["c"]
        kinds[r["class"]] += r["v"]
    kinds[rare] += 1  # for all words never seen
    smooth = np.where(np.arange(k) == rare, add, 0.0)
    class_log = np.log10(np.maximum(in_class + smooth * kinds, 1e-300))
    emit = np.log10(c + smooth[cls[:-2]]) - class_log[cls[:-2]]
    base = np.log10((c + add) / denominator)
    model = sc.broadcast((cls, base, emit, step, float(np.log10((n_docs + add) / denominator))))

    rows = coded.select("row", "codes").mapInArrow(_few(_scored(model)), "row long, n_tokens long, n_head long, base double, score double")
    at_step = lambda a, b: F.coalesce(F.get(F.lit(step.reshape(-1).tolist()), a * k + b), F.lit(0.0))
    tail_score = F.log10(F.col("c") + F.when(own_class == rare, add).otherwise(0.0)) - F.get(F.lit(class_log.tolist()), own_class)
    tail_score = tail_score + F.when(before >= 0, at_step(before, own_class)).otherwise(0.0) + F.when(after >= 0, at_step(own_class, after)).otherwise(0.0) + F.when(F.col("second").isNotNull(), at_step(own_class, F.col("second"))).otherwise(0.0)
    sums = tails.groupBy("row").agg(F.sum(F.log10(F.col("c") + add) - float(np.log10(denominator))).alias("tail_base"), F.sum(tail_score).alias("tail_score"), F.count_if(F.col("c") > 0).alias("tail_known"))
    out = rows.join(coded.select("row", "id", "held_out"), "row").join(sums, "row", "left")
    score = F.col("score") + F.coalesce("tail_score", F.lit(0.0))
    return out.select(
        "id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op5_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
