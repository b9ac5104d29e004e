"""Texts as terms, read many at once."""

import random
import time

import numpy as np
import pyarrow as pa

from tallow.llm import toxicity

PREFIXES = toxicity.VoteRules().prefixes


def shared(values):
    return type("Broadcast", (), {"value": pa.array(sorted(values), pa.binary())})


def texts_of_new_words(n):
    rng = random.Random(4)
    return [" ".join(f"{rng.getrandbits(44):x}" for _ in range(200)).encode() for _ in range(n)]


def test_words_are_not_looked_up_one_by_one():
    """Reading words that were not met before costs a small part of counting their terms in Python."""
    texts = texts_of_new_words(1500)
    vocabulary = shared({t for x in texts[:100] for t in toxicity.terms(x, PREFIXES)})
    batch = pa.record_batch([pa.array(texts, pa.binary())], names=["text"])

    def seconds(work):
        took = []
        for _ in range(2):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    count = seconds(lambda: [toxicity.terms(x, PREFIXES) for x in texts])
    assert seconds(lambda: list(toxicity._frequencies(vocabulary, PREFIXES)(iter([batch])))) < count / 3


def test_texts_read_together_are_as_counted_alone(monkeypatch):
    texts = [None, b"", b" \n^-", b"Scum, SCUM scummy scums", b"^scum scumm", "Über über ÜBERALL x²y".encode(), b"\xff\xfe raw\x00bytes \x7f", b"a" * 5000, b"scum" * 3000 + b" scum", *texts_of_new_words(3), b"ab abcd abcde abcdef abcdefghij", b"."]
    counted = [toxicity.terms(t or b"", PREFIXES) for t in texts]
    known = sorted({t for c in counted for t in c} - {b"^scum", b"abcde"})
    dims = np.array([k if k % 3 else len(known) for k in range(len(known))])
    column = pa.array([b"left out", *texts], pa.binary()).slice(1)
    for read in (1 << 22, 64, 1):
        monkeypatch.setattr(toxicity, "_READ", read)
        for numbers in (None, dims):
            want = [[(k, c[t]) for k, t in enumerate(known) if c[t] and (numbers is None or k % 3)] for c in counted]
            reader = toxicity._Reader(shared(known), PREFIXES, numbers)
            assert [list(zip(ids.tolist(), tf.tolist(), strict=True)) for ids, tf in reader.each(column)] == want
            assert [list(zip(*(x.tolist() for x in reader.read(t)), strict=True)) for t in texts] == want
    nothing = toxicity._Reader(shared([]), PREFIXES)
    assert [len(ids) for ids, _ in nothing.each(column)] == [0] * len(texts) and list(nothing.each(column.slice(0, 0))) == []
