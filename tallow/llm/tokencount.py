"""Token counts without token ids.

The distinct pre-tokens of the corpus are split into pieces once each; a
document's count is the sum, over its pre-tokens, of frequency times pieces.
Special tokens in a text count one each and part it, as the library does.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens;
repeated rows are counted one by one; a null id stays null; empty tables give no
rows; other columns play no part and may have any name; tokenizer files of
another kind are refused. A text is held whole in one task with its pre-tokens.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .terms import head_floor, term_counter

#: Letters, digits and white space up to here are the same in every version of Unicode; beyond, the library itself splits.
_PLAIN = 0x250


def pre_tokens(model: str) -> Callable[[bytes], list]:
    """A function from a text to its pre-tokens (UTF-8) and its special tokens, of the tokenizer whose JSON is model."""
    state: dict = {}
    made = json.loads(model)
    split = made["pre_tokenizer"] or {}
    if made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without a normalizer and with the usual pre-token pattern are counted by pre-token")

    def start() -> None:
        import public_tokenizers
        import regex

        state["find"] = regex.compile(public_tokenizers.PATTERN).findall
        special = [t["content"] for t in json.loads(model)["added_tokens"]]
        state["special"] = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        state["odd"] = regex.compile(f"[^\\x00-{chr(_PLAIN - 1)}‐-›]")

    def pieces(text: str) -> list:
        if not state["odd"].search(text):
            return state["find"](text)
        if "split" not in state:  # few tasks need it, and it takes much memory
            from tokenizers import Tokenizer

            state["split"] = Tokenizer.from_str(model).pre_tokenizer.pre_tokenize_str
        return [text[a:b] for _, (a, b) in state["split"](text)]

    def run(text: bytes) -> list:
        if not state:
            start()
        s = text.decode("utf-8", "replace")
        if state["special"] and state["special"].search(s):
            out = []
            for k, part in enumerate(state["special"].split(s)):
                out += ["\0" + part] if k % 2 else pieces(part)  # no pre-token of letters begins with \0: a mark for specials
            return [x.encode() for x in out]
        return [x.encode() for x in pieces(s)]

    return run


def _pieces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads of their own take memory
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model)
        special = {b"\0" + t["content"].encode() for t in json.loads(model)["added_tokens"]}
        for batch in batches:
            terms = batch.column(0).to_pylist()
            n: list[int] = []
            for k in range(0, len(terms), 2000):
                n += [len(e) for e in tok.encode_batch([t.decode() for t in terms[k : k + 2000]], add_special_tokens=False)]
            n = [1 if t in special else x for t, x in zip(terms, n, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["term", "c", "n"])

    return run


def _summed(split, head):
    """(id, row, n_bytes, n_head, tail): pieces of frequent pre-tokens summed, the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            size, n_head, terms, freqs, ends = [], [], [], [], [0]
            for text in batch.column(1):
                text = text.as_py() or b""
                n = 0
                for term, f in Counter(split(text)).items():
                    k = known.get(term)
                    if k is None:
                        terms.append(term)
                        freqs.append(f)
                    else:
                        n += k * f
                size.append(len(text))
                n_head.append(n)
                ends.append(len(terms))
            tail = pa.StructArray.from_arrays([pa.array(terms, pa.binary()), pa.array(freqs, pa.int32())], names=["term", "f"])
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n_head, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)], names=["id", "n_bytes", "n_head", "tail"])

    return run


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of docs, by the tokenizer file at model_path."""
    spark, model = docs.sparkSession, Path(model_path).read_text()
    split = pre_tokens(model)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    counts = texts.select("text").mapInArrow(term_counter(split), "term binary, c long").groupBy("term").agg(F.sum("c").alias("c"))
    counted = written(counts.mapInArrow(_pieces(model), "term binary, c long, n long"))
    floor = head_floor(counted)
    frequent = counted.where(F.col("c") >= floor).select("term", "n").toArrow()  # terms.HEAD rows at most
    head = spark.sparkContext.broadcast(dict(zip(frequent[0].to_pylist(), frequent[1].to_pylist(), strict=True)))
    rows = texts.mapInArrow(_summed(split, head), f"id {id_type}, n_bytes long, n_head long, tail array<struct<term: binary, f: int>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode("tail").alias("x")).select("row", "x.*")
    rare = counted.where(F.col("c") < floor).select("term", "n")
    sums = tail.join(rare, "term").groupBy("row").agg(F.sum(F.col("n") * F.col("f")).alias("n_tail"))
    out = rows.select("row", "id", "n_bytes", "n_head").join(sums, "row", "left")
    return out.select("id", "n_bytes", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_tokens"))


def op6_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 1024)
