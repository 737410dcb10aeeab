"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

1. Texts are cut into pre-tokens, with their positions, a few hundred texts at a time; a block holds each of its distinct
   pre-tokens once and the positions as numbers into that list (pre-aggregation before any shuffle).
2. The distinct pre-tokens of all blocks meet in one shuffle, and each is encoded exactly once.
3. Their ids are joined back to the blocks, and the texts are put together again by position.

``decode`` goes the other way: ids join the table of token bytes, which is as large as the vocabulary, and are concatenated by position.

Defined results: null and empty texts have an empty list. Text that looks like a special token is plain
text. Very long texts are a block of their own. A repeated row gives a repeated row.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.scratch import Scratch

#: Characters of a block.
BLOCK_CHARS = 4_000_000


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files are."""
    return importlib.import_module("public_tokenizers").path(name)


def public_pattern() -> str:
    """The pattern that cuts texts into pre-tokens for these vocabularies."""
    return importlib.import_module("public_tokenizers").PATTERN


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _blocks(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        task, k = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        codes: list[int] = []
        words: dict[str, int] = {}
        chars = 0

        def block() -> pa.RecordBatch:
            packed = np.array(codes, np.uint32).astype(np.uint16 if len(words) < 65_536 else np.uint32)
            row = [[(task << 32) + k], [ids], [lengths], [packed.tobytes()], [list(words)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["block", "ids", "lengths", "codes", "words"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and chars + len(text or "") > BLOCK_CHARS:
                    yield block()
                    k, ids, lengths, codes, words, chars = k + 1, [], [], [], {}, 0
                tokens = cut(text) if text else []
                ids.append(i)
                lengths.append(len(tokens))
                codes += [words.setdefault(w, len(words)) for w in tokens]
                chars += len(text or "")
        if ids:
            yield block()

    return run


def _encode_words(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            doc = b["ids"].slice(row, 1).flatten()
            lengths = b["lengths"].slice(row, 1).flatten().to_numpy()
            table = b["table"].slice(row, 1).flatten()  # entries (i, ids), sorted by i
            pieces = table.field("ids")
            size = pieces.value_lengths().to_numpy()
            flat = pieces.flatten().to_numpy()
            first = np.r_[0, np.cumsum(size)]
            packed = b["codes"][row].as_py()
            codes = np.frombuffer(packed, np.uint16 if len(size) < 65_536 else np.uint32)
            ends = np.r_[0, np.cumsum(lengths)]
            for a in range(0, len(doc), 2_000):
                e = min(len(doc), a + 2_000)
                c = codes[ends[a] : ends[e]]
                n = size[c]
                at = np.r_[0, np.cumsum(n)]
                ids = flat[np.arange(at[-1]) + np.repeat(first[c] - at[:-1], n)]
                bounds = at[ends[a : e + 1] - ends[a]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc.slice(a, e - a), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))], ["doc_id", "ids"])


def encode_corpus(df: DataFrame, id_: str, text: str, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every text."""
    scratch = Scratch(df.sparkSession, "tokens")
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = scratch.keep(rows.mapInArrow(_blocks(pattern), "block long, ids array<long>, lengths array<int>, codes binary, words array<string>"))
    positions = blocks.select("block", F.posexplode("words").alias("i", "word"))
    encoded = positions.select("word").distinct().mapInArrow(_encode_words(path, pattern), "word string, ids array<int>")
    tables = positions.join(encoded, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("table"))
    whole = blocks.select("block", "ids", "lengths", "codes").join(tables, "block", "left")
    return whole.select("ids", "lengths", "codes", F.coalesce("table", F.array().cast("array<struct<i:int,ids:array<int>>>")).alias("table")).mapInArrow(_assemble, "doc_id long, ids array<int>")


def _decode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, first = table.value
        size = np.diff(first)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                lists = part.column(1)
                ids = lists.flatten().to_numpy()
                ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
                n = size[ids]
                at = np.r_[0, np.cumsum(n)]
                data = flat[np.arange(at[-1]) + np.repeat(first[ids] - at[:-1], n)].tobytes()
                texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids rows: ids join the table of token bytes, whose size the vocabulary fixes, on the map side."""
    ranks = _ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        pieces[k] = piece
    table = np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(x) for x in pieces])]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(encoded.sparkSession.sparkContext.broadcast(table)), "doc_id long, text string")
