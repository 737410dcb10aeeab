"""Evaluation texts leaking into training text: prefix-filtered set join of shingles.

Every run of ``RUN`` consecutive item words holds RUN - SHINGLE + 1 shingles of ``SHINGLE`` words. A document with that run holds
all of them, so the rarest one (by the number of documents that hold it, counted over the whole corpus)
is a necessary token: the prefix of the run. Only documents with a prefix token are looked at further; around each
hit the run may reach no farther than the item and the document do, and is verified word by word.

Items are taken in blocks of about ``HELD`` words, as many as they fill: a block (some 100 MB at most) is sent to the tasks and
set against all documents, so the corpus is read twice for each block and nothing of it is shuffled.

Defined results: null and empty texts, and items with fewer than ``RUN`` words, leak nothing; a passage that several items share
counts for each; a repeated row gives its pairs once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.words import Runs, Words

RUN, SHINGLE, HELD = 10, 5, 2_000_000
#: Texts that are split at a time.
SLICE = 1_000


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``size`` words within one text."""
    at = np.arange(max(0, len(w.code) - size + 1))
    at = at[w.text[at] == w.text[at + size - 1]] if len(at) else at
    return Runs(w.hash[w.code]).of(at, at + size), at


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            part = b.slice(a, SLICE)
            yield part.column(0), Words(part.column(1))


def _document_counts(held, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known), np.int64)
        for _, w in _slices(batches):
            h, at = shingles(w, size)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            pairs = np.unique(w.text[at[hit]] * len(known) + k[hit])
            total += np.bincount(pairs % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    return run


class Prefixes:
    """The items' words in one row, and the prefix tokens (sorted) with the places where they stand."""

    def __init__(self, ids: np.ndarray, w: Words, counts: dict[int, int], run: int, size: int):
        self.ids, self.run, self.size = ids, run, size
        self.words, self.text, self.start = w.hash[w.code], w.text, w.start
        h, at = shingles(w, size)
        inside = run - size + 1
        row = np.full(len(w.code) + run, -1, np.int64)
        row[at] = np.arange(len(at))
        begin = at[row[at + inside - 1] >= 0] if len(at) else at
        begin = begin[w.text[begin] == w.text[np.minimum(begin + run - 1, len(w.text) - 1)]] if len(begin) else begin
        n = np.array([counts.get(int(x), 0) for x in h.view(np.int64)], np.int64)
        options = row[begin[:, None] + np.arange(inside)[None, :]] if len(begin) else np.empty((0, inside), np.int64)
        order = np.lexsort((h, n))  # rarest first, ties by hash
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        chosen = np.unique(options[np.arange(len(begin)), np.argmin(rank[options], axis=1)]) if len(begin) else np.empty(0, np.int64)
        # a document may hold the token where another copy of it stands in the item, so every place counts
        places = np.flatnonzero(np.isin(h, h[chosen]))
        places = places[np.argsort(h[places], kind="stable")]
        self.token, self.place = h[places], at[places]

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) numbers of the texts that hold ``run`` consecutive words of an item."""
        h, at = shingles(w, self.size)
        left = np.searchsorted(self.token, h, "left")
        n = np.searchsorted(self.token, h, "right") - left
        hit = np.flatnonzero(n)
        n, own = n[hit], w.hash[w.code]
        q = self.place[np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        p = np.repeat(at[hit], n)
        reach = np.full(len(p), self.size)
        for step in (-1, 1):
            open_ = np.arange(len(p))
            for far in range(1, self.run - self.size + 1):
                x, y = (p[open_] - far, q[open_] - far) if step < 0 else (p[open_] + self.size - 1 + far, q[open_] + self.size - 1 + far)
                ok = (x >= w.start[w.text[p[open_]]]) & (x < w.start[w.text[p[open_]] + 1]) & (y >= self.start[self.text[q[open_]]]) & (y < self.start[self.text[q[open_]] + 1])
                open_, x, y = open_[ok], x[ok], y[ok]
                same = own[x] == self.words[y]
                open_ = open_[same]
                reach[open_] += 1
        good = reach >= self.run
        return w.text[p[good]], self.text[q[good]]


def _probe(prefixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Prefixes = prefixes.value
        for ids, w in _slices(batches):
            text, item = own.found(w)
            pairs = np.unique(text * max(1, len(own.ids)) + item)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs // max(1, len(own.ids)))), pa.array(own.ids[pairs % max(1, len(own.ids))])], ["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, size: int = SHINGLE, held: int = HELD) -> DataFrame:
    """doc_id, item_id: documents (doc_id BIGINT, text) with ``run`` consecutive words of an item (item_id BIGINT, text)."""
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    words = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // 2  # a word and its gap are two characters at least
    blocks = max(1, -(-words // held))
    found = [_block_leaks(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), run, size) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found).distinct()


def _block_leaks(docs: DataFrame, items: DataFrame, run: int, size: int) -> DataFrame:
    spark = docs.sparkSession
    local = items.toArrow().combine_chunks()
    w = Words(local["text"].combine_chunks()) if local.num_rows else None
    known = np.unique(shingles(w, size)[0]) if w else np.empty(0, np.uint64)
    if not len(known):
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).where("false")
    counted = docs.mapInArrow(_document_counts(spark.sparkContext.broadcast(known), size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(counted["shingle"].to_pylist(), counted["n"].to_pylist(), strict=True))  # at most one entry a known shingle
    prefixes = spark.sparkContext.broadcast(Prefixes(local["item_id"].to_numpy(), w, counts, run, size))
    return docs.mapInArrow(_probe(prefixes), "doc_id long, item_id long")
