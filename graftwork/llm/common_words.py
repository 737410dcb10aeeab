"""Document frequencies of all texts, reduced to the table of common words.

The counts cover every text. A word is common when at least one text in ``RARE`` holds it; with w
distinct words in an average text no more than w * RARE words can be, however large the corpus: that is
the proven bound on what is sent to the tasks.

A word that one text alone holds can't be shared with any other. ``shared`` marks the words of two texts or more in a bitmap of
fixed size (``SLOTS`` bits), so that the others may be left out of a signature. Where two words meet in one slot, a word is
taken for a shared one; the bitmap never calls a shared word unshared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.words import Words

RARE = 4096
SLOTS = 1 << 27


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    for b in batches:
        w = Words(b.column(0))
        _, code = w.sets()
        n = np.bincount(code, minlength=len(w.distinct))
        for k, v in zip(w.hash.view(np.int64).tolist(), n.tolist(), strict=True):
            held[k] = held.get(k, 0) + v
        if len(held) > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held = {}
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["word", "n"])


def slot_bit() -> str:
    """SQL of the bit, within its block of 64, of the slot of ``word``."""
    return f"shiftrightunsigned(word, {64 - (SLOTS.bit_length() - 1)}) & 63"


class CommonWords:
    """hash (sorted) and count of the common words, and the number of texts."""

    def __init__(self, hash_: np.ndarray, count: np.ndarray, texts: int, block: np.ndarray | None = None, bits: np.ndarray | None = None):
        order = np.argsort(hash_)
        self.hash, self.count, self.texts = hash_[order], count[order], texts
        self.block = self.bits = None
        if block is not None:
            order = np.argsort(block)
            self.block, self.bits = block[order], bits[order].view(np.uint64)

    @classmethod
    def of(cls, *texts: DataFrame, rare: int = RARE, shared: bool = False) -> CommonWords:
        """texts: frames whose only column is the text. shared: also mark the words that two texts or more hold."""
        n_texts = sum(t.count() for t in texts)
        parts = [t.mapInArrow(_counts, "word long, n long") for t in texts]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        counts = whole.groupBy("word").agg(F.sum("n").alias("n"))
        common = F.col("n") * rare >= n_texts
        kept = counts.where(common).select(F.lit(0).alias("kind"), "word", "n")
        if shared:
            slot = F.shiftrightunsigned("word", 64 - (SLOTS.bit_length() - 1))
            marks = counts.where((F.col("n") > 1) & ~common).groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot_bit()} as int))")).alias("n"))
            kept = kept.unionByName(marks.select(F.lit(1).alias("kind"), "word", "n"))
        t = kept.toArrow()
        kind, word, n = (t[c].to_numpy() for c in ("kind", "word", "n"))
        c, m = kind == 0, kind == 1
        return cls(word[c].view(np.uint64), n[c], n_texts, *((word[m], n[m]) if shared else ()))

    def save(self, spark, path: str) -> None:
        """Keeps the counts (not the marks of shared words)."""
        rows = pa.table({"word": np.r_[self.hash.view(np.int64), 0], "n": np.r_[self.count, self.texts], "kind": np.r_[np.zeros(len(self.hash), np.int32), np.int32(1)]})
        spark.createDataFrame(rows).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> CommonWords:
        t = spark.read.schema("word long, n long, kind int").parquet(path).toArrow()
        word, n, kind = (t[c].to_numpy() for c in ("word", "n", "kind"))
        return cls(word[kind == 0].view(np.uint64), n[kind == 0], int(n[kind == 1][0]))

    def is_shared(self, hash_: np.ndarray) -> np.ndarray:
        """Whether another text may hold the word."""
        if self.block is None:
            return np.ones(len(hash_), bool)
        slot = (hash_ >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        out = np.isin(hash_, self.hash[self.count > 1])
        if len(self.block):
            at = np.minimum(np.searchsorted(self.block, slot >> 6), len(self.block) - 1)
            out |= (self.block[at] == slot >> 6) & ((self.bits[at] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out

    def counts(self, hash_: np.ndarray) -> np.ndarray:
        """Texts that hold the word; 0 for words that are not common."""
        out = np.zeros(len(hash_), np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hash_), len(self.hash) - 1)
            there = self.hash[at] == hash_
            out[there] = self.count[at[there]]
        return out

    def share(self, hash_: np.ndarray, rare: int = RARE) -> np.ndarray:
        """Share of the texts that hold the word, at most: words that are not common count as held by one text in ``rare``, unshared ones as held by none."""
        n = self.counts(hash_)
        out = np.maximum(n / max(1, self.texts), 1 / rare)
        return np.where((n > 1) | self.is_shared(hash_), out, 0.0)
