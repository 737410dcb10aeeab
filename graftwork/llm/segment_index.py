"""Deduplicating new batches against all history by a segment index.

The distinct words of a text, put in an order that is frozen with the index (words that are rare in the history first), are a string over
words, and two texts are alike if the edit distance of their strings (insertions and deletions) is within the bound that the
similarity sets for their lengths. A string of a words is cut into a fixed number of segments by its length: with e words that may be
edited away before the first one that survives, e + 1 segments of one word at places 0..e, and the rest. Of those e + 1 at
least one survives in every string within the bound. A segment of a common word is widened, place by place, by the words that
may be the next to survive, until few texts are expected to hold it (``prefix_keys``), so a segment is never unselective for being
short. The letters of the whole text are a segment of their own, which finds exact copies, those of the shortest texts included.

Segments are stored with length and place. A probe selects the substrings of a new text that can be segments of a stored one, looks them
up, leaves out pairs whose lengths or places rule the bound out or whose parity sketches differ too much (a true pair is never
refused), and verifies the edit distance of the few that remain on the packed words.

``SegmentIndex`` lives in a folder: segments by key and texts by class (``Runs``, whose buckets follow their number), and the frozen
frequencies. A session that opens the folder later goes on with it. ``append`` splits and writes only the new texts; ``probe`` reads
the buckets that the batch's own segments fall into: what is read depends on the batch, not on the history.

Defined results: null texts and texts without letters match nothing; a repeated row gives its pairs
once; a null batch number matches nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common_words import CommonWords
from graftwork.llm.near_duplicates import KEYED_ROWS, WORD_BYTES, alike_sets, fresh_names, packed_words
from graftwork.llm.prefixes import ordered, prefix_keys
from graftwork.runs import Bucket, Runs, bucket_of
from graftwork.llm.words import Words, mix, odd_sketch
from graftwork.scratch import Scratch

#: A segment takes words until no more than FEW texts of the history are expected to hold it, DEEP at most.
FEW, DEEP = 256, 4
RARE = 8192
SKETCH_BITS = 63
#: Lengths from here on are stored as this one and rule nothing out.
LONGEST = (1 << 15) - 1
#: Segments that a task gathers before it packs them.
GATHERED = 1 << 18
#: Segments of an average text: only the first guess of how many buckets a run needs.
SEGMENTS = 16
SEGMENT = np.dtype([("key", "<i8"), ("ref", "<i8"), ("sketch", "<i8"), ("size", "<i2"), ("place", "<i2")])


class Frozen:
    """What the cuts depend on: frequencies, similarity, least number of words."""

    def __init__(self, weights: CommonWords, least: float, min_words: int):
        self.weights, self.least, self.min_words = weights, least, min_words

    def segments(self, w: Words, seen: set[int]) -> np.ndarray:
        """Rows of SEGMENT for the texts whose class is new to the task; length 0 marks the segment of all letters."""
        text, code = w.sets()
        n = len(w.size)
        size = np.bincount(text, minlength=n)
        class_ = w.words_hash()
        some = fresh_names(class_, w.size > 0, seen)
        fit = (some & (size >= self.min_words))[text]
        share = self.weights.share(w.hash, RARE)
        t, c = ordered(text[fit], code[fit], share, w.hash)
        owner, keys, place = prefix_keys(t, c, w.hash, share, self.weights.texts, self.least, self.min_words, DEEP, FEW)
        whole = np.flatnonzero(some)
        out = np.zeros(len(whole) + len(owner), SEGMENT)
        out["key"] = np.r_[mix(w.letters_hash()[whole] ^ np.uint64(0xA5A5)), keys].view(np.int64)
        at = np.r_[whole, owner]
        out["ref"] = class_[at].view(np.int64)
        out["sketch"] = odd_sketch(w.hash[code], text, n, SKETCH_BITS)[at].view(np.int64)
        out["size"] = np.r_[np.zeros(len(whole), np.int64), np.minimum(size[owner], LONGEST)]
        out["place"] = np.r_[np.zeros(len(whole), np.int64), np.minimum(place, LONGEST)]
        return out

    def matches(self, new: np.ndarray, mine: np.ndarray, old: pa.RecordBatch, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of segments with one key (places in new and old) that can belong to texts within the bound."""
        least = round(self.least * 1000)
        a, b = np.ascontiguousarray(new["size"]).astype(np.int32)[mine], old["size"].to_numpy().astype(np.int32)[theirs]
        x, y = (np.ascontiguousarray(new["size"] - new["place"]))[mine], (old["size"].to_numpy() - old["place"].to_numpy())[theirs]
        near = np.minimum(x, y).astype(np.int32) * (1000 + least) >= (a + b) * least  # words that can still be common
        near &= np.minimum(a, b) * 1000 >= np.maximum(a, b) * least
        near |= np.maximum(a, b) == LONGEST
        near = np.where((a == 0) | (b == 0), a == b, near)
        mine, theirs, total = mine[near], theirs[near], (a + b)[near]
        differ = np.bitwise_count(np.ascontiguousarray(new["sketch"])[mine] ^ old["sketch"].to_numpy()[theirs]).astype(np.int32)
        near = (differ * (1000 + least) <= total * (1000 - least)) | (total == 0) | (total >= LONGEST)
        return mine[near], theirs[near]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, KEYED_ROWS):
            yield b.slice(a, KEYED_ROWS)


def _segment_rows(frozen):
    """text -> rows of the segment table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches):
            s = frozen.value.segments(Words(b["text"]), seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(s[c])) for c in SEGMENT.names], list(SEGMENT.names))

    return run


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Larger arrays: with many buckets a small one would fall apart into single segments."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= GATHERED:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _probe_rows(frozen, bits: int):
    """text -> segments packed by the bucket that they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for held in _gathered(frozen.value.segments(Words(b["text"]), seen) for b in _slices(batches)):
            s = held[np.argsort(held["key"], kind="stable")]
            at = (s["key"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(s) else np.empty(0, np.int64)
            parts = [s[x:y].tobytes() for x, y in zip(first, np.r_[first[1:], len(s)], strict=True)] if len(s) else []
            yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "packed"])

    return run


def _look_up(frozen, places: list[tuple[str, int]], bits: int, read):
    """Packed segments of a bucket -> new, old: classes that share a segment and may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for b in batches:
            for number, packed in zip(b["bucket"].to_pylist(), b["packed"].to_pylist(), strict=True):
                if number != at:
                    if bucket is not None:
                        read.add(bucket.bytes)
                        bucket.close()
                    at, bucket = number, Bucket(places, number, bits)
                new = np.frombuffer(packed, SEGMENT)
                for rows, mine, theirs in bucket.lookup(new["key"]):
                    mine, theirs = frozen.value.matches(new, mine, rows, theirs)
                    pairs = np.unique(np.stack([new["ref"][mine], rows["ref"].to_numpy()[theirs]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["new", "old"])
        if bucket is not None:
            read.add(bucket.bytes)

    return run


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, batch, text -> key (the class), id, batch, letters, words."""
    for b in _slices(batches):
        w = Words(b["text"])
        text, code = w.sets()
        keep = pa.array(w.size > 0)
        columns = [pa.array(w.words_hash().view(np.int64)), b["id"], b["batch"], pa.array(w.letters_hash().view(np.int64)), packed_words(w.hash[code], np.bincount(text, minlength=b.num_rows))]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["key", "id", "batch", "letters", "words"])


def _verify(frozen, places: list[tuple[str, int]], bits: int, read):
    """Rows (bucket, old, id, batch, letters, words), sorted by old -> new_id, old_id within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket, own = None, None, frozen.value
        for b in batches:
            number = b["bucket"].to_numpy()
            turn = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if b.num_rows else np.empty(0, np.int64)
            for s, e in zip(turn, np.r_[turn[1:], b.num_rows], strict=False):
                if number[s] != at:
                    if bucket is not None:
                        read.add(bucket.bytes)
                        bucket.close()
                    at, bucket = number[s], Bucket(places, int(number[s]), bits)
                part = b.slice(s, e - s)
                for rows, mine, theirs in bucket.lookup(part["old"].to_numpy()):
                    for c in range(0, len(mine), 1 << 16):
                        new, old = part.take(pa.array(mine[c : c + (1 << 16)])), rows.take(pa.array(theirs[c : c + (1 << 16)]))
                        words = new["words"], old["words"]
                        enough = [pc.binary_length(x).to_numpy() >= WORD_BYTES * own.min_words for x in words]
                        same = new["letters"].to_numpy() == old["letters"].to_numpy()
                        good = (same | (enough[0] & enough[1] & alike_sets(*words, own.least))) & (old["batch"].to_numpy() < new["batch"].to_numpy())
                        yield pa.RecordBatch.from_arrays([new["id"].filter(pa.array(good)), old["id"].filter(pa.array(good))], ["new_id", "old_id"])
        if bucket is not None:
            read.add(bucket.bytes)

    return run


class SegmentIndex:
    """The index in a folder (see the module's text). ``bytes_read``: of stored tables, by the probes run so far."""

    def __init__(self, spark: SparkSession, path: str, least: float = 0.8, min_words: int = 8, bucket_rows: int = 1 << 18):
        self.spark, self.path, self.least, self.min_words = spark, path, least, min_words
        self.segments = Runs(spark, f"{path}/segments", "key long, ref long, sketch long, size short, place short", bucket_rows)
        self.texts = Runs(spark, f"{path}/texts", "key long, id string, batch long, letters long, words binary", max(1, bucket_rows // 8))
        self.frozen, self.bytes_read = None, spark.sparkContext.accumulator(0)
        if self.segments.state["runs"]:
            self._freeze(CommonWords.load(spark, f"{path}/frequencies"))

    def _freeze(self, weights: CommonWords) -> None:
        self.frozen = self.spark.sparkContext.broadcast(Frozen(weights, self.least, self.min_words))

    def append(self, batch: DataFrame) -> None:
        """Adds accepted (old_id, text, batch BIGINT) rows; the frequencies are those of the first rows ever added."""
        rows = batch.select(F.col("old_id").cast("string").alias("id"), "batch", "text").where("id IS NOT NULL AND batch IS NOT NULL AND text IS NOT NULL")
        n = rows.count()
        if not n:
            return
        if self.frozen is None:
            weights = CommonWords.of(rows.select("text"), rare=RARE)
            weights.save(self.spark, f"{self.path}/frequencies")
            self._freeze(weights)
        self.texts.append(rows.mapInArrow(_facts, self.texts.schema), n)
        self.segments.append(rows.select("text").mapInArrow(_segment_rows(self.frozen), self.segments.schema), n * SEGMENTS)

    def probe(self, batch: DataFrame) -> DataFrame:
        """new_id, old_id for the rows (new_id, text, batch BIGINT) of a batch that repeat a stored text of a smaller batch number."""
        rows = batch.select(F.col("new_id").alias("id"), "batch", "text").where("id IS NOT NULL AND batch IS NOT NULL AND text IS NOT NULL")
        kind = rows.schema["id"].dataType.simpleString()
        if self.frozen is None:
            return rows.select(F.col("id").alias("new_id"), F.lit(None).cast("string").alias("old_id")).where("false")
        bits = self.segments.bits
        packed = rows.select("text").mapInArrow(_probe_rows(self.frozen, bits), "bucket int, packed binary")
        # any task can read any bucket, so a bucket that many segments fall into is split by size
        met = packed.hint("rebalance", "bucket").sortWithinPartitions("bucket")
        pairs = met.mapInArrow(_look_up(self.frozen, self.segments.places(), bits, self.bytes_read), "new long, old long").distinct()
        told = pairs.join(rows.mapInArrow(_facts, f"key long, id {kind}, batch long, letters long, words binary"), F.col("new") == F.col("key"))
        bits = self.texts.bits
        told = told.select(bucket_of(F.col("old"), bits).alias("bucket"), "old", "id", "batch", "letters", "words")
        told = told.hint("rebalance", "bucket").sortWithinPartitions("bucket", "old")
        return told.mapInArrow(_verify(self.frozen, self.texts.places(), bits, self.bytes_read), f"new_id {kind}, old_id string").distinct()


def repeats_of_history(new: DataFrame, history: DataFrame, least: float = 0.8, min_words: int = 8, waves: int = 3) -> DataFrame:
    """new_id, old_id: texts of ``new`` (new_id, text, batch) that repeat a text of ``history`` (old_id, text, batch) of an earlier batch.

    The batches are played back in ``waves`` ranges: what the history gained up to the end of a range is appended to an index, then
    the range's texts are probed against it."""
    spark = new.sparkSession
    index = SegmentIndex(spark, Scratch(spark, "segments").path(), least, min_words)
    low, high = new.agg(F.min("batch"), F.max("batch")).first()
    if low is None:
        return index.probe(new)
    step, start, found = (high - low) // waves + 1, None, []
    for k in range(waves):
        a, b = low + k * step, low + (k + 1) * step
        index.append(history.where((F.col("batch") < b) if start is None else (F.col("batch") >= start) & (F.col("batch") < b)))
        found.append(index.probe(new.where((F.col("batch") >= a) & (F.col("batch") < b))))
        start = b
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
