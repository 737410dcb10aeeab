"""Near-duplicate records with small edits: BagMinHash, bands, and a check of the overlap.

Every word owns the Poisson processes of ``BagMinHash``, whose rate is its weight (the rarer, the larger, in powers of two). Its first arrival
is the same in every text, so a text's signature is its earliest arrivals: not one for each of a fixed number of positions, which can miss a
pair, but as many of one position as two alike texts need to have one in common for certain (``prefix_keys``; for 22 words at
0.7 these are seven). Bands are single arrivals of rare words and runs of arrivals of common ones; they meet in one
shuffle. Texts that share one are compared in whole arrays: their places in the two signatures bound the overlap, and a parity
sketch that travels along never refuses a true pair. The few that remain are verified on the words themselves.

Copies are collapsed to one class before anything is compared (the hash of the words in order names the class), so a
group of copies, however large, is one row of each band and of the verification. Classes travel by the first 40 bits of their name;
the verification and all after it use all 64.

Defined results: null, empty and short texts (fewer than ``min_words`` distinct words) are alike to
nothing; repeated rows of one id count once; texts with the same letters are copies, not near
duplicates; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.common_words import CommonWords
from graftwork.llm.prefixes import ordered, prefix_keys
from graftwork.llm.words import Words, mix, odd_sketch

#: A band takes arrivals until no more than FEW texts are expected to share it, DEEP at most.
FEW, DEEP = 512, 4
#: Exponent of a word's rarity in its weight, and weight levels (powers of two).
GAMMA, LEVELS = 2.0, 28
#: A word is rare (and has the top weight) when fewer than one text in so many holds it.
RARE = 8192
#: A band row is two numbers: 36 bits of the band and 28 of the class; 12 of the class, the sketch, the place and the size (``size_code``).
BAND_BITS, CLASS_BITS, SKETCH_BITS, PLACE_BITS, SIZE_BITS = 36, 40, 40, 4, 8
#: The exact test compares so many bytes of each word's hash.
WORD_BYTES = 5
#: Texts whose keys, and pairs of band rows, that are held at once.
KEYED_ROWS, PAIRS = 2_000, 1 << 21


class BagMinHash:
    """Signatures of weighted bags.

    A word of weight w owns one Poisson process for each position over the weight range [0, w]. The range is
    halved again and again: [0, 1], (1, 2], (2, 4] ... in units of the least weight; each part has a process
    of its own, drawn from the word and the part alone, so a larger weight only adds the points of its
    further parts. The first arrival over all words is the signature's value; two bags have it in
    common with the probability of their weighted Jaccard similarity.
    """

    def __init__(self, positions: int, seed: int = 1):
        self.positions, self.seed = positions, seed

    def arrivals(self, hash_: np.ndarray, level: np.ndarray) -> np.ndarray:
        """First arrival of each word at each position; level -1 has no weight and never arrives."""
        out = np.full((len(hash_), self.positions), np.inf, np.float32)
        place = mix(np.arange(self.positions, dtype=np.uint64) + np.uint64(self.seed << 20))
        for part in range(int(level.max(initial=-1)) + 1):
            width = 1.0 if part == 0 else 2.0 ** (part - 1)
            have = np.flatnonzero(level >= part)
            for a in range(0, len(have), 4096):
                at = have[a : a + 4096]
                base = mix(hash_[at] + np.uint64(part * 0x632BE59BD9B4E019 % 2**64))
                u = (mix(base[:, None] ^ place[None, :]) >> np.uint64(11)).astype(np.float64)
                points = -np.log((u + 0.5) / 2.0**53) / width
                out[at] = np.minimum(out[at], points.astype(np.float32))
        return out

    def signatures(self, text: np.ndarray, code: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
        """Rows of first arrivals for texts given as (text, code) pairs sorted by text; texts without words are infinite."""
        out = np.full((n, self.positions), np.inf, np.float32)
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
        for a in range(0, len(first), 2048):
            b = min(len(first), a + 2048)
            end = first[b] if b < len(first) else len(text)
            out[text[first[a:b]]] = np.minimum.reduceat(table[code[first[a] : end]], first[a:b] - first[a], axis=0)
        return out


def arrival_order(hash_: np.ndarray, share: np.ndarray) -> np.ndarray:
    """First arrival of each word at one position, -1 for words that no other text holds (they go first and make no band)."""
    level = LEVELS - 1 - np.rint(GAMMA * np.log2(np.maximum(share * RARE, 1))).astype(np.int64)
    return np.where(share > 0, BagMinHash(1).arrivals(hash_, np.clip(level, 0, LEVELS - 1))[:, 0], -1.0)


def size_code(size: np.ndarray) -> np.ndarray:
    """A size as a number below 256: itself up to 63, beyond that in steps of a ninth, rounded up."""
    n = np.maximum(size, 1)
    return np.where(n < 64, n, np.minimum(63 + np.ceil(np.log(n / 63.0) * 9.5), 255)).astype(np.uint64)


def most_words(code: np.ndarray) -> np.ndarray:
    """The largest size with this code (the last code has no largest)."""
    n = code.astype(np.float64)
    return np.where(n < 64, n, np.where(n < 255, np.floor(63 * np.exp((n - 63) / 9.5)) + 1, 1e12))


def least_words(code: np.ndarray) -> np.ndarray:
    """The smallest size with this code."""
    n = code.astype(np.float64)
    return np.where(n < 64, n, np.floor(63 * np.exp((n - 64) / 9.5)))


def _keyed(common, least: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = common.value
        seen: set[int] = set()
        for whole in batches:
            for a in range(0, whole.num_rows, KEYED_ROWS):
                b = whole.slice(a, KEYED_ROWS)
                w = Words(b.column(0))
                text, code = w.sets()
                n = np.bincount(text, minlength=b.num_rows)
                class_ = w.words_hash()
                fresh = fresh_names(class_, n >= min_words, seen)  # copies within a task are sent once
                keep = fresh[text]
                share = weights.share(w.hash, RARE)
                text, code = ordered(text[keep], code[keep], arrival_order(w.hash, share), w.hash)
                sketch = odd_sketch(w.hash[code], text, b.num_rows, SKETCH_BITS)
                name = class_ >> np.uint64(64 - CLASS_BITS)
                rest = CLASS_BITS + BAND_BITS - 64  # bits of the class that stand in the second number
                second = (name << np.uint64(64 - rest)) | (sketch << np.uint64(PLACE_BITS + SIZE_BITS)) | size_code(n)
                owner, keys, place = prefix_keys(text, code, w.hash, share, weights.texts, least, min_words, DEEP, FEW)
                first = (keys >> np.uint64(64 - BAND_BITS) << np.uint64(64 - BAND_BITS)) | (name >> np.uint64(rest))[owner]
                second = second[owner] | np.minimum(place, (1 << PLACE_BITS) - 1).astype(np.uint64) << np.uint64(SIZE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], ["k", "v"])

    return run


def fresh_names(names: np.ndarray, wanted: np.ndarray, seen: set[int]) -> np.ndarray:
    """The wanted rows whose name this task has not had before, as far as it remembers."""
    if len(seen) > 500_000:
        seen.clear()
    out = np.zeros(len(names), bool)
    for i in np.flatnonzero(wanted).tolist():
        if (c := int(names[i])) not in seen:
            seen.add(c)
            out[i] = True
    return out


def _meet(k: np.ndarray, v: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of class names among sorted band rows that share a band and may be alike. At similarity t sets of sizes a and b differ in no more
    than (a + b)(1 - t)/(1 + t) words; if their first common words stand at places i and j, no more than min(a - i, b - j) are common."""
    band, rest = k >> (64 - BAND_BITS), CLASS_BITS + BAND_BITS - 64
    name = (k & ((1 << (64 - BAND_BITS)) - 1)).view(np.uint64) << np.uint64(rest) | v >> np.uint64(64 - rest)
    coded = v & np.uint64((1 << SIZE_BITS) - 1)
    size, floor = most_words(coded), least_words(coded)
    left = size - ((v >> np.uint64(SIZE_BITS)) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.float64)
    sketch = (v << np.uint64(rest)) >> np.uint64(rest + PLACE_BITS + SIZE_BITS)
    n = np.searchsorted(band, band, "right") - np.arange(len(k)) - 1  # each row meets those behind it
    stop = np.r_[0, np.cumsum(n)]
    cuts = np.unique(np.r_[np.searchsorted(stop, np.arange(0, stop[-1], PAIRS)), len(k)])
    for s, e in zip(cuts, cuts[1:], strict=False):
        x = np.repeat(np.arange(s, e), n[s:e])
        y = x + 1 + np.arange(len(x)) - np.repeat(stop[s:e] - stop[s], n[s:e])
        ok = np.minimum(left[x], left[y]) * (1 + least) >= (floor[x] + floor[y]) * least - 1e-6
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(sketch[x] ^ sketch[y]) <= (size[x] + size[y]) * ((1 - least) / (1 + least)) + 1e-6
        a, b = name[x[ok]], name[y[ok]]
        other = a != b
        yield np.minimum(a, b)[other], np.maximum(a, b)[other]


def _candidates(least: float):
    """Band rows of whole bands, sorted, -> a, b."""

    def told(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _meet(k, v, least):
            pairs = np.unique(np.stack([a, b]), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, v = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k, v = np.r_[k, batch["k"].to_numpy()], np.r_[v, batch["v"].to_numpy().view(np.uint64)]
            if not len(k):
                continue
            # the last band may go on in the next batch
            done = np.searchsorted(k, k[-1] >> (64 - BAND_BITS) << (64 - BAND_BITS), "left")
            yield from told(k[:done], v[:done])
            k, v = k[done:], v[done:]
        yield from told(k, v)

    return run


def candidate_classes(texts: DataFrame, least: float, min_words: int) -> DataFrame:
    """a, b: pairs of class names of CLASS_BITS (a < b) that share a band and may be alike."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(CommonWords.of(texts, rare=RARE, shared=True))
    packed = texts.mapInArrow(_keyed(common, least, min_words), "k long, v long")
    bands = packed.repartition(F.shiftrightunsigned("k", 64 - BAND_BITS)).sortWithinPartitions("k")
    return bands.mapInArrow(_candidates(least), "a long, b long").distinct()


def _facts(min_words: int, kind: str):
    """members: id, class and letters of each text that has enough words; words: class and distinct words, once for each class of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for a in range(0, whole.num_rows, KEYED_ROWS):
                b = whole.slice(a, KEYED_ROWS)
                w = Words(b.column(b.num_columns - 1))
                text, code = w.sets()
                n = np.bincount(text, minlength=b.num_rows)
                keep, class_ = n >= min_words, w.words_hash()
                if kind == "members":
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(class_[keep].view(np.int64)), pa.array(w.letters_hash()[keep].view(np.int64))], ["id", "class", "letters"])
                    continue
                keep = fresh_names(class_, keep, seen)
                yield pa.RecordBatch.from_arrays([pa.array(class_[keep].view(np.int64)), packed_words(w.hash[code][keep[text]], n[keep])], ["class", "words"])

    return run


def packed_words(hash_: np.ndarray, size: np.ndarray) -> pa.Array:
    """WORD_BYTES of each word's hash, one value for each set."""
    blob = hash_[:, None].view(np.uint8)[:, 8 - WORD_BYTES :].tobytes()
    ends = np.r_[0, np.cumsum(size)] * WORD_BYTES
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(blob)])


def _rows_of_words(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of packed sets."""
    blob = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, WORD_BYTES)
    wide = np.zeros((len(blob), 8), np.uint8)
    wide[:, :WORD_BYTES] = blob
    n = np.array([len(x) for x in packed.to_pylist()], np.int64) // WORD_BYTES
    return np.repeat(np.arange(len(n)), n), wide.view(np.uint64)[:, 0]


def alike_sets(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """Exact test on packed sets, in whole numbers of thousandths. The sets differ by insertions and deletions alone."""
    row_a, hash_a = _rows_of_words(a)
    row_b, hash_b = _rows_of_words(b)
    n_a, n_b = (np.bincount(r, minlength=len(a)) for r in (row_a, row_b))
    both = np.concatenate([row_a.astype(np.uint64) << np.uint64(40) | hash_a, row_b.astype(np.uint64) << np.uint64(40) | hash_b])
    both.sort()
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(a))
    return common * 1000 >= (n_a + n_b - common) * round(least * 1000)


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(alike_sets(b["words_a"], b["words_b"], least))
            yield pa.RecordBatch.from_arrays([b["class_a"].filter(keep), b["class_b"].filter(keep)], ["class_a", "class_b"])

    return run


def alike_classes(df: DataFrame, id_: str, text: str, least: float = 0.8, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b) of every two classes that are alike, and (id, class, letters) of every text: the result without
    the pairs within and between groups of copies."""
    rows_in = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = rows_in.schema["id"].dataType.simpleString()
    texts = rows_in.select("text")
    name = F.shiftrightunsigned("class", 64 - CLASS_BITS)
    pairs = candidate_classes(texts, least, min_words)
    known = texts.mapInArrow(_facts(min_words, "words"), "class long, words binary").withColumn("name", name).repartition("name").dropDuplicates().where("name IS NOT NULL AND class IS NOT NULL")
    one = known.select(F.col("name").alias("a"), F.col("class").alias("class_a"), F.col("words").alias("words_a"))
    two = known.select(F.col("name").alias("b"), F.col("class").alias("class_b"), F.col("words").alias("words_b"))
    # classes that share a name are no candidates of each other yet
    twins = one.join(two, F.col("a") == F.col("b")).where("class_a < class_b")
    told = pairs.join(one, "a").join(two, "b").select("class_a", "words_a", "class_b", "words_b").unionByName(twins.select("class_a", "words_a", "class_b", "words_b"))
    members = rows_in.mapInArrow(_facts(min_words, "members"), f"id {kind}, class long, letters long")
    return told.mapInArrow(_alike(least), "class_a long, class_b long"), members


def near_duplicates(df: DataFrame, id_: str, text: str, least: float = 0.8, min_words: int = 8) -> DataFrame:
    """id_a, id_b (id_a < id_b): records whose texts are alike but do not have the same letters."""
    pairs, members = alike_classes(df, id_, text, least, min_words)
    one = members.select(F.col("class").alias("class_a"), F.col("id").alias("x"), F.col("letters").alias("letters_a"))
    two = members.select(F.col("class").alias("class_b"), F.col("id").alias("y"), F.col("letters").alias("letters_b"))
    told = pairs.join(one, "class_a").join(two, "class_b").where("x <> y AND letters_a <> letters_b")
    return told.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
