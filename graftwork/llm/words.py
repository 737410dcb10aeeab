"""Words and letters of texts, in batches and as expressions.

Words are maximal runs of letters or digits, lowercased. The letters of a text are its words joined
without gaps. ``Words`` splits a whole Arrow batch at once and numbers its distinct words, so Python
never handles single words of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

GAPS = r"[^\p{L}\p{N}]+"


def letters(c: Column) -> Column:
    """The words of a text joined without gaps (null for null)."""
    return F.lower(F.regexp_replace(c, GAPS, ""))


def words(c: Column) -> Column:
    """The words of a text in order (empty for null)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), GAPS), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit counter-based generator, elementwise."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes that are equal in every process."""
    one = xxhash.xxh3_64_intdigest
    return np.array([one(s) for s in strings], np.uint64)


_BASE = 0x9E3779B97F4A7C15


class Runs:
    """Hashes of runs of words: equal for equal runs, wherever they stand."""

    def __init__(self, word_hash: np.ndarray):
        n = len(word_hash)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])[:n]
            self.sum = np.r_[np.uint64(0), np.cumsum(mix(word_hash) * down)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[start]) * self.up[start] ^ (end - start).astype(np.uint64))


class Words:
    """The words of a batch of texts.

    ``code``: for each word in order, its number among the distinct words; ``start``: where each text
    begins (and one more); ``distinct``: the distinct words; ``hash``: their 64-bit hashes.
    """

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), GAPS)
        flat = split.flatten()
        start = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.start = np.r_[0, np.cumsum(real)][start]
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary.to_pylist()
        self.hash = hashes(self.distinct)
        self.size = np.diff(self.start)
        self.text = np.repeat(np.arange(len(texts)), self.size)

    def words_hash(self) -> np.ndarray:
        """64-bit hash of each text's words in order."""
        return Runs(self.hash[self.code]).of(self.start[:-1], self.start[1:])

    def letters_hash(self) -> np.ndarray:
        """64-bit hash of each text's letters, however they are cut into words."""
        one, parts, code, start = xxhash.xxh3_64_intdigest, self.distinct, self.code.tolist(), self.start.tolist()
        return np.array([one("".join([parts[k] for k in code[a:b]])) for a, b in zip(start, start[1:], strict=False)], np.uint64)

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct words: (text, code) pairs, sorted by text."""
        pairs = np.sort(self.text * max(1, len(self.distinct)) + self.code)
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        return pairs // max(1, len(self.distinct)), pairs % max(1, len(self.distinct))


def odd_sketch(hash_: np.ndarray, text: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Each set as the parity of its words over so many bits. The number of bits in which two
    sketches differ is never more than the number of words in which the sets differ."""
    bit = np.uint64(1) << (hash_ >> np.uint64(40)) % np.uint64(bits)
    out = np.zeros(n, np.uint64)
    np.bitwise_xor.at(out, text, bit)
    return out
