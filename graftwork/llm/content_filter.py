"""Abusive, hateful or sexual content: a subsequence string-kernel SVM with Nyström landmarks.

The kernel compares short passages by the subsequences of four characters they share, within five, a skipped
character costing the factor ``GAP``: insults with a letter inserted, doubled, left out or
swapped keep most of theirs. Letters are compared in lower case; marks are dropped, digits between letters read
as the letters they imitate, letters repeated three times or more count once.

Training (``fit``): documents carry the labels, passages do not, so passages of a positive document compete: the one that
scores highest stands for it, starting from word odds, in a few rounds. Each passage is described by its kernel with
``LANDMARKS`` passages (Nyström); a squared-hinge SVM is fitted on that. Because the kernel's features are explicit, the
machine folds into one table of weights (landmarks times coefficients, summed), which gives exactly the same
decision, so scoring a corpus costs a few table lookups a character.

The sample for the fit is bounded: ``SAMPLE`` positive and as many negative labelled documents, those with the smallest
hash. Scoring covers every character of every document. A document's score is that of its worst passage.

Passages of any length are scored; one of fewer than five characters is read with the end of its line. Defined results: null
and empty texts, and texts without a letter or digit, have score ``NOTHING``. Documents whose raters disagree go by the
majority, ties count as positive; null labels are no votes. Without labels of both kinds the machine
scores everything ``NOTHING``. Repeated rows of documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, LANDMARKS, ROUNDS = 2_000, 512, 4
#: Hard and random negative passages of a round; cost of an error.
HARD, COST = 3_000, 5.0
#: A passage may stand for its text at once when its mean log odds reach this part of where they split in two groups.
SPLIT = 0.7
BITS, GAP, NOTHING = 18, 0.6, -9.0
#: Bytes of a passage: sentences up to WHOLE are one, longer ones are read in windows of WINDOW, STEP apart.
WHOLE, WINDOW, STEP = 100, 80, 40
POSITIVE = ("abusive", "hateful", "sexual")

#: Cyrillic and Greek letters and signs, and the Latin letters that they are drawn like.
_DRAWN_LIKE = {"а": "a", "с": "c", "е": "e", "і": "i", "ј": "j", "к": "k", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "α": "a", "ο": "o", "ν": "v", "@": "a", "$": "s"}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_READ = np.arange(256, dtype=np.uint8)
_READ[np.frombuffer(b"013457", np.uint8)] = np.frombuffer(b"oieast", np.uint8)
_DIGIT = _READ != np.arange(256)


class Passages:
    """The passages of a batch of texts: ``bytes``, and for each passage its text, start and end."""

    def __init__(self, texts: pa.Array):
        flat = pc.utf8_lower(pc.utf8_normalize(pc.fill_null(texts, ""), "NFKC"))
        for drawn, letter in _DRAWN_LIKE.items():
            flat = pc.replace_substring(flat, drawn, letter)
        flat = pc.replace_substring_regex(flat, r"[.!?…]+\s+|[\r\n]+|</?[a-z]+>", "\n")
        flat = pc.replace_substring_regex(flat, r"[\t\f\v \p{Zs}]+", " ")
        flat = pc.replace_substring_regex(flat, r"[^\p{L}\p{N} \n]+", "")
        flat = pc.binary_join_element_wise(flat, "", "\n")
        lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
        raw = np.frombuffer("".join(flat.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
        text = np.repeat(np.arange(len(texts)), lengths)
        if len(raw) > 2:
            near = np.zeros(len(raw), bool)
            near[1:] |= _LETTER[raw[:-1]]
            near[:-1] |= _LETTER[raw[1:]]
            raw = np.where(_DIGIT[raw] & near, _READ[raw], raw)
            same = np.zeros(len(raw), bool)
            same[1:] = (raw[1:] == raw[:-1]) & _LETTER[raw[1:]] & (raw[1:] < 128)
            thrice = same.copy()
            thrice[1:] &= same[:-1]
            run = thrice.copy()
            run[:-1] |= thrice[1:]  # of three or more equal letters only the first stays
            raw, text = raw[~run], text[~run]
        self.bytes = raw
        stop = np.flatnonzero(raw == 10)
        start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
        size = stop - start
        keep = size > 0
        start, size = start[keep], size[keep]
        n = np.where(size <= WHOLE, 1, -(-(size - WINDOW) // STEP) + 1)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size_, start_ = np.repeat(size, n), np.repeat(start, n)
        whole = size_ <= WHOLE
        self.start = np.where(whole, start_, start_ + np.minimum(j * STEP, np.maximum(size_ - WINDOW, 0)))
        self.end = np.where(whole, start_ + size_, self.start + WINDOW)
        self.text = text[self.start] if len(self.start) else np.empty(0, np.int64)

    @cached_property
    def features(self) -> list[tuple[np.ndarray, float]]:
        """For each kind of subsequence: the feature that starts at each byte, and its weight."""
        b = np.r_[self.bytes, np.zeros(5, np.uint8)].astype(np.uint32)
        n = len(self.bytes)
        at, over = [b[:n]], np.zeros(n, bool)
        for k in range(1, 5):  # nothing behind the end of a line belongs to what begins before it
            over = over | (at[k - 1] == 10)
            at.append(np.where(over, np.uint32(0), b[k : n + k]))
        out = []
        for places, weight in (((0, 1, 2, 3), 1.0), ((0, 2, 3, 4), GAP), ((0, 1, 3, 4), GAP), ((0, 1, 2, 4), GAP)):
            h = at[places[0]]
            for k in places[1:]:
                h = h * np.uint32(0x01000193) ^ at[k]
            out.append((((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32), weight))
        return out

    def length(self) -> np.ndarray:
        """Places of each passage at which subsequences begin."""
        return np.maximum(self.end - self.start - 4, 1)

    def norm(self) -> np.ndarray:
        return np.sqrt(self.length() * (1 + 3 * GAP * GAP))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Decision of the folded machine for each passage."""
        total = np.zeros(len(self.bytes) + 1)
        each = np.zeros(len(self.bytes), np.float32)
        for h, w in self.features:
            each += weights[h] * np.float32(w)
        np.cumsum(each, out=total[1:])
        return (total[self.start + self.length()] - total[self.start]) / self.norm() + bias

    def worst(self, weights: np.ndarray, bias: float, n: int) -> np.ndarray:
        """The highest score of each text."""
        out = np.full(n, NOTHING)
        np.maximum.at(out, self.text, self.scores(weights, bias))
        return out


def _vectors(p: Passages, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features (row, feature, value) of some passages, of unit norm."""
    length = p.length()[which]
    row = np.repeat(np.arange(len(which)), length)
    at = np.repeat(p.start[which], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    scale = (1 / p.norm()[which])[row]
    rows, cols, values = [], [], []
    for h, w in p.features:
        rows.append(row)
        cols.append(h[at])
        values.append(scale * w)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values).astype(np.float32)


class Landmarks:
    """The features of the landmark passages, by feature."""

    def __init__(self, p: Passages, which: np.ndarray):
        row, col, value = _vectors(p, which)
        order = np.argsort(col, kind="stable")
        self.n, self.row, self.col, self.value = len(which), row[order], col[order], value[order]
        self.start = np.searchsorted(self.col, np.arange((1 << BITS) + 1))

    def kernel(self, p: Passages, which: np.ndarray) -> np.ndarray:
        """Kernel of passages with each landmark."""
        out = np.zeros((len(which), self.n), np.float32)
        for a in range(0, len(which), 100):
            part = which[a : a + 100]
            row, col, value = _vectors(p, part)
            n = self.start[col + 1] - self.start[col]
            at = np.repeat(self.start[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(row, n) * self.n + self.row[at]
            out[a : a + 100] = np.bincount(cell, np.repeat(value, n) * self.value[at], len(part) * self.n).reshape(len(part), self.n)
        return out

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """One weight for each feature: the landmarks' features times their coefficients."""
        return np.bincount(self.col, self.value * beta[self.row], 1 << BITS).astype(np.float32)


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 20) -> tuple[np.ndarray, float]:
    """Linear SVM by Newton steps; cost: the weight of each row's loss."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (z @ w) < 1
        a, c = z[inside], cost[inside]
        new = np.linalg.solve(ridge + (a.T * c) @ a, a.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w[:-1], float(w[-1])


class Machine:
    """Folded weights, bias, and the gap between the scores of harmless and other documents; from its middle, ``threshold``, on a document counts."""

    def __init__(self, weights: np.ndarray, bias: float, low: float, high: float):
        self.weights, self.bias, self.low, self.high = weights.astype(np.float32), bias, low, high
        self.threshold = (low + high) / 2

    @classmethod
    def train(cls, texts: list[str | None], positive: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 7) -> Machine:
        """positive: whether each text holds such a passage."""
        if not len(positive) or not positive.any() or positive.all():
            return cls(np.zeros(1 << BITS), NOTHING, 0.0, 0.0)
        rng = np.random.default_rng(seed)
        p = Passages(pa.array(texts, pa.string()))
        bag = positive[p.text]
        weights, bias = _odds(p, positive), 0.0
        evident = p.scores(weights, bias) * p.norm() / p.length() / (1 + 3 * GAP)  # mean odds of its subsequences
        enough = SPLIT * _split(evident[_leaders(p.text, bag, p.scores(weights, bias))])
        for step in range(rounds):
            score = p.scores(weights, bias)
            lead = _leaders(p.text, bag, score)
            clean = ~bag
            # raters err: texts whose label nothing in them bears out are left aside
            lead &= (evident > enough) | (score > (0.3 if step else np.inf))
            if step:
                clean &= np.isin(p.text, np.unique(p.text[~bag & (score > 0.7)]), invert=True)
            pos, neg = np.flatnonzero(lead), np.flatnonzero(clean)
            if not len(pos) or not len(neg):
                break
            hard = neg[np.argsort(-score[neg], kind="stable")[:HARD]]
            neg = np.union1d(hard, rng.choice(neg, min(len(neg), HARD), replace=False))
            odd = pos[np.argsort(score[pos], kind="stable")[: landmarks // 4]]  # leaders that are not yet explained
            marks = np.r_[np.union1d(odd, rng.permutation(pos)[: landmarks // 4]), rng.permutation(hard)[: landmarks // 4], rng.permutation(neg)[: landmarks // 4]]
            held = Landmarks(p, marks)
            which = np.r_[pos, neg]
            val, vec = np.linalg.eigh(held.kernel(p, marks).astype(np.float64))
            keep = val > 1e-5 * val[-1]
            to = vec[:, keep] / np.sqrt(val[keep])
            x, y = held.kernel(p, which) @ to, np.where(np.arange(len(which)) < len(pos), 1.0, -1.0)
            cost = np.where(y > 0, COST * max(1.0, len(neg) / len(pos) / 4), COST)
            w, bias = squared_hinge(x, y, cost)
            weights = held.fold(to @ w)
        worst = p.worst(weights, bias, len(texts))
        return cls(weights, bias, *_gap(worst))


def _odds(p: Passages, positive: np.ndarray) -> np.ndarray:
    """First guess: log odds of the unbroken subsequences by the texts that hold them."""
    first = p.features[0][0]
    if not len(p.start):
        return np.zeros(1 << BITS, np.float32)
    text_at = p.text[np.clip(np.searchsorted(p.start, np.arange(len(first)), "right") - 1, 0, None)]
    pairs = np.sort(text_at.astype(np.int64) << BITS | first)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    held = [np.bincount(mine & ((1 << BITS) - 1), minlength=1 << BITS) for mine in (pairs[positive[pairs >> BITS] == label] for label in (False, True))]
    ratio = positive.sum() / max(1, (~positive).sum())
    return np.log((held[1] + 1) / (ratio * held[0] + 1)).astype(np.float32)


def _leaders(text: np.ndarray, is_bag: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The highest passage of each positive text."""
    best = np.full(text.max(initial=-1) + 1, -np.inf)
    np.maximum.at(best, text[is_bag], score[is_bag])
    return is_bag & (score >= best[text])


def _split(x: np.ndarray) -> float:
    """Where two groups of numbers part (largest variance between them)."""
    x = np.sort(x)
    if len(x) < 4:
        return -np.inf
    n = np.arange(1, len(x))
    left = np.cumsum(x)[:-1]
    between = n * (len(x) - n) * (left / n - (x.sum() - left) / (len(x) - n)) ** 2
    k = int(np.argmax(between))
    return float((x[k] + x[k + 1]) / 2)


def _gap(score: np.ndarray) -> tuple[float, float]:
    """The widest gap between the documents' scores around the machine's own boundary. (Labels are not
    asked: raters err in both directions, and the few documents near the boundary would follow their errors.)"""
    near = np.sort(np.r_[-0.5, score[(score > -0.5) & (score < 0.9)], 0.9])
    k = int(np.argmax(np.diff(near)))
    return float(near[k]), float(near[k + 1])


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, positive of the bounded sample of labelled documents."""
    votes = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("label").isin(*POSITIVE)).alias("p"), F.count("*").alias("n"))
    votes = votes.select("doc_id", (F.col("p") * 2 >= F.col("n")).alias("positive"))
    taken = [votes.where(F.col("positive") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for flag in (True, False)]
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").select("text", "positive")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    rows = labelled(documents, labels, sample).toArrow()
    order = np.argsort(np.array(rows["text"].to_pylist(), object)) if rows.num_rows else np.empty(0, np.int64)
    rows = rows.take(pa.array(order))
    return Machine.train(rows["text"].to_pylist(), np.array(rows["positive"].to_pylist(), bool))


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = machine.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                score = Passages(part.column(1)).worst(m.weights, m.bias, part.num_rows) if m.weights.any() else np.full(part.num_rows, NOTHING)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score_documents(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every document (doc_id BIGINT, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)
    return documents.select("doc_id", "text").mapInArrow(_score(sent), "doc_id long, score double")
