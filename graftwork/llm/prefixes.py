"""Exact candidates for pairs of alike sets of words: the first words of every set in one order, and runs of them as keys.

Put the words of every set in one order that is the same for all sets. Two sets of a and b words with
similarity t share at least ceil(t * max(a, b)) words, so the i-th word that they share stands among the first
a - ceil(t * a) + i words of one and the first b - ceil(t * b) + i of the other. Both sets therefore have one key
in common: the first words they share, as many as a key takes. A key takes further words until no more than ``few``
texts are expected to hold all of them, at most ``deep``; that depends on the words of the key alone, so the two sets always
agree. No alike pair is missed, whatever the order and the frequencies are: they set only how many other pairs meet.
"""

from __future__ import annotations

import numpy as np

from graftwork.llm.words import mix

#: Sets of more words have keys of one word (longer keys would be too many); sets that a longer one can be alike to have both kinds.
LONG = 48


def words_needed(size: np.ndarray, least: float) -> np.ndarray:
    """How many words a set of so many words shares at least with any set alike to it."""
    return -(-size * round(least * 1000) // 1000)


def ordered(text: np.ndarray, code: np.ndarray, value: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) pairs with each text's words by ``value``, ties by hash."""
    place = np.empty(len(hash_), np.int64)
    place[np.lexsort((hash_, value))] = np.arange(len(hash_))
    order = np.lexsort((place[code], text))
    return text[order], code[order]


def prefix_keys(text: np.ndarray, code: np.ndarray, hash_: np.ndarray, share: np.ndarray, texts: int, least: float, min_words: int, deep: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, key, place of the key's first word.

    (text, code) pairs come by text, each text's words in the order, each text with at least ``min_words``. By code: hash_, and the share of all
    ``texts`` that hold the word (0: no other text does, so it makes no key)."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    at = np.arange(len(text)) - np.repeat(first, size)
    spare = np.repeat(size - words_needed(size, least), size)  # words that may stand before the first shared one
    size = np.repeat(size, size)
    start = (share[code] > 0) & (at <= spare)
    deep = max(1, min(deep, int(words_needed(np.array([min_words]), least)[0])))
    found = []
    for long, fit in ((0, size <= LONG), (1, size >= words_needed(np.array([LONG + 1]), least)[0])):
        origin = np.flatnonzero(start & fit)
        last, key, expected = origin, mix(hash_[code[origin]] + np.uint64(long)), share[code[origin]] * texts
        for step in range(1, deep + 1):
            done = (expected <= few) | (step == deep) | bool(long)
            found.append((text[origin[done]], key[done], at[origin[done]]))
            origin, last, key, expected = origin[~done], last[~done], key[~done], expected[~done]
            if not len(origin):
                break
            n = np.maximum(np.minimum(spare[last] + step, size[last] - 1) - at[last], 0)
            of = np.repeat(np.arange(len(last)), n)
            last = last[of] + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            origin, expected = origin[of], expected[of] * share[code[last]]
            with np.errstate(over="ignore"):
                key = mix(key[of] * np.uint64(0x9E3779B97F4A7C15) ^ hash_[code[last]])
            alone = expected <= 0  # a word that nobody else holds can't be shared
            origin, last, key, expected = origin[~alone], last[~alone], key[~alone], expected[~alone]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
