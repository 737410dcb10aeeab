import random

import numpy as np
import pytest
import regex

from graftwork.llm.near_duplicates import BagMinHash, candidate_classes, least_words, most_words, near_duplicates, size_code
from graftwork.llm.segment_index import SegmentIndex, repeats_of_history
from graftwork.llm.words import Words, hashes, odd_sketch

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(t):
    return WORD.findall((t or "").lower())


def alike(a, b, least):
    x, y = set(words(a)), set(words(b))
    return min(len(x), len(y)) >= 8 and len(x & y) * 1000 >= len(x | y) * round(least * 1000)


def letters(t):
    return "".join(words(t))


def corpus(seed, n=150):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    pool = [f"word{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = rng.sample(pool, rng.randrange(8, 18)) + rng.sample(common, 6)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            edited = list(base)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[], [edited[k], "also"], [edited[k] + "x"]])
            if rng.random() < 0.3:
                edited = edited[5:] + edited[:5]
            texts.append("  ".join(edited).title() + rng.choice(["", ".", " !"]))
    texts += [texts[0]] * 40 + [None, "", " ", "...", "short text", "long " + " ".join(f"w{i}" for i in range(5_000))]
    return texts


@pytest.mark.parametrize("least", [0.8, 0.7])
def test_pairs_against_brute_force(spark, least):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "k long, text string, class string, id long")
    got = {(r.id_a, r.id_b) for r in near_duplicates(df.union(df.where("k % 3 = 0")), "k", "text", least).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j in range(i) if alike(a, texts[j], least) and letters(a) != letters(texts[j])}
    want = {(j, i) for i, j in want}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, text string")
    assert near_duplicates(none, "k", "text").count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None), (2, "")], "k long, text string"), "k", "text").count() == 0


def test_collisions_follow_weighted_jaccard():
    h = hashes([f"w{i}" for i in range(40)])
    level = np.arange(40) % 5
    table = BagMinHash(4_000).arrivals(h, level)
    a, b = np.arange(0, 28), np.arange(10, 40)
    sig = [table[x].min(axis=0) for x in (a, b)]
    weight = 2.0**level
    true = weight[np.intersect1d(a, b)].sum() / weight[np.union1d(a, b)].sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_weight_only_adds_points():
    h = hashes(["w"])
    low, high = (BagMinHash(500).arrivals(h, np.array([k])) for k in (2, 4))
    assert (high <= low).all()
    assert abs((high == low).mean() - 4 / 16) < 0.07


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    h = hashes([f"w{i}" for i in range(200)])
    for _ in range(50):
        a, b = (rng.choice(200, 20, replace=False) for _ in range(2))
        s = odd_sketch(h[np.r_[a, b]], np.repeat([0, 1], 20), 2, 31)
        assert int(s[0] ^ s[1]).bit_count() <= len(set(a) ^ set(b))


def test_words_of_a_batch():
    import pyarrow as pa

    w = Words(pa.array(["Ab c1-AB", None, "", "x​y", "...z"]))
    got = [[w.distinct[k] for k in w.code[a:b]] for a, b in zip(w.start, w.start[1:], strict=False)]
    assert got == [["ab", "c1", "ab"], [], [], ["x", "y"], ["z"]]
    assert w.letters_hash()[3] == Words(pa.array(["xy"])).letters_hash()[0]
    assert w.words_hash()[3] != Words(pa.array(["xy"])).words_hash()[0]


def history(spark):
    old = corpus(2, 120)
    rng = random.Random(3)
    new = []
    for t in rng.sample([x for x in old if x and len(x) > 20], 60):
        w = t.split()
        w[rng.randrange(len(w))] += "q"
        new += [t.upper().replace(" ", ", "), " ".join(w), " ".join(w[4:] + w[:4])]
    new += [None, "", "short text", "SHORT, text!", "nothing like it at all in any of the texts before"]
    return old, new


def test_history_against_brute_force(spark):
    old, new = history(spark)
    h = spark.createDataFrame([(f"n{i}", t, i % 7) for i, t in enumerate(old)], "old_id string, text string, batch long")
    p = spark.createDataFrame([(i, t, 3 if i % 5 else None) for i, t in enumerate(new)], "new_id long, text string, batch long")
    got = {tuple(r) for r in repeats_of_history(p.union(p), h, 0.7).collect()}
    same = lambda a, b: (letters(a) == letters(b) != "") or alike(a, b, 0.7)
    want = {(i, f"n{j}") for i, a in enumerate(new) if i % 5 for j, b in enumerate(old) if j % 7 < 3 and same(a, b)}
    assert got <= want
    assert len(got) >= 0.99 * len(want)
    assert repeats_of_history(p.where("false"), h).count() == 0
    assert repeats_of_history(p, h.where("false")).count() == 0


def test_index_grows_by_batches(spark, tmp_path):
    old, new = history(spark)
    h = spark.createDataFrame([(f"n{i}", t, 0) for i, t in enumerate(old)], "old_id string, text string, batch long")
    p = spark.createDataFrame([(i, t, 1) for i, t in enumerate(new)], "new_id long, text string, batch long")
    assert SegmentIndex(spark, str(tmp_path / "index"), 0.7).probe(p).count() == 0
    for k in range(10):  # each in a session of its own; ten appends also merge runs
        index = SegmentIndex(spark, str(tmp_path / "index"), 0.7, bucket_rows=500)
        index.append(h.where(f"pmod(hash(old_id), 10) = {k}"))
    assert len(index.segments.state["runs"]) < 8
    index.segments.vacuum()
    got = {tuple(r) for r in SegmentIndex(spark, str(tmp_path / "index"), 0.7).probe(p).collect()}
    want = {tuple(r) for r in repeats_of_history(p, h, 0.7).collect()}
    assert got == want and len(want) > 100
    assert index.probe(p.where("false")).count() == 0


def test_a_probe_reads_no_more_of_a_longer_history(spark, tmp_path):
    rng = random.Random(8)
    pool = [f"ordinary{i}" for i in range(2_000)]
    texts = [" ".join(rng.sample(pool, 12)) for _ in range(8_000)]
    p = spark.createDataFrame([(1, texts[5], 1)], "new_id long, text string, batch long")
    read = []
    for n in (1_000, 8_000):
        index = SegmentIndex(spark, str(tmp_path / str(n)), 0.7, bucket_rows=256)
        index.append(spark.createDataFrame([(f"n{i}", t, 0) for i, t in enumerate(texts[:n])], "old_id string, text string, batch long"))
        assert [tuple(r) for r in index.probe(p).collect()] == [(1, "n5")]
        read.append(index.bytes_read.value)
    assert 0 < read[1] < 1.5 * read[0]


def hot_group(seed=5):
    """One text whose exact copies fill a third of the rows, with near-copies in ordinary words; and long texts of common words."""
    rng = random.Random(seed)
    pool = [f"ordinary{i}" for i in range(60)]
    base = [f"hot{i}" for i in range(12)]
    texts = [" ".join(base)] * 150
    for _ in range(60):
        edited = list(base)
        for k in rng.sample(range(12), 2):
            edited[k] = rng.choice(pool)
        texts.append(" ".join(edited))
    texts += [" ".join(rng.sample(pool, rng.randrange(8, 16))) for _ in range(150)]
    long = [f"much{i}" for i in range(70)]
    texts += [" ".join(rng.sample(long, n)) for n in (34, 40, 47, 48, 49, 50, 52, 60, 69, 70) for _ in range(4)]
    return texts


def test_every_pair_beside_a_hot_group(spark):
    texts = hot_group()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {(r.id_a, r.id_b) for r in near_duplicates(df, "k", "text", 0.7).collect()}
    want = {(j, i) for i, a in enumerate(texts) for j in range(i) if letters(a) != letters(texts[j]) and alike(a, texts[j], 0.7)}
    assert len(want) > 9_000
    assert got == want


def test_every_repeat_of_a_skewed_history(spark):
    rng = random.Random(6)
    pool = [f"ordinary{i}" for i in range(400)]

    def variant(base, n):
        edited = list(base)
        for k in rng.sample(range(len(base)), n):
            edited[k] = rng.choice(pool)
        return " ".join(edited)

    bases = [rng.sample(pool, n) for n in (10, 30)]
    old = [variant(b, rng.randrange(0, len(b) // 6 + 1)) for b in bases for _ in range(60)] + [" ".join(rng.sample(pool, rng.randrange(8, 20))) for _ in range(240)]
    new = [variant(b, rng.randrange(0, len(b) // 6 + 1)) for b in bases for _ in range(60)]
    h = spark.createDataFrame([(f"n{i}", t, 0) for i, t in enumerate(old)], "old_id string, text string, batch long")
    p = spark.createDataFrame([(i, t, 1) for i, t in enumerate(new)], "new_id long, text string, batch long")
    got = {tuple(r) for r in repeats_of_history(p, h, 0.7).collect()}
    want = {(i, f"n{j}") for i, a in enumerate(new) for j, b in enumerate(old) if letters(a) == letters(b) or alike(a, b, 0.7)}
    assert len(want) > 2_000
    assert got == want


def test_texts_that_share_no_word_or_one(spark):
    """Bands come from words that several texts hold; a stop word at the end of the order makes none."""
    rng = random.Random(4)
    fresh = lambda i: " ".join(f"x{i}y{rng.randrange(10**9)}z{k}" for k in range(10))
    texts = [fresh(i) for i in range(3_000)] + [fresh(i) + " the" for i in range(3_000, 6_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert candidate_classes(df.select("text"), 0.7, 8).count() == 0


def test_words_in_another_order_are_never_lost(spark):
    rng = random.Random(3)
    base = [f"word{i}" for i in range(9)]
    texts = sorted({" ".join(rng.sample(base, 9)) for _ in range(200)})
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert near_duplicates(df, "k", "text", 0.7).count() == len(texts) * (len(texts) - 1) // 2


def test_sizes_are_rounded_up():
    size = np.r_[np.arange(1, 3_000), 10**6, 10**9]
    most = most_words(size_code(size))
    assert (least_words(size_code(size)) <= size).all()
    assert (most >= size).all() and (most[:63] == size[:63]).all() and (most[:2_000] <= 1.25 * size[:2_000] + 1).all()
