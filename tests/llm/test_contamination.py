import random

import pytest

from graftwork.llm.contamination import leaks


def fixture(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=14)
    items = [(i, rng.choices(vocabulary, k=rng.choice([4, 9, 10, 11, 30, 60]))) for i in range(30)]
    items += [(40, passage + rng.choices(vocabulary, k=5)), (41, rng.choices(vocabulary, k=5) + passage), (42, ["la"] * 25)]
    docs = []
    for d in range(150):
        w = rng.choices(vocabulary, k=rng.randrange(0, 80))
        _, item = rng.choice(items)
        n = rng.choice([8, 9, 10, 10, 11, 20])
        s = rng.randrange(max(1, len(item) - n + 1))
        at = rng.randrange(len(w) + 1)
        docs.append((d, w[:at] + item[s : s + n] + w[at:]))
    docs.append((900, ["la"] * 40))
    documents = spark.createDataFrame([(d, ", ".join(w).upper(), 1) for d, w in docs] + [(901, None, 1), (902, "", 1), (903, "x " * 100_000, 1)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame([(i, "  ".join(w), "y") for i, w in items] + [(50, None, "y"), (51, "", "y")], "item_id long, text string, doc_id string")
    runs = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    want = {(d, i) for d, w in docs for i, v in items if runs(w) & runs(v)}
    return documents, table, want


@pytest.mark.parametrize("held", [2_000_000, 250])
def test_leaks_against_brute_force(spark, held):
    documents, items, want = fixture(spark)
    assert len(want) > 50
    assert {tuple(r) for r in leaks(documents.union(documents), items, held=held).collect()} == want


def test_no_rows(spark):
    documents, items, _ = fixture(spark)
    assert leaks(documents.where("false"), items).count() == 0
    assert leaks(documents, items.where("false")).count() == 0
    assert leaks(documents, items.where("item_id = 50")).count() == 0
