import random

import numpy as np
import pytest

from graftwork import runs
from graftwork.runs import Bucket, Catalogue, Runs, bits_for


def found(places, bits, keys):
    """Values of the asked keys, through the buckets."""
    keys = np.sort(np.array(keys, np.int64))
    number = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    out = []
    for n in np.unique(number):
        own, bucket = keys[number == n], Bucket(places, int(n), bits)
        for rows, mine, theirs in bucket.lookup(own):
            out += zip(own[mine].tolist(), rows["value"].to_numpy()[theirs].tolist(), strict=True)
        bucket.close()
    return sorted(out)


@pytest.mark.parametrize("limits", [(1 << 21, 1 << 20), (3, 0)])
def test_runs_give_back_what_was_added(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(runs, "PAIRS", limits[0])
    monkeypatch.setattr(runs, "HELD_ROWS", limits[1])
    rng = random.Random(1)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [7] * 50
    rows = [(rng.choice(keys), i) for i in range(1_000)]
    for k in range(10):
        mine = rows[100 * k : 100 * k + 100]
        Runs(spark, str(tmp_path), "key long, value long", bucket_rows=40).append(spark.createDataFrame(mine, "key long, value long"), len(mine))
    store = Runs(spark, str(tmp_path), "key long, value long", bucket_rows=40)
    assert sum(r["rows"] for r in store.state["runs"]) == 1_000 and len(store.state["runs"]) < 10
    asked = [*set(keys[::3]), 7, 12345]
    want = sorted((k, v) for k, v in rows if k in asked)
    assert found(store.places(), store.bits, list(dict.fromkeys(asked))) == want
    store.vacuum()
    assert found(Runs(spark, str(tmp_path), "key long, value long").places(), store.bits, list(dict.fromkeys(asked))) == want


def test_an_empty_run(spark, tmp_path):
    store = Runs(spark, str(tmp_path), "key long, value long")
    store.append(spark.createDataFrame([], "key long, value long"), 0)
    assert found(store.places(), store.bits, [1, 2]) == []


def test_buckets_follow_the_rows():
    assert [bits_for(n, 100) for n in (0, 1, 100, 101, 200, 201, 10_000)] == [0, 0, 0, 1, 1, 2, 7]


def test_catalogue_keeps_the_newest(spark, tmp_path):
    assert Catalogue(spark, str(tmp_path / "none")).load() is None
    first = Catalogue(spark, str(tmp_path))
    for k in range(4):
        first.save({"k": k})
    later = Catalogue(spark, str(tmp_path))
    assert later.load() == {"k": 3}
    later.save({"k": 4})
    with pytest.raises(RuntimeError):
        first.save({"k": 5})
