import json

from pyspark.sql import functions as F

from graftwork.llm.ledger import Ledger, canonical, json_keys, text_key


def keyed(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, key_ string").select("id", text_key(F.col("text")).alias("key"))


def counts(ledger):
    return sorted((r.first_id, r.n_copies) for r in ledger.records().collect())


def test_batches_add_up(spark):
    ledger = Ledger(spark, bucket_rows=2)
    assert counts(ledger) == []
    ledger.add(keyed(spark, [(3, "Hello, world", None), (4, "hello WORLD!", None), (4, "hello WORLD!", None), (5, "other", None), (6, "...", None), (7, None, None), (8, "", None)]))
    assert counts(ledger) == [(3, 2), (5, 1)]
    ledger.add(keyed(spark, [(1, "HELLO world", None), (9, "new one", None)]))
    ledger.add(keyed(spark, []))
    ledger.add(keyed(spark, [(10 + i, "he llo world ", None) for i in range(1_000)]))
    assert counts(ledger) == [(1, 1_003), (5, 1), (9, 1)]


def test_long_texts(spark):
    ledger = Ledger(spark)
    long = "word " * 200_000
    ledger.add(keyed(spark, [(1, long, None), (2, long.upper().replace(" ", "-"), None)]))
    assert counts(ledger) == [(1, 2)]


def test_json_keys(spark):
    a = {"kind": "Concept", "level": 1, "text": "Some text.", "tags": ["stub", "tests"]}
    same = [json.dumps(a), json.dumps(dict(reversed(a.items())), indent=2), json.dumps(a | {"level": "1", "kind": "CONCEPT", "text": "some  text"}), json.dumps(a | {"tags": ["Tests", " stub"]}), json.dumps(a).replace("S", "\\u0053")]
    other = [json.dumps(a | {"tags": None}), json.dumps(a | {"tags": []}), json.dumps({k: v for k, v in a.items() if k != "tags"}), json.dumps(a | {"level": 2}), json.dumps(a | {"text": None}), json.dumps(a | {"text": ""})]
    none = [json.dumps(a)[:-3], "", None, "[1]", "3", json.dumps(a) + "x", '{"kind": NaN}', '{"level": -Infinity}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(same + other + none)], "payload_id long, body string")
    keys = [r.key for r in json_keys(df, "payload_id", "body").orderBy("id").collect()]
    assert len(set(keys[: len(same)])) == 1 and keys[0] is not None
    assert len({bytes(k) for k in keys[len(same) : len(same) + len(other)]} | {bytes(keys[0])}) == len(other) + 1
    assert keys[len(same) + len(other) :] == [None] * len(none)


def test_canonical_values():
    assert canonical({"b": [2, "A b", None], "a": {"y": True, "x": 1.5}}) == {"a": {"x": "15", "y": True}, "b": ["2", "ab", None]}


def test_rows_without_a_batch_count(spark):
    from graftwork.llm.queries import _waves

    rows = keyed(spark, [(1, "one text", None), (2, "One text!", None), (3, "other", None), (4, "one  text", None)])
    some = rows.withColumn("batch", F.when(F.col("id") == 1, 7).when(F.col("id") == 4, 9))
    for table in (some, some.withColumn("batch", F.lit(None).cast("int"))):
        assert counts(_waves(spark, table)) == [(1, 3), (3, 1)]


def test_a_later_session_goes_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for k in range(4):
        ledger = Ledger(spark, path, bucket_rows=20)
        ledger.add(keyed(spark, [(1_000 * k + i, f"text number {i % (30 * (k + 1))}", None) for i in range(200)]))
    again = Ledger(spark, path, bucket_rows=20)
    want = {}
    for k in range(4):
        for i in range(200):
            first, n = want.get(i % (30 * (k + 1)), (10**9, 0))
            want[i % (30 * (k + 1))] = min(first, 1_000 * k + i), n + 1
    assert counts(again) == sorted(want.values())
    assert again.state["bits"] == 4 and again.state["keys"] == 120
    again.vacuum()
    assert counts(Ledger(spark, path)) == sorted(want.values())


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), bucket_rows=20)
    ledger.add(keyed(spark, [(i, f"text number {i}", None) for i in range(500)]))
    before = dict(ledger.state["at"])
    assert len(before) == 32
    ledger.add(keyed(spark, [(1_000, "text number 7", None)]))
    assert sum(before[b] != v for b, v in ledger.state["at"].items()) == 1
    assert (7, 2) in counts(ledger)
