import random

import pytest

from graftwork.llm import tokenize
from graftwork.llm.tokenize import _encoding, decode, encode_corpus, public_path, public_pattern

pytest.importorskip("public_tokenizers")
TEXTS = ["Hello world", "", None, "  two   spaces\n\n and\ttabs ", "<|endoftext|> is text", "naïve é vs é 😀👍🏽", "日本語 текст ١٢٣", "don't WE'LL 'll", "a\r\nb\x1cc\u0085d　e", " " * 50, "x" * 30_000, "end "]


def test_ids_equal_whole_text_encoding(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "BLOCK_CHARS", 20)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab 'é1\n😀.<|") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text", public_path(), public_pattern()).collect()}
    whole = _encoding(public_path(), public_pattern())
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode(encode_corpus(df, "doc_id", "text", public_path(), public_pattern()), public_path()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert encode_corpus(df, "doc_id", "text", public_path(), public_pattern()).count() == 2
    assert encode_corpus(df.where("false"), "doc_id", "text", public_path(), public_pattern()).count() == 0
