import pytest
from pyspark.sql import functions as F

from graftwork.functions import text as fx
from graftwork.functions.ids import canonical_id, pack_id, unpack_id

WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space_is_unicode(spark):
    assert values(spark, [f"{chr(c)}a{chr(c)}{chr(c)}B{chr(c)}" for c in WHITE], fx.clean) == ["a B"] * len(WHITE)
    assert values(spark, ["a​b", "a\x1cb", None, ""], fx.clean) == ["a​b", "a\x1cb", None, ""]
    assert values(spark, ["　 A b \n"], fx.normalize) == ["a b"]
    assert values(spark, [" a  b "], fx.trim_all) == ["a  b"]


@pytest.mark.parametrize(("text", "single"), [(".", True), ("One thing.", True), ("Really?", True), ("Wait?!", False), ("e.g. this.", False), ("No end", False), ("v1.2 ships.", False), ("", False)])
def test_single_sentence(spark, text, single):
    assert values(spark, [text], fx.is_single_sentence) == [single]


def test_shorten_counts_code_points(spark):
    cases = ["x" * 79, "x" * 80, "x" * 81, "😀" * 81, f"  {'y' * 80}  "]
    assert values(spark, cases, fx.shorten) == [cases[0], cases[1], "x" * 80 + "...", "😀" * 80 + "...", "y" * 80]


def test_tags(spark):
    rows = [[" Tests ", "TESTS", "zzz", ""], ["zzz"], [], None, ["stub", "purpose", "contract", "tests"], [None, "stub"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = [r.t for r in df.select("i", fx.sanitize_tags(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [["tests"], None, None, None, ["stub", "purpose", "contract"], ["stub"]]


def test_sql_functions(spark):
    fx.register_functions(spark)
    row = spark.sql("SELECT clean_text(' a  b ') a, normalize_text(' A ') b, trim_text('　x ') c, is_single_sentence('Hi.') d, shorten_text(repeat('x', 81)) e, sanitize_tags(array(' Stub', 'no')) f, sanitize_tags(array('no')) g").first()
    assert tuple(row) == ("a b", "a", "x", True, "x" * 80 + "...", ["stub"], None)


def test_ids(spark):
    good = "0c04a1d5-910c-4d27-98a9-cee13b09fff7"
    same = [good, good.upper(), good.replace("-", ""), "{" + good + "}", f"\t{good} \n", f"urn:uuid:{good}", f"URN:UUID:{good.upper()}"]
    assert values(spark, same, canonical_id) == [good] * len(same)
    odd = ["LO-3178", "", None, good[:-1], "x" * 16]
    assert values(spark, odd, canonical_id) == odd
    assert values(spark, same + odd, lambda c: unpack_id(pack_id(c))) == [good] * len(same) + odd
