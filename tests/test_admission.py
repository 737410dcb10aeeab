import random
import sys
from pathlib import Path

import pytest

from graftwork.operators import acyclic
from graftwork.operators.admit_edges import accepted_edges, admit_edges
from graftwork.operators.admit_nodes import accepted_nodes, admit_nodes, decisions

sys.path.insert(0, str(Path(__file__).parent))
import model  # noqa: E402

NODE = "batch_id long, pos long, kind string, granularity string, level int, text string, tags array<string>"
EDGE = "batch_id long, pos long, relation string, from_id string, to_id string, rationale string"
IDS = [f"00000000-0000-4000-8000-{i:012d}" for i in range(12)]


def node_reasons(spark, rows, store=None):
    df = spark.createDataFrame([(*r, None) for r in rows], NODE)
    known = spark.createDataFrame(list((store or {}).items()), "norm_text string, batch_id long")
    return {(r.batch_id, r.pos): r.reason for r in admit_nodes(df, known).collect()}


def test_node_cases(spark):
    c, s = "Concept", "Sentence"
    rows = [
        (0, 0, c, s, 0, "Loops repeat work."),
        (0, 1, c, s, 0, "  loops repeat WORK. "),
        (0, 2, "LearningOutcome", s, 2, "Loops matter."),
        (0, 3, "LearningOutcome", s, 2, "i CAN use loops."),
        (0, 4, c, "Paragraph", 9, ""),
        (0, 5, c, s, 4, "A late claim."),
        (0, 6, c, s, 1, "A late claim."),
        (0, 7, c, s, 0, None),
        (1, 0, c, s, 0, "Loops repeat work."),
        (1, 1, c, s, 0, "Loops repeat work."),
        (1, 2, c, s, 0, "Known before."),
        (1, 3, c, s, 0, "Known before."),
    ]
    got = node_reasons(spark, rows, {"known before.": 0})
    assert got == model.nodes(rows, {"known before.": 0})
    assert got[0, 6] is None
    assert got[0, 4] == "granularity must be sentence"


def test_nodes_against_model(spark):
    rng = random.Random(3)
    texts = ["A b.", "a  B.", "I can do.", "Students can x!", "No end", "Two. Stops.", "", " 　", "Other?", "C d."]
    rows = [(b, p, rng.choice(["Concept", "LearningOutcome"]), rng.choice(["Sentence"] * 5 + ["Paragraph"]), rng.choice([0, 1, 2, 3, 3, 4, 255]), rng.choice(texts)) for b in range(30) for p in range(12)]
    assert node_reasons(spark, rows, {"other?": 9, "c d.": 40}) == model.nodes(rows, {"other?": 9, "c d.": 40})


def test_node_rows_keep_case_and_order(spark):
    df = spark.createDataFrame([(2, 7, "concept", "sentence", 1, " Mixed  Case. ", [" Stub"])], NODE)
    row = accepted_nodes(admit_nodes(df)).first()
    assert (row.kind, row.text, row.norm_text, row.tags, row.seq) == ("Concept", "Mixed Case.", "mixed case.", ["stub"], (2 << 32) + 7)
    again = decisions(admit_nodes(df)).first()
    assert again.assigned_id == row.id


def test_redelivered_and_empty(spark):
    df = spark.createDataFrame([(5, 0, 0, "Concept", "Sentence", 0, "X.", None)] * 2, "proposal_id long, " + NODE)
    assert admit_nodes(df).count() == 1
    assert admit_nodes(df.where("false")).count() == 0


def edge_reasons(spark, rows, nodes, stored=()):
    df = spark.createDataFrame(rows, EDGE)
    known = spark.createDataFrame([(i, k, lv, 0) for i, (k, lv) in nodes.items()], "id string, kind string, level int, batch_id long")
    edges = spark.createDataFrame(list(stored), "from_id string, to_id string, relation string")
    return {(r.batch_id, r.pos): r.reason for r in admit_edges(df, known, edges).collect()}


def test_edge_cases(spark):
    a, b, c, o = IDS[:4]
    nodes = {a: ("Concept", 0), b: ("Concept", 0), c: ("Concept", 0), o: ("LearningOutcome", 0)}
    p, s = "PrerequisiteFor", "Supports"
    rows = [
        (0, 0, p, a, b, "x"), (0, 1, p, b, c, "x"), (0, 2, p, c, a, "x"), (0, 3, p, b, a, " "),
        (0, 4, s, a, b, "x"), (0, 5, s, b, a, "x"), (0, 6, s, a, a, "x"), (0, 7, s, b, c, " "), (0, 8, s, b, c, "late"),
        (0, 9, p, c, o, "x"), (0, 10, p, o, a, "x"), (0, 11, p, o, IDS[9], "x"),
        (1, 0, p, a, b, "x"), (1, 1, p, c, a, "x"), (1, 2, s, b, c, "now"),
    ]
    got = edge_reasons(spark, rows, nodes)
    assert got == model.edges(rows, nodes, set())
    assert got[0, 2] == got[0, 3] == got[0, 10] == "edge would introduce a prerequisite cycle"


@pytest.mark.parametrize(("seed", "walk"), [(1, 50_000), (2, 0)])
def test_edges_against_model(spark, monkeypatch, seed, walk):
    monkeypatch.setattr(acyclic, "ONE_TASK", walk)
    rng = random.Random(seed)
    nodes = {i: (rng.choice(["Concept"] * 4 + ["LearningOutcome"]), rng.choice([0, 0, 1])) for i in IDS[:10]}
    rows = [(b, p, rng.choice(["PrerequisiteFor"] * 3 + ["Supports"]), rng.choice(IDS[:11]), rng.choice(IDS[:10]), rng.choice(["why", "because", " "])) for b in range(3) for p in range(60)]
    stored = {(x, y, "PrerequisiteFor") for x, y in zip(IDS[:3], IDS[1:4], strict=True)} | {(IDS[5], IDS[1], "Supports")}
    assert edge_reasons(spark, rows, nodes, stored) == model.edges(rows, nodes, stored)


def test_edge_spellings_and_nulls(spark):
    a, b = IDS[:2]
    nodes = {a: ("Concept", 0), b: ("Concept", 1)}
    rows = [(0, 0, "prerequisite_for", "{" + a.upper() + "}", b, " why "), (0, 1, "PREREQUISITE FOR", a, b, "x"), (0, 2, "supports", None, b, "x"), (0, 3, "odd", a, b, "x"), (0, 4, "Supports", a, b, None)]
    got = edge_reasons(spark, rows, nodes)
    assert [got[0, i] for i in range(5)] == [None, "duplicate edge within batch", "unknown from_id ", "edge relation is unknown", "edge rationale missing"]
    known = spark.createDataFrame([(i, k, lv, 0) for i, (k, lv) in nodes.items()], "id string, kind string, level int, batch_id long")
    none = spark.createDataFrame([], "from_id string, to_id string, relation string")
    kept = accepted_edges(admit_edges(spark.createDataFrame(rows, EDGE), known, none)).first()
    assert (kept.from_id, kept.relation, kept.rationale) == (a, "PrerequisiteFor", "why")
