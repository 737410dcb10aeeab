import glob
import json

import pytest

from graftwork.cli import RunConfig, parse_args, run, truth
from graftwork.engine import LearningGraph
from graftwork.plans import views
from graftwork.sources import chat, generators, payloads
from graftwork.streaming.ingest import admit_edge_stream, admit_node_stream, event_line_stream


def test_default_run(spark, tmp_path):
    lines = run(spark, RunConfig(path=str(tmp_path / "g"), export_dot=str(tmp_path / "dot")))
    assert lines[:5] == ["Nodes accepted: 30 / 30 (rejected 0)", "Edges accepted: 31 / 39 (rejected 8)", "Nodes: 30 (concept=25, learning_outcome=5)", "Edges: 31 (prerequisite_for=16, supports=15)", "Prerequisite DAG: OK"]
    assert sum("(3 supports)" in x for x in lines) == 5
    dot = open(glob.glob(str(tmp_path / "dot" / "part*"))[0]).read()
    assert dot.startswith("digraph learning_graph {\n") and dot.rstrip().endswith("}")
    assert dot.count("prerequisite_for: ") == 16 and dot.count("supports: ") == 15
    graph = LearningGraph(spark, str(tmp_path / "g"))
    kinds = {r.event_type: r["count"] for r in graph.events().groupBy("event_type").count().collect()}
    assert kinds == {"NodeAccepted": 30, "EdgeAccepted": 31, "EdgeRejected": 8, "SummaryLine": 5}
    assert {r.reason for r in graph.events().where("event_type = 'EdgeRejected'").collect()} == {"prerequisite edges must not decrease level"}
    assert views.summary_event_lines(graph.events()).where("message LIKE 'LO %(3 supports): I can %'").count() == 5
    levels = {r.level: r["count"] for r in graph.inventory().where("kind = 'Concept'").groupBy("level").count().collect()}
    assert levels == {0: 7, 1: 6, 2: 6, 3: 6}


def test_empty_graph(spark, tmp_path):
    row = LearningGraph(spark, str(tmp_path)).summarize().first()
    assert (row.total_nodes, row.total_edges, row.prereq_dag_ok, row.top_learning_outcomes) == (0, 0, True, [])


def test_generators(spark):
    rows = generators.node_proposals(spark, 1_297, 217).orderBy("pos").collect()
    assert len({r.text for r in rows[:1_297]}) == 1_296 and rows[1_296].text == rows[0].text
    assert len({r.text for r in rows[1_297:]}) == 216
    assert [r.tags for r in rows[:2]] == [["design_recipe"], ["contract"]] and len(rows[1_297].tags) == 2
    assert generators.node_proposals(spark, 0, 0).count() == 30
    empty = spark.createDataFrame([], "id string, kind string, text string, seq long")
    assert generators.edge_proposals(empty).count() == 0


def test_payloads(spark):
    node = {"kind": "Concept", "granularity": "Sentence", "level": 1, "text": "A.", "extra": 1}
    cases = [{"nodes": [node, node | {"tags": ["x"]}]}, {"nodes": [node | {"kind": "Odd"}, node]}, {"nodes": [node | {"level": 300}]}, {"nodes": [{k: v for k, v in node.items() if k != "text"}]}, {"nodes": []}]
    texts = [json.dumps(c) for c in cases] + [json.dumps(cases[0])[:-5], "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = payloads.node_payloads(df, "payload").collect()
    assert [(r.i, r.pos, r.tags) for r in sorted(got)] == [(0, 0, None), (0, 1, ["x"])]
    edge = {"relation": "Supports", "from_id": "a", "to_id": "b", "rationale": "c"}
    df = spark.createDataFrame([(json.dumps({"edges": [edge]}),), (json.dumps({"edges": [edge | {"to_id": None}]}),)], "payload string")
    assert payloads.edge_payloads(df, "payload").count() == 1


def test_chat_falls_back(spark):
    assert chat.available(False, {}) is None and chat.available(True, {}) is None
    config = chat.available(True, {"OPENAI_API_KEY": "k"})
    assert (config.model, config.temperature) == ("gpt-4o-mini", 0.2)
    answer = json.dumps({"nodes": [{"kind": "Concept", "granularity": "Sentence", "level": 0, "text": "Chat says so."}]})
    assert chat.node_source(spark, 3, 1, lambda *_: answer, config).count() == 1
    for bad in ("nonsense", json.dumps({"nodes": []})):
        assert chat.node_source(spark, 3, 1, lambda *_, a=bad: a, config).count() == 4

    def fails(*_):
        raise OSError("no service")

    assert chat.node_source(spark, 3, 1, fails, config).count() == 4


def test_streams_equal_batches(spark, tmp_path):
    nodes = generators.node_proposals(spark, 40, 4).selectExpr("pos AS proposal_id", "CAST(0 AS BIGINT) AS batch_id", "pos", "kind", "granularity", "level", "text", "tags")
    one, two = LearningGraph(spark, str(tmp_path / "one")), LearningGraph(spark, str(tmp_path / "two"))
    for k in range(2):
        part = nodes.where(f"pos % 2 = {k}").union(nodes.where(f"pos = {k + 4}")).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        one.add_nodes(spark.read.schema(part.schema).parquet(str(tmp_path / "in")).where(f"pos % 2 = {k} OR pos = {k + 4}").dropDuplicates(["pos"]))
    assert admit_node_stream(two, str(tmp_path / "in"), str(tmp_path / "c1")).awaitTermination(120)
    ids = lambda g: {r.id for r in g.inventory().collect()}
    assert ids(one) == ids(two) and len(ids(one)) == 44
    edges = generators.edge_proposals(two.inventory(), 20).selectExpr("pos AS proposal_id", "CAST(0 AS BIGINT) AS batch_id", "pos", "relation", "from_id", "to_id", "rationale")
    edges.coalesce(1).write.parquet(str(tmp_path / "edges"))
    assert admit_edge_stream(two, str(tmp_path / "edges"), str(tmp_path / "c2"), 100).awaitTermination(120)
    assert two.summarize().first().total_edges > 0
    assert event_line_stream(spark, str(tmp_path / "two" / "events"), str(tmp_path / "lines"), str(tmp_path / "c3")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "lines")).count() == two.events().count()


def test_retried_batch_replaces_itself(spark, tmp_path):
    graph = LearningGraph(spark, str(tmp_path))
    for _ in range(2):
        assert views.decision_counts(graph.add_nodes(generators.node_proposals(spark, 3, 0).where("kind = 'Concept'"), 0)).first().n_accepted == 3
    assert graph.inventory().count() == 3


def test_command_line():
    got = parse_args(["run", "--concepts", "3", "--los", "2", "--use-llm", "YES", "--export-dot", "x"])
    assert (got.concepts, got.outcomes, got.use_chat, got.export_dot, got.edges) == (3, 2, True, "x", 40)
    assert truth("No") is False
    for bad in (["run", "--concepts", "x"], ["run", "--use-llm", "maybe"], ["walk"], []):
        with pytest.raises(SystemExit) as e:
            parse_args(bad)
        assert e.value.code == 1


def test_display_and_log_follow_each_batch(spark, tmp_path, caplog):
    drawn = []
    graph = LearningGraph(spark, str(tmp_path), redraw=lambda *frames: drawn.append([[tuple(r) for r in f.collect()] for f in frames]))
    with caplog.at_level("INFO", logger="graftwork.engine"):
        graph.add_nodes(generators.node_proposals(spark))
        graph.add_nodes(generators.node_proposals(spark))  # all are there already: nothing to redraw
        graph.add_edges(generators.edge_proposals(graph.inventory()))
    assert [[len(f) for f in d] for d in drawn] == [[30, 0, 0], [30, 16, 15]]
    assert [(r[1], r[2]) for r in drawn[0][0]] == sorted((r[1], r[2]) for r in drawn[0][0])
    assert all(f == sorted(f) for f in drawn[1][1:])
    said = [r.getMessage() for r in caplog.records]
    assert said == ["batch 0: accepted 30 nodes, rejected 0", "batch 1: accepted 0 nodes, rejected 30", "batch 1: rejected 30 nodes: duplicate node already present", "batch 2: accepted 31 edges, rejected 8", "batch 2: rejected 8 edges: prerequisite edges must not decrease level"]


def test_a_prompt_shows_every_node(spark):
    rows = spark.range(700).selectExpr("CAST(id AS STRING) id", "'Concept' kind", "0 level", "concat('Text ', id, '.') text", "id seq")
    shown = json.loads(chat.inventory_prompt(rows).first().inventory)
    assert [x["id"] for x in shown] == [str(i) for i in range(700)]
