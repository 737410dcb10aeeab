"""Queries over the learning graph itself: text functions, admission, views, graph operators, generators, payloads."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.functions import text as fx
from graftwork.functions.ids import canonical_id
from graftwork.operators import acyclic
from graftwork.operators.admit_edges import accepted_edges, admit_edges, edge_decisions
from graftwork.operators.admit_nodes import accepted_nodes, admit_nodes, checked_nodes, decisions, sequence_number
from graftwork.plans import views
from graftwork.plans.graph_sql import SQL as SQL
from graftwork.plans.tables import relation_letters, table
from graftwork.rules import DEFAULT as R
from graftwork.scratch import Scratch
from graftwork.sources import generators, payloads

Query = Callable[[SparkSession, str], DataFrame]
#: Proposals of the generator queries: one more than there are distinct sentences.
N_CONCEPTS, N_OUTCOMES = 1_297, 217


def _text(name: str, make: Callable) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "node_proposals")
        return rows.select("proposal_id", "ingested_at", make(F.col("text")).alias(name)).select("proposal_id", name).distinct()

    return query


def _document_text(name: str, make: Callable) -> Query:
    return lambda spark, d: table(spark, d, "documents").select("doc_id", make(F.col("text")).alias(name))


def tags_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_proposals").select("proposal_id", fx.sanitize_tags(F.col("tags")).alias("tags")).distinct()


def tags_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_proposals").select("proposal_id", F.coalesce(F.array_contains(fx.sanitize_tags(F.col("tags")), "tests"), F.lit(False)).alias("has_tests")).distinct()


def _admitted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return admit_nodes(table(spark, d, "node_proposals"), table(spark, d, "nodes").select("norm_text", "batch_id"))


def _admitted_edges(spark: SparkSession, d: str) -> DataFrame:
    return admit_edges(table(spark, d, "edge_proposals"), table(spark, d, "nodes"), table(spark, d, "edges"))


def _refused(admitted: Callable[[SparkSession, str], DataFrame], reason: str, starts: bool = False) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        hit = F.col("reason").startswith(reason) if starts else F.col("reason") == reason
        return admitted(spark, d).where(hit).select("proposal_id", "batch_id", "pos", "reason")

    return query


def node_admission(spark: SparkSession, d: str) -> DataFrame:
    return decisions(_admitted_nodes(spark, d))


def node_accept(spark: SparkSession, d: str) -> DataFrame:
    return accepted_nodes(_admitted_nodes(spark, d))


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id that each distinct normalised text has or would have."""
    rows = checked_nodes(table(spark, d, "node_proposals")).where("static_reason IS NULL")
    return rows.select("norm_text", fx.content_id(F.col("norm_text")).alias("id")).distinct()


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.decision_counts(_admitted_nodes(spark, d))


def events_nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.node_events(_admitted_nodes(spark, d), sequence_number())


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each event's step: its number in the log from 0."""
    return generators.rank_rows(events_nodes(spark, d).select("event_seq", "event_type"), ["event_seq"], "step")


def edge_admission(spark: SparkSession, d: str) -> DataFrame:
    return edge_decisions(_admitted_edges(spark, d))


def edge_accept(spark: SparkSession, d: str) -> DataFrame:
    return accepted_edges(_admitted_edges(spark, d))


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Proposals whose two ends are nodes, with kinds and levels."""
    nodes = table(spark, d, "nodes")
    rows = table(spark, d, "edge_proposals").select("proposal_id", canonical_id(F.col("from_id")).alias("from_id"), canonical_id(F.col("to_id")).alias("to_id")).distinct()
    for side in ("from", "to"):
        rows = rows.join(nodes.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("level").alias(f"{side}_level")), f"{side}_id")
    return rows


def events_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.edge_events(_admitted_edges(spark, d), sequence_number())


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    return views.event_lines(events_nodes(spark, d), events_edges(spark, d))


def _witnesses(admitted: DataFrame, stored: DataFrame) -> DataFrame:
    """seq and a shortest path that each refused prerequisite edge would have closed, its number of edges, and whether all of those were accepted before."""
    before = _prereq(stored).select(F.lit(acyclic.STORED).cast("long").alias("seq"), "from_id", "to_id")
    kept = Scratch(admitted.sparkSession, "witnesses").keep(admitted.select("seq", "from_id", "to_id", "relation", "accepted", "reason"))
    graph = kept.where("accepted AND relation = 'PrerequisiteFor'").select("seq", "from_id", "to_id").unionByName(before)
    refused = kept.where(F.col("reason") == R.cycle).select("seq", "from_id", "to_id")
    found = acyclic.cycle_witness(graph, refused)
    steps = found.select("seq", F.posexplode(F.expr("transform(sequence(1, size(witness) - 1), i -> struct(witness[i - 1] AS from_id, witness[i] AS to_id))")).alias("i", "step"))
    first = graph.groupBy("from_id", "to_id").agg(F.min("seq").alias("added"))
    good = steps.select("seq", "step.*").join(first, ["from_id", "to_id"]).where("added < seq").groupBy("seq").agg(F.count("*").alias("n_good"))
    ends = refused.select("seq", F.col("from_id").alias("tail"), F.col("to_id").alias("head"))
    told = found.join(ends, "seq").join(good, "seq", "left")
    right = (F.col("n_good") == F.size("witness") - 1) & (F.element_at("witness", 1) == F.col("head")) & (F.element_at("witness", -1) == F.col("tail"))
    return told.select("seq", "witness", (F.size("witness") - 1).cast("long").alias("n_edges"), F.coalesce(right, F.lit(False)).alias("is_path"))


def cycle_witness(spark: SparkSession, d: str) -> DataFrame:
    return _witnesses(_admitted_edges(spark, d), table(spark, d, "edges")).select("seq", "n_edges", "is_path")


#: Nodes onto which ``folded`` lays all ids; every sixth is a learning outcome.
FOLDS, OUTCOME_EVERY = 24, 6


def _folded_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All edge proposals with their ids laid onto few nodes (all of level 0), those nodes, and no edges: a dense graph in which cycles are common."""
    fold = lambda c: F.concat(F.lit("n"), F.pmod(F.conv(F.substring(F.md5(F.encode(canonical_id(F.col(c)), "UTF-8")), 1, 4), 16, 10).cast("long"), F.lit(FOLDS)).cast("string"))
    proposals = table(spark, d, "edge_proposals").withColumns({c: fold(c) for c in ("from_id", "to_id")})
    kind = F.when(F.pmod(F.col("k"), F.lit(OUTCOME_EVERY)) == OUTCOME_EVERY - 1, "LearningOutcome").otherwise("Concept")
    nodes = spark.range(FOLDS).withColumnRenamed("id", "k").select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("id"), kind.alias("kind"), F.lit(0).alias("level"), F.lit(-1).cast("long").alias("batch_id"))
    return proposals, nodes, table(spark, d, "edges").where("false")


def _admitted_folded(spark: SparkSession, d: str) -> DataFrame:
    return admit_edges(*_folded_tables(spark, d))


def edge_admission_folded(spark: SparkSession, d: str) -> DataFrame:
    return edge_decisions(_admitted_folded(spark, d)).drop("assigned_id")


def cycle_witness_folded(spark: SparkSession, d: str) -> DataFrame:
    return _witnesses(_admitted_folded(spark, d), table(spark, d, "edges").where("false")).select("seq", "n_edges", "is_path")


def prereq_dag_folded(spark: SparkSession, d: str) -> DataFrame:
    """Whether the folded prerequisite links are acyclic: as proposed (they are not), and as admitted."""
    proposed = _folded_tables(spark, d)[0].where(relation_letters(F.col("relation")) == "prerequisitefor")
    admitted = _prereq(accepted_edges(_admitted_folded(spark, d)))
    return acyclic.is_acyclic(proposed).select(F.lit("proposed").alias("links"), "prereq_dag_ok").unionByName(acyclic.is_acyclic(admitted).select(F.lit("admitted").alias("links"), "prereq_dag_ok"))


def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For the two ends of every two edges that follow each other, and of every edge backwards: whether prerequisites lead from the one to the other."""
    edges = table(spark, d, "edges")
    second = edges.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("far"))
    pairs = edges.select("from_id", "to_id").join(second, "to_id").select("from_id", F.col("far").alias("to_id")).union(edges.select("to_id", "from_id"))
    return acyclic.reaches(_prereq(edges), pairs)


def _graph(view: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: view(table(spark, d, "nodes"), table(spark, d, "edges"))


def _prereq(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'PrerequisiteFor'")


def learning_path(spark: SparkSession, d: str) -> DataFrame:
    """The first ten nodes in topological order (a top-k report)."""
    ranks = acyclic.longest_path_rank(_prereq(table(spark, d, "edges"))).where("rank IS NOT NULL")
    rows = table(spark, d, "nodes").select("id", "seq").join(ranks, "id")
    return rows.orderBy("rank", "seq").limit(10).select("id", "rank", "seq")


def gen_supports(spark: SparkSession, d: str) -> DataFrame:
    return generators.supports_links(table(spark, d, "nodes")).select("step", "from_id", "to_id")


def gen_prereq_chain(spark: SparkSession, d: str) -> DataFrame:
    return generators.chain_links(table(spark, d, "nodes")).select("step", "from_id", "to_id")


def gen_rationale(spark: SparkSession, d: str) -> DataFrame:
    """Every link the generator can propose for the stored nodes, with its rationale."""
    return generators.edge_proposals(table(spark, d, "nodes"), 1 << 40).select("relation", "from_id", "to_id", "rationale")


def gen_edge_cap(spark: SparkSession, d: str) -> DataFrame:
    """A default request: the target caps the links."""
    return generators.edge_proposals(table(spark, d, "nodes"), 0).select("pos", "relation", "from_id", "to_id")


def src_default_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = generators.node_proposals(spark, 0, 0)
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    return payloads.node_objects(table(spark, d, "node_payloads").select("payload_id", "body"), "body")


def json_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge proposals through their JSON payloads, one proposal each."""
    item = F.struct("relation", "from_id", "to_id", "rationale")
    made = table(spark, d, "edge_proposals").select("proposal_id", "relation", "from_id", "to_id", "rationale").distinct().select("proposal_id", F.to_json(F.struct(F.array(item).alias("edges"))).alias("payload"))
    return payloads.edge_payloads(made, "payload").drop("pos")


QUERIES: dict[str, Query] = {
    "text_clean": _document_text("clean_text", fx.clean),
    "text_normalize": _text("norm_text", fx.normalize),
    "text_single_sentence": _text("single", lambda c: fx.is_single_sentence(fx.clean(c))),
    "text_trim": _document_text("trimmed", fx.trim_all),
    "text_truncate": _document_text("label", fx.shorten),
    "tags_sanitize": tags_sanitize,
    "tags_membership": tags_membership,
    "node_granularity": _refused(_admitted_nodes, R.bad_granularity),
    "node_level": _refused(_admitted_nodes, R.bad_level),
    "node_empty": _refused(_admitted_nodes, R.empty_text),
    "node_sentence": _refused(_admitted_nodes, R.not_a_sentence),
    "node_prefix": _refused(_admitted_nodes, R.bad_prefix),
    "node_batch_dup": _refused(_admitted_nodes, R.node_in_batch),
    "node_store_dup": _refused(_admitted_nodes, R.node_in_store),
    "node_accept": node_accept,
    "node_admission": node_admission,
    "node_ids": node_ids,
    "decision_counts": decision_counts,
    "events_nodes": events_nodes,
    "event_steps": event_steps,
    "edge_batch_dup": _refused(_admitted_edges, R.edge_in_batch),
    "edge_unknown_from": _refused(_admitted_edges, R.unknown_from, True),
    "edge_unknown_to": _refused(_admitted_edges, R.unknown_to, True),
    "edge_self_loop": _refused(_admitted_edges, R.self_loop),
    "edge_exists": _refused(_admitted_edges, R.edge_in_store),
    "edge_cycle": _refused(_admitted_edges, R.cycle),
    "edge_kind": _refused(_admitted_edges, R.bad_source),
    "edge_level": _refused(_admitted_edges, R.level_falls),
    "edge_rationale": _refused(_admitted_edges, R.no_rationale),
    "edge_accept": edge_accept,
    "edge_admission": edge_admission,
    "edge_endpoints": edge_endpoints,
    "events_edges": events_edges,
    "event_lines": event_lines,
    "cycle_witness": cycle_witness,
    "edge_admission_folded": edge_admission_folded,
    "edge_cycle_folded": _refused(_admitted_folded, R.cycle),
    "edge_kind_folded": _refused(_admitted_folded, R.bad_source),
    "cycle_witness_folded": cycle_witness_folded,
    "prereq_dag_folded": prereq_dag_folded,
    "reachable_pairs": reachable_pairs,
    "inventory": _graph(lambda n, e: views.inventory(n)),
    "inventory_json": _graph(lambda n, e: views.inventory_json(n)),
    "summary_nodes": _graph(lambda n, e: views.node_counts(n)),
    "summary_edges": _graph(lambda n, e: views.edge_counts(e)),
    "support_counts": _graph(lambda n, e: views.support_counts(e)),
    "top_outcomes": _graph(views.top_outcomes),
    "graph_summary": _graph(lambda n, e: views.graph_summary(n, e).withColumn("top_learning_outcomes", F.to_json("top_learning_outcomes"))),
    "summary_lines": _graph(lambda n, e: views.summary_lines(views.top_outcomes(n, e))),
    "degree_stats": _graph(views.degree_stats),
    "report_lines": _graph(lambda n, e: views.report_lines(views.graph_summary(n, e))),
    "layout_order": _graph(lambda n, e: views.layout_order(n)),
    "layout_nodes": _graph(lambda n, e: views.layout_nodes(n)),
    "layout_edges_directed": _graph(lambda n, e: views.layout_edges(e, "PrerequisiteFor")),
    "layout_edges_undirected": _graph(lambda n, e: views.layout_edges(e, "Supports")),
    "dot_nodes": _graph(lambda n, e: views.dot_nodes(n)),
    "dot_edges": _graph(views.dot_edges),
    "dot_edges_first_labels": _graph(partial(views.dot_edges, label_first=10)),
    "dot_lines": _graph(views.dot_lines),
    "reachability": _graph(lambda n, e: acyclic.reachable(_prereq(e))),
    "prereq_dag_ok": _graph(lambda n, e: acyclic.is_acyclic(_prereq(e))),
    "prereq_rank": _graph(lambda n, e: acyclic.longest_path_rank(_prereq(e))),
    "learning_path": learning_path,
    "gen_concepts": lambda spark, d: generators.concepts(spark, N_CONCEPTS).drop("tags"),
    "gen_outcomes": lambda spark, d: generators.outcomes(spark, N_OUTCOMES, N_CONCEPTS).drop("tags"),
    "gen_tags": lambda spark, d: generators.node_proposals(spark, N_CONCEPTS, N_OUTCOMES).select("pos", "tags"),
    "gen_all": lambda spark, d: generators.node_proposals(spark, N_CONCEPTS, N_OUTCOMES),
    "gen_supports": gen_supports,
    "gen_prereq_chain": gen_prereq_chain,
    "gen_rationale": gen_rationale,
    "gen_edge_cap": gen_edge_cap,
    "src_default_counts": src_default_counts,
    "json_nodes": json_nodes,
    "json_edges": json_edges,
}
