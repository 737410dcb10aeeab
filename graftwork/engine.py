"""A learning graph with its five requests: add nodes, add edges, inventory, summary, DOT export."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork import schemas
from graftwork.operators.admit_edges import accepted_edges, admit_edges, edge_decisions
from graftwork.operators.admit_nodes import accepted_nodes, admit_nodes, decisions, sequence_number
from graftwork.plans import views
from graftwork.rules import DEFAULT, RuleSet
from graftwork.scratch import Scratch
from graftwork.store import GraphStore

log = logging.getLogger(__name__)
#: Gets the sorted display frames: nodes, directed edges, undirected edges.
Redraw = Callable[[DataFrame, DataFrame, DataFrame], None]

_EVENT_COLUMNS = [c.split()[0] for c in schemas.EVENTS.split(", ")]


def as_events(rows: DataFrame) -> DataFrame:
    """Fills the one wide event schema."""
    kinds = dict(c.split() for c in schemas.EVENTS.split(", "))
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _EVENT_COLUMNS))


class LearningGraph:
    """The single writer of one graph. Every batch gets the next number; its decisions, events and accepted rows are written before the call returns.
    ``redraw`` is called with the display after each batch of which something was accepted."""

    def __init__(self, spark: SparkSession, path: str, rules: RuleSet = DEFAULT, redraw: Redraw | None = None):
        self.spark, self.rules, self.store, self.redraw = spark, rules, GraphStore(spark, path), redraw

    def _next(self) -> int:
        last = self.store.read("decisions").agg(F.max("batch_id")).first()[0]
        return 0 if last is None else last + 1

    def add_nodes(self, proposals: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Decisions of one ordered batch (pos, kind, granularity, level, text, tags)."""
        n = self._next() if batch_id is None else batch_id
        store = self.store.read("nodes", n).select("norm_text", "batch_id")
        admitted = self._once(admit_nodes(proposals.withColumn("batch_id", F.lit(n).cast("long")), store, self.rules))
        return self._finish(n, "nodes", admitted, accepted_nodes(admitted), decisions(admitted), views.node_events(admitted, sequence_number()))

    def add_edges(self, proposals: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Decisions of one ordered batch (pos, relation, from_id, to_id, rationale)."""
        n = self._next() if batch_id is None else batch_id
        admitted = self._once(admit_edges(proposals.withColumn("batch_id", F.lit(n).cast("long")), self.store.read("nodes", n), self.store.read("edges", n), self.rules))
        return self._finish(n, "edges", admitted, accepted_edges(admitted), edge_decisions(admitted), views.edge_events(admitted, sequence_number()))

    def _once(self, admitted: DataFrame) -> DataFrame:
        """Decisions feed three tables; they are made once."""
        self.scratch = Scratch(self.spark, "batch")
        return self.scratch.keep(admitted)

    def display(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sorted frames of the display: nodes, directed edges, undirected edges."""
        edges = self.store.read("edges")
        return views.layout_nodes(self.store.read("nodes"), self.rules), views.layout_edges(edges, "PrerequisiteFor"), views.layout_edges(edges, "Supports")

    def _finish(self, n: int, what: str, admitted: DataFrame, kept: DataFrame, decided: DataFrame, events: DataFrame) -> DataFrame:
        kinds = dict(c.split() for c in (schemas.NODES if what == "nodes" else schemas.EDGES).split(", "))
        self.store.write(what, n, kept.select(*(F.col(c).cast(t) for c, t in kinds.items())))
        self.store.write("events", n, as_events(events).withColumn("batch_id", F.lit(n).cast("long")))
        self.store.write("decisions", n, decided.withColumn("what", F.lit(what)))  # last: it marks the batch as done
        self.scratch.clear()
        mine = self.store.read("decisions").where(f"batch_id = {n}").drop("what")
        counts = views.decision_counts(mine).first()
        log.info("batch %d: accepted %d %s, rejected %d", n, counts.n_accepted, what, counts.n_rejected)
        for r in views.reason_counts(mine).orderBy("rule").collect() if counts.n_rejected else ():  # as many rows as there are rules
            log.warning("batch %d: rejected %d %s: %s", n, r.n, what, r.rule)
        if self.redraw and counts.n_accepted:
            self.redraw(*self.display())
        return mine.orderBy("pos")

    def inventory(self) -> DataFrame:
        return views.inventory(self.store.read("nodes")).orderBy("seq")

    def summarize(self) -> DataFrame:
        """The summary row. The top outcomes are also announced as events."""
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        lines = views.summary_lines(views.top_outcomes(nodes, edges, self.rules))
        n = self._next()
        self.store.write("events", 1_000_000_000 + n, as_events(lines.select(F.shiftleft(F.lit(n).cast("long"), 32).alias("event_seq"), F.lit("SummaryLine").alias("event_type"), "message")).withColumn("batch_id", F.lit(n).cast("long")))
        return views.graph_summary(nodes, edges, self.rules)

    def export_dot(self, path: str, name: str = "learning_graph") -> None:
        views.write_dot(self.store.read("nodes"), self.store.read("edges"), path, name)

    def events(self) -> DataFrame:
        return self.store.read("events")
