"""Admission of edge proposals. The first rule that fails gives the reason; a prerequisite edge is accepted only while the graph stays acyclic.

Order: batch, then position. Within a batch a link (from, to, relation) is taken by its first proposal, whatever becomes of it. Over all batches,
each link has one proposal that decides: the first that fails no other rule. If it closes a cycle, so does every later one; if it
is accepted, later ones are repeats. So only those deciding proposals enter the acyclic replay.

Defined results: ids in any spelling of a UUID are one id; null and unknown ids are unknown ids; a null
rationale counts as missing; a proposal delivered twice gets one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.functions.ids import canonical_id
from graftwork.functions.text import domain_value, trim_all
from graftwork.operators.acyclic import closing
from graftwork.operators.admit_nodes import once, sequence_number
from graftwork.rules import DEFAULT, RuleSet
from graftwork.scratch import Scratch

LINK = ["from_id", "to_id", "relation"]


def checked_edges(proposals: DataFrame, nodes: DataFrame, edges: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Adds seq, early_reason (rules before the cycle rule, without links accepted in this run) and late_reason (rules after it).
    A node is known to proposals of its own batch and later ones."""
    cleaned = once(proposals).withColumns(
        {
            "relation": domain_value(F.col("relation"), rules.relations),
            "from_id": F.coalesce(canonical_id(F.col("from_id")), F.lit("")),
            "to_id": F.coalesce(canonical_id(F.col("to_id")), F.lit("")),
            "rationale": trim_all(F.coalesce("rationale", F.lit(""))),
            "seq": sequence_number(),
        }
    )
    rows = Scratch(proposals.sparkSession, "cleaned").keep(cleaned)  # two readers: the ids are cleaned once
    firsts = rows.groupBy("batch_id", *LINK).agg(F.min("pos").alias("first_pos"))
    keyed = [rows[c].eqNullSafe(firsts[c]) for c in ("batch_id", *LINK)]
    rows = rows.join(firsts, keyed[0] & keyed[1] & keyed[2] & keyed[3]).select(rows["*"], firsts["first_pos"])
    ends = nodes.select("id", "kind", "level", F.col("batch_id").alias("since"))
    for side in ("from", "to"):
        end = ends.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("level").alias(f"{side}_level"), F.col("since").alias(f"{side}_since"))
        rows = rows.join(end, f"{side}_id", "left")
    there = edges.select(*LINK).distinct().withColumn("stored", F.lit(True))
    rows = rows.join(there, LINK, "left")
    known = lambda side: F.coalesce(F.col(f"{side}_since") <= F.col("batch_id"), F.lit(False))
    prereq = F.col("relation") == "PrerequisiteFor"
    early = (
        F.when(F.col("relation").isNull(), rules.unknown_relation)
        .when(F.col("pos") > F.col("first_pos"), rules.edge_in_batch)
        .when(~known("from"), F.concat(F.lit(rules.unknown_from), "from_id"))
        .when(~known("to"), F.concat(F.lit(rules.unknown_to), "to_id"))
        .when(F.col("from_id") == F.col("to_id"), rules.self_loop)
        .when(F.col("stored"), rules.edge_in_store)
    )
    late = (
        F.when(prereq & (F.col("from_kind") != "Concept"), rules.bad_source)
        .when(prereq & ~F.col("to_kind").isin(*rules.kinds), rules.bad_target)
        .when(prereq & (F.col("from_level") > F.col("to_level")), rules.level_falls)
        .when(F.col("rationale") == "", rules.no_rationale)
    )
    return rows.withColumns({"early_reason": early, "late_reason": late})


def admit_edges(proposals: DataFrame, nodes: DataFrame, edges: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """The proposals with accepted and reason. ``nodes``: id, kind, level, batch_id; ``edges``: from_id, to_id, relation accepted before."""
    scratch = Scratch(proposals.sparkSession, "edges")
    rows = scratch.keep(checked_edges(proposals, nodes, edges, rules))
    clean = rows.where("early_reason IS NULL AND late_reason IS NULL")
    deciding = scratch.keep(clean.groupBy(*LINK).agg(F.min("seq").alias("seq")))
    stored = edges.where("relation = 'PrerequisiteFor'").select("from_id", "to_id")
    proposed = deciding.where("relation = 'PrerequisiteFor'").select("seq", "from_id", "to_id")
    asked = rows.where("early_reason IS NULL AND late_reason IS NOT NULL AND relation = 'PrerequisiteFor'").select("seq", "from_id", "to_id")
    closes = scratch.keep(closing(stored, proposed, asked)).withColumn("closing", F.lit(True))
    fate = deciding.join(closes.withColumnRenamed("closing", "refused"), "seq", "left").select(*LINK, F.col("seq").alias("decided"), F.coalesce("refused", F.lit(False)).alias("refused"))
    told = rows.join(fate, LINK, "left")
    taken = (F.col("seq") > F.col("decided")) & ~F.col("refused")
    again = (F.col("seq") >= F.col("decided")) & F.col("refused")
    told = told.withColumn("stage", F.when(F.col("early_reason").isNotNull(), "early").when(taken, "taken").when(again, "cycle").when(F.col("seq") == F.col("decided"), "accepted").otherwise("late"))
    reason = (
        F.when(F.col("stage") == "early", F.col("early_reason"))
        .when(F.col("stage") == "taken", rules.edge_in_store)
        .when((F.col("stage") == "cycle") | ((F.col("stage") == "late") & F.col("closing")), rules.cycle)
        .when(F.col("stage") == "late", F.col("late_reason"))
    )
    out = told.join(closes, "seq", "left").withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return out.drop("early_reason", "late_reason", "decided", "refused", "stage", "closing", "stored", "first_pos", "from_since", "to_since")


def edge_decisions(admitted: DataFrame) -> DataFrame:
    return admitted.select("batch_id", "pos", "accepted", "reason", F.lit(None).cast("string").alias("assigned_id"))


def accepted_edges(admitted: DataFrame) -> DataFrame:
    return admitted.where("accepted").select("from_id", "to_id", "relation", "rationale", "seq", "batch_id")
