"""Admission of node proposals: every proposal gets a decision, and the first rule that fails gives the reason.

Batches are taken in order of batch_id, proposals in order of pos. A text counts as taken once a proposal with it passed the
text rules: later ones in the same batch are duplicates within the batch (whatever became of the first), in a later batch they
are duplicates of the store. The whole table is one plan: the first proposal of each text is found by an
aggregate (combined before the shuffle) and joined back, so a text that fills a third of the rows is never sorted in one task.

Defined results: a null text counts as empty; a proposal delivered twice gets one decision; null tags stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.functions.text import clean, content_id, domain_value, has_prefix, is_single_sentence, normalize, sanitize_tags
from graftwork.rules import DEFAULT, RuleSet


def once(proposals: DataFrame) -> DataFrame:
    """One row for each proposal, however often it was delivered."""
    return proposals.dropDuplicates(["proposal_id"]) if "proposal_id" in proposals.columns else proposals


def checked_nodes(proposals: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Adds clean_text, norm_text, and static_reason: the first of the rules on a single proposal that fails."""
    rows = once(proposals).withColumns(
        {
            "kind": domain_value(F.col("kind"), rules.kinds),
            "granularity": domain_value(F.col("granularity"), rules.granularities),
            "clean_text": clean(F.coalesce("text", F.lit(""))),
            "norm_text": normalize(F.coalesce("text", F.lit(""))),
        }
    )
    text = F.col("clean_text")
    reason = (
        F.when(F.col("kind").isNull(), rules.unknown_kind)
        .when(F.col("granularity").isNull(), rules.bad_granularity)
        .when(F.col("level").isNull() | (F.col("level") < 0) | (F.col("level") > rules.max_level), rules.bad_level)
        .when(text == "", rules.empty_text)
        .when(~is_single_sentence(text), rules.not_a_sentence)
        .when((F.col("kind") == "LearningOutcome") & ~has_prefix(text, rules.outcome_prefixes), rules.bad_prefix)
    )
    return rows.withColumn("static_reason", reason)


def admit_nodes(proposals: DataFrame, store: DataFrame | None = None, rules: RuleSet = DEFAULT) -> DataFrame:
    """The proposals with accepted, reason, assigned_id and tags as stored. ``store``: norm_text, batch_id of nodes accepted before;
    a stored node counts for proposals of later batches."""
    rows = checked_nodes(proposals, rules)
    passed = rows.where("static_reason IS NULL")
    firsts = passed.groupBy("norm_text", "batch_id").agg(F.min("pos").alias("first_pos"))
    seen = firsts.groupBy("norm_text").agg(F.min("batch_id").alias("first_batch"))
    if store is not None:
        # of the history only the batch's own texts; a small batch is sent to it, so the history is not shuffled
        known = store.join(seen.select("norm_text"), "norm_text", "left_semi").groupBy("norm_text").agg(F.min("batch_id").alias("store_batch"))
        seen = seen.join(known, "norm_text", "left")
    else:
        seen = seen.withColumn("store_batch", F.lit(None).cast("long"))
    keyed = firsts.join(seen, "norm_text")
    later = F.coalesce(F.col("first_batch") < F.col("batch_id"), F.lit(False)) | F.coalesce(F.col("store_batch") < F.col("batch_id"), F.lit(False))
    dynamic = F.when(F.col("pos") > F.col("first_pos"), rules.node_in_batch).when(later, rules.node_in_store)
    # the first batch that brings a text accepts it, unless the store had it: then no batch does
    key = F.when(F.col("static_reason").isNull(), F.col("norm_text"))
    both = rows.withColumn("_key", key).join(keyed.withColumnRenamed("norm_text", "_key"), ["_key", "batch_id"], "left")
    both = both.select(*rows.columns, F.coalesce("static_reason", dynamic).alias("reason"))
    accepted = F.col("reason").isNull()
    return both.withColumns({"accepted": accepted, "assigned_id": F.when(accepted, content_id(F.col("norm_text"), rules.graph_id)), "stored_tags": sanitize_tags(F.col("tags"), rules)}).drop("static_reason")


def decisions(admitted: DataFrame) -> DataFrame:
    return admitted.select("batch_id", "pos", "accepted", "reason", "assigned_id")


def accepted_nodes(admitted: DataFrame) -> DataFrame:
    """The rows that are appended to the node table; seq orders them by batch and position."""
    return admitted.where("accepted").select(F.col("assigned_id").alias("id"), "kind", "granularity", "level", F.col("clean_text").alias("text"), F.col("stored_tags").alias("tags"), "norm_text", sequence_number().alias("seq"), "batch_id")


def sequence_number():
    """Order of a proposal over all batches as one number."""
    return F.shiftleft(F.col("batch_id"), 32) + F.col("pos")
