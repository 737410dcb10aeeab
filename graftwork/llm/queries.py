"""Queries of the problems on texts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.alike_sql import SQL as ALIKE_SQL
from graftwork.llm.contamination import leaks
from graftwork.llm.content_filter import Machine, fit, score_documents
from graftwork.llm.ledger import Ledger, json_keys, text_key
from graftwork.llm.near_duplicates import near_duplicates
from graftwork.llm.segment_index import repeats_of_history
from graftwork.llm.tokenize import decode, encode_corpus, public_path, public_pattern
from graftwork.plans.tables import table

#: Similarity from which texts count as alike, and the least number of distinct words.
ALIKE, MIN_WORDS = 0.7, 8
#: Batches of the history in which the ledger takes in the tables.
WAVES = 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = near_duplicates(table(spark, d, "node_proposals"), "proposal_id", "text", ALIKE, MIN_WORDS)
    edges = near_duplicates(table(spark, d, "edge_proposals"), "proposal_id", "rationale", ALIKE, MIN_WORDS)
    return nodes.select(F.lit("node_proposals").alias("src_table"), "id_a", "id_b").unionByName(edges.select(F.lit("edge_proposals").alias("src_table"), "id_a", "id_b"))


def _waves(spark: SparkSession, rows: DataFrame) -> Ledger:
    """Feeds (id, key, batch) rows to a ledger as successive ranges of batches, as they would arrive; rows without a batch come with the first."""
    ledger = Ledger(spark)
    low, high = rows.select("batch").agg(F.min("batch"), F.max("batch")).first()
    if low is None:
        ledger.add(rows)
        return ledger
    rows = rows.withColumn("batch", F.coalesce("batch", F.lit(low)))
    step = (high - low) // WAVES + 1
    for k in range(WAVES):
        ledger.add(rows.where((F.col("batch") >= low + k * step) & (F.col("batch") < low + (k + 1) * step)))
    return ledger


def _ledgers(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "node_proposals").select(F.col("proposal_id").alias("id"), text_key(F.col("text")).alias("key"), F.col("batch_id").alias("batch"))
    bodies = table(spark, d, "node_payloads")
    keyed = json_keys(bodies, "payload_id", "body")
    step = bodies.select(F.col("payload_id").alias("id"), F.col("batch_id").alias("batch"))
    named = (("node_proposals", nodes), ("node_payloads", keyed.join(step, "id")))
    return reduce(DataFrame.unionByName, [_waves(spark, rows).records().select(F.lit(name).alias("src_table"), "first_id", "n_copies") for name, rows in named])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledgers(spark, d).where("n_copies >= 2")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record that remains after collapsing, with its number of copies."""
    return _ledgers(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "node_proposals").select(F.col("proposal_id").alias("new_id"), "text", F.col("batch_id").alias("batch"))
    old = table(spark, d, "nodes").select(F.col("id").alias("old_id"), "text", F.col("batch_id").alias("batch"))
    return repeats_of_history(new, old, ALIKE, MIN_WORDS).select(F.col("new_id").alias("proposal_id"), F.col("old_id").alias("node_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", public_path(), public_pattern())


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids; null texts come back empty."""
    return decode(p6_ids(spark, d), public_path())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Each item with the number of documents that leak it."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents")), "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, Machine]:
    documents = table(spark, d, "documents")
    machine = fit(documents, table(spark, d, "review_labels"))
    return score_documents(documents, machine), machine


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    scored, machine = _scored(spark, d)
    return scored.where(F.col("score") >= machine.threshold).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and what to do with it: above the gap exclude, within it (no labelled document scores so) review."""
    scored, machine = _scored(spark, d)
    decision = F.when(F.col("score") >= machine.high, "exclude").when(F.col("score") > machine.low, "review").otherwise("keep")
    return scored.select("doc_id", F.round("score", 6).alias("score"), decision.alias("decision"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, and how many and what share of them hold such content; null sources are one group."""
    marked = table(spark, d, "documents").select("doc_id", "source").join(p8_found(spark, d).distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("n_documents"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


QUERIES = {q.__name__: q for q in (p2_found, p3_found, p3_records, p4_found, p6_ids, p6_decoded, p7_found, p7_report, p8_found, p8_scores, p8_rates)}

_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_LETTERS = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_VALUE = """CASE WHEN json_type(v) = 'NULL' THEN 'null' WHEN json_type(v) = 'ARRAY' THEN 'list ' || array_to_string(list_sort(list_transform(CAST(v AS VARCHAR[]), lambda t: """ + _LETTERS.format("t") + """)), ',')
  ELSE 'one ' || """ + _LETTERS.format("(v ->> '$')") + " END"
_RECORDS = f"""records AS (
  SELECT 'node_proposals' AS src_table, min(proposal_id) AS first_id, count(DISTINCT proposal_id) AS n_copies FROM node_proposals
  WHERE {_LETTERS.format("text")} <> '' GROUP BY {_LETTERS.format("text")}
  UNION ALL SELECT 'node_payloads', min(payload_id), count(DISTINCT payload_id) FROM (
    SELECT payload_id, string_agg(k || '=' || {_VALUE}, ';' ORDER BY k) AS body FROM (
      SELECT payload_id, k, json_extract(body, '$."' || k || '"') AS v FROM (SELECT payload_id, body, unnest(json_keys(body)) AS k FROM node_payloads WHERE json_valid(body))) GROUP BY payload_id) GROUP BY body)"""
_RUNS = f"""RECURSIVE doc_words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
item_runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item_words WHERE len(w) >= 10)),
doc_runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM doc_words WHERE len(w) >= 10)),
leaked AS (SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run))"""

SQL = {
    **ALIKE_SQL,
    "p3_found": f"WITH {_RECORDS} SELECT src_table, first_id, n_copies FROM records WHERE n_copies >= 2",
    "p3_records": f"WITH {_RECORDS} SELECT src_table, first_id, n_copies FROM records",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM leaked",
    "p7_report": f"WITH {_RUNS} SELECT item_id, any_value(suite) AS suite, count(doc_id) AS n_documents FROM eval_items LEFT JOIN leaked USING (item_id) GROUP BY item_id",
}
