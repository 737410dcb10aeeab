"""Proposals from JSON payloads: {"nodes": [...]} or {"edges": [...]}, or one proposal object a row.

A payload is taken whole or not at all: if it does not parse, lacks a field, has an unknown enum value or a level outside
0..255, none of its proposals are used. Unknown keys are ignored; absent tags are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork import schemas
from graftwork.functions.text import domain_value
from graftwork.rules import DEFAULT, RuleSet

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _good_node(x: Column, rules: RuleSet) -> Column:
    known = domain_value(x["kind"], rules.kinds).isNotNull() & x["granularity"].isNotNull()
    return F.coalesce(known & x["level"].between(0, 255) & x["text"].isNotNull(), F.lit(False))


def _good_edge(x: Column, rules: RuleSet) -> Column:
    return F.coalesce(domain_value(x["relation"], rules.relations).isNotNull() & x["from_id"].isNotNull() & x["to_id"].isNotNull() & x["rationale"].isNotNull(), F.lit(False))


def _unfold(df: DataFrame, payload: str, schema: str, field: str, good) -> DataFrame:
    items = F.from_json(F.col(payload), schema, _STRICT)[field]
    kept = df.withColumn("_items", items).where(F.col("_items").isNotNull() & F.forall("_items", good))
    return kept.select(*[c for c in df.columns if c != payload], F.posexplode("_items").alias("pos", "_item"))


def node_payloads(df: DataFrame, payload: str, rules: RuleSet = DEFAULT) -> DataFrame:
    """The other columns, pos, kind, granularity, level, text, tags."""
    return _unfold(df, payload, schemas.NODE_PAYLOAD, "nodes", lambda x: _good_node(x, rules)).select("*", "_item.*").drop("_item")


def edge_payloads(df: DataFrame, payload: str, rules: RuleSet = DEFAULT) -> DataFrame:
    """The other columns, pos, relation, from_id, to_id, rationale."""
    return _unfold(df, payload, schemas.EDGE_PAYLOAD, "edges", lambda x: _good_edge(x, rules)).select("*", "_item.*").drop("_item")


def node_objects(df: DataFrame, body: str, rules: RuleSet = DEFAULT) -> DataFrame:
    """One proposal object a row; rows that are cut off or break the format are left out. Numbers in strings are numbers."""
    wrapped = df.withColumn("_whole", F.concat(F.lit('{"nodes":['), F.col(body), F.lit("]}")))
    rows = _unfold(wrapped.drop(body), "_whole", schemas.NODE_PAYLOAD.replace("level:int", "level:string"), "nodes", lambda x: _good_node(x.withField("level", x["level"].try_cast("int")), rules))
    return rows.select("*", "_item.*").withColumn("level", F.col("level").cast("int")).drop("_item", "pos")
