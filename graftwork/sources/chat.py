"""Proposals from a chat service. The service is a callable that the caller injects; nothing here opens a connection.

Whatever goes wrong (switched off, no key, an error, an answer that breaks the format, an empty answer) the
deterministic generator takes over.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork import schemas
from graftwork.rules import DEFAULT, RuleSet
from graftwork.sources import generators, payloads

log = logging.getLogger(__name__)


class ChatUnavailable(Exception):
    """No chat service: switched off or not configured."""


@dataclass(frozen=True)
class ChatConfig:
    key: str
    model: str = "gpt-4o-mini"
    base_url: str | None = None
    temperature: float = 0.2

    @classmethod
    def load(cls, use_chat: bool, environment: Mapping[str, str]) -> ChatConfig:
        """From the usual variables; raises if chat is switched off or has no key."""
        if not use_chat:
            raise ChatUnavailable("disabled")
        key = environment.get("OPENAI_API_KEY", "")
        if not key:
            raise ChatUnavailable("missing key")
        return cls(key, environment.get("OPENAI_MODEL") or "gpt-4o-mini", environment.get("OPENAI_BASE_URL"))


#: Gets the configuration, a prompt and the JSON schema (as DDL) of the answer; gives the answer's text.
Chat = Callable[[ChatConfig, str, str], str]


def available(use_chat: bool, environment: Mapping[str, str]) -> ChatConfig | None:
    """The configuration, or None (with a warning unless chat is switched off on purpose)."""
    try:
        return ChatConfig.load(use_chat, environment)
    except ChatUnavailable as e:
        if use_chat:
            log.warning("chat is not available: %s", e)
        return None


def _parsed(spark: SparkSession, answer: str, parse) -> DataFrame | None:
    rows = parse(spark.createDataFrame([(answer,)], "payload string"), "payload")
    return None if rows.isEmpty() else rows


def node_source(spark: SparkSession, n_concepts: int | None = None, n_outcomes: int | None = None, chat: Chat | None = None, config: ChatConfig | None = None, rules: RuleSet = DEFAULT) -> DataFrame:
    """Node proposals of the chat service, else of the generator."""
    c, o = generators.requested(n_concepts, rules.default_concepts), generators.requested(n_outcomes, rules.default_outcomes)
    if chat and config:
        try:
            prompt = f"Propose {c} nodes of kind Concept and {o} of kind LearningOutcome for a course on program design, one sentence each."
            if (rows := _parsed(spark, chat(config, prompt, schemas.NODE_PAYLOAD), payloads.node_payloads)) is not None:
                return rows
        except Exception as e:  # the service may fail in any way
            log.warning("chat failed: %s", e)
    return generators.node_proposals(spark, c, o, rules)


def inventory_prompt(nodes: DataFrame) -> DataFrame:
    """One row: the inventory as a JSON list, in order. It goes into one prompt."""
    item = F.to_json(F.struct("id", "kind", "level", "text"))
    return nodes.agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items")).select(F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")).alias("inventory"))


def edge_source(nodes: DataFrame, target: int | None = None, chat: Chat | None = None, config: ChatConfig | None = None, rules: RuleSet = DEFAULT) -> DataFrame:
    """Edge proposals of the chat service, which is shown the whole inventory, else of the generator."""
    if chat and config:
        try:
            shown = inventory_prompt(nodes).first()[0]
            prompt = f"Propose up to {generators.requested(target, rules.default_edges)} edges (PrerequisiteFor, Supports) between these nodes, with a rationale each: {shown}"
            if (rows := _parsed(nodes.sparkSession, chat(config, prompt, schemas.EDGE_PAYLOAD), payloads.edge_payloads)) is not None:
                return rows
        except Exception as e:  # the service may fail in any way
            log.warning("chat failed: %s", e)
    return generators.edge_proposals(nodes, target, rules)
