"""The rules of a learning graph as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RuleSet:
    """Domains, limits and messages. The defaults are fixed values of the format."""

    kinds: tuple[str, ...] = ("Concept", "LearningOutcome")
    relations: tuple[str, ...] = ("PrerequisiteFor", "Supports")
    granularities: tuple[str, ...] = ("Sentence",)
    max_level: int = 3
    allowed_tags: tuple[str, ...] = ("design_recipe", "contract", "purpose", "tests", "stub", "implementation", "refactor")
    max_tags: int = 3
    outcome_prefixes: tuple[str, ...] = ("i can ", "students can ")
    label_length: int = 80
    supports_per_outcome: int = 3
    top_outcomes: int = 5
    default_concepts: int = 25
    default_outcomes: int = 5
    default_edges: int = 40
    graph_id: str = "graph"

    # reasons, in the order in which the rules are applied
    unknown_kind: str = "node kind is unknown"
    bad_granularity: str = "granularity must be sentence"
    bad_level: str = "level must be between 0 and 3"
    empty_text: str = "node text is empty after trimming"
    not_a_sentence: str = "node text must be a single sentence"
    bad_prefix: str = "learning outcomes must start with 'I can' or 'Students can'"
    node_in_batch: str = "duplicate node within batch"
    node_in_store: str = "duplicate node already present"
    unknown_relation: str = "edge relation is unknown"
    edge_in_batch: str = "duplicate edge within batch"
    unknown_from: str = "unknown from_id "
    unknown_to: str = "unknown to_id "
    self_loop: str = "self-loops are not allowed"
    edge_in_store: str = "edge already exists"
    cycle: str = "edge would introduce a prerequisite cycle"
    bad_source: str = "prerequisite edges must originate from a concept"
    bad_target: str = "prerequisite edges must target a concept or learning outcome"
    level_falls: str = "prerequisite edges must not decrease level"
    no_rationale: str = "edge rationale missing"


DEFAULT = RuleSet()
