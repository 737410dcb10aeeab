"""Text and tag expressions. White space is Unicode's, not the ASCII six."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graftwork.rules import DEFAULT, RuleSet


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Key under which texts count as the same."""
    return F.lower(clean(c))


def is_single_sentence(c: Column) -> Column:
    """Exactly one of . ! ? and that one last (of a cleaned text)."""
    return c.rlike(r"^[^.!?]*[.!?]$")


def shorten(c: Column, most: int = DEFAULT.label_length) -> Column:
    t = trim_all(c)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


def has_prefix(c: Column, prefixes: tuple[str, ...] = DEFAULT.outcome_prefixes) -> Column:
    low = F.lower(c)
    found = low.startswith(prefixes[0])
    for p in prefixes[1:]:
        found = found | low.startswith(p)
    return found


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def domain_value(c: Column, values: tuple[str, ...]) -> Column:
    """The value of the domain that is spelled alike up to case and what stands between letters; null for others."""
    low = letters_only(c)
    return F.coalesce(*(F.when(low == v.lower(), F.lit(v)) for v in values))


def sanitize_tags(c: Column, rules: RuleSet = DEFAULT) -> Column:
    """Trimmed, lowercased, known, first of its kind, the first few; null instead of an empty list."""
    known = F.filter(F.transform(c, lambda t: F.lower(trim_all(t))), lambda t: t.isin(*rules.allowed_tags))
    kept = F.slice(F.array_distinct(known), 1, rules.max_tags)
    return F.when(F.size(kept) > 0, kept)


def escape_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def tag_suffix(c: Column) -> Column:
    """' tags=[a,b]', or nothing without tags."""
    return F.when(F.size(c) > 0, F.concat(F.lit(" tags=["), F.array_join(c, ","), F.lit("]"))).otherwise("")


def content_id(norm: Column, graph_id: str = DEFAULT.graph_id) -> Column:
    """Id of a node by its graph and normalised text, in the form of a UUID."""
    h = F.md5(F.concat(F.lit(graph_id + ":"), norm))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def register_functions(spark: SparkSession) -> None:
    """The same as SQL functions, with expression bodies that the optimizer inlines."""
    tags = ", ".join(f"'{t}'" for t in DEFAULT.allowed_tags)
    bodies = {
        "clean_text(s STRING) RETURNS STRING": r"trim(regexp_replace(s, '(?U)\\s+', ' '))",
        "normalize_text(s STRING) RETURNS STRING": r"lower(trim(regexp_replace(s, '(?U)\\s+', ' ')))",
        "trim_text(s STRING) RETURNS STRING": r"regexp_replace(s, '(?U)^\\s+|\\s+$', '')",
        "is_single_sentence(s STRING) RETURNS BOOLEAN": "s RLIKE '^[^.!?]*[.!?]$'",
        "shorten_text(s STRING) RETURNS STRING": r"CASE WHEN length(regexp_replace(s, '(?U)^\\s+|\\s+$', '')) > 80 THEN concat(left(regexp_replace(s, '(?U)^\\s+|\\s+$', ''), 80), '...') ELSE regexp_replace(s, '(?U)^\\s+|\\s+$', '') END",
        "sanitize_tags(a ARRAY<STRING>) RETURNS ARRAY<STRING>": rf"nullif(slice(array_distinct(filter(transform(a, t -> lower(regexp_replace(t, '(?U)^\\s+|\\s+$', ''))), t -> t IN ({tags}))), 1, 3), array())",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
