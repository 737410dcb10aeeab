"""Queries of problem 1 (hierarchies) and problem 5 (orphan references), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.operators.hierarchy import hierarchy_closure, hierarchy_paths, resolve_hierarchy
from graftwork.operators.references import orphan_references, orphan_report, reference_rows
from graftwork.plans.tables import relation_letters, table


def _prerequisites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_proposals").where(relation_letters(F.col("relation")) == "prerequisitefor")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(_prerequisites(spark, d), "from_id", "to_id")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of every node that hangs under a root."""
    return hierarchy_paths(_prerequisites(spark, d), "from_id", "to_id")


def p1_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that lies below each node."""
    return hierarchy_closure(p1_paths(spark, d))


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle by its smallest id: nodes on it, nodes below it."""
    found = p1_found(spark, d).where("depth < 0")
    return found.groupBy(F.col("root_id").alias("cycle_id")).agg(F.count_if(F.col("depth") == -1).alias("n_on_cycle"), F.count_if(F.col("depth") == -2).alias("n_below"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    fields = ["from_id", "to_id"]
    proposed = reference_rows(table(spark, d, "edge_proposals"), "edge_proposals", "proposal_id", "proposed_at", fields)
    return proposed.unionByName(reference_rows(table(spark, d, "edges"), "edges", "seq", "accepted_at", fields))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), table(spark, d, "nodes"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_references(spark, d), table(spark, d, "nodes"))


QUERIES = {q.__name__: q for q in (p1_found, p1_paths, p1_closure, p1_cycles, p5_found, p5_report)}


def _canon(c: str) -> str:
    bare = rf"replace(regexp_replace(regexp_replace(lower({c}), '^[\s{{(\[]*(urn:uuid:)?[\s{{(\[]*', ''), '[\s}})\]]*$', ''), '-', '')"
    return f"""CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{32}}') THEN regexp_replace({bare}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') ELSE {c} END"""


_LINKS = f"""RECURSIVE links AS (
  SELECT node, min(parent) AS parent FROM (SELECT {_canon("to_id")} AS node, {_canon("from_id")} AS parent FROM edge_proposals
    WHERE regexp_replace(lower(relation), '[^a-z]', '', 'g') = 'prerequisitefor' AND from_id IS NOT NULL AND to_id IS NOT NULL) GROUP BY node),
up AS (SELECT node, parent AS anc FROM links UNION SELECT up.node, l.parent FROM up JOIN links l ON l.node = up.anc),
ring AS (SELECT node FROM up WHERE node = anc),
lost AS (SELECT up.node, min(up.anc) AS root_id FROM up JOIN ring ON ring.node = up.anc GROUP BY up.node),
tree AS (SELECT up.node AS node_id, any_value(up.anc) FILTER (WHERE up.anc NOT IN (SELECT node FROM links)) AS root_id, CAST(count(*) AS INTEGER) AS depth
  FROM up WHERE up.node NOT IN (SELECT node FROM lost) GROUP BY up.node),
found AS (SELECT * FROM tree
  UNION ALL SELECT DISTINCT root_id, root_id, 0 FROM tree
  UNION ALL SELECT node, root_id, CASE WHEN node IN (SELECT node FROM ring) THEN -1 ELSE -2 END FROM lost)"""
_DISTANCE = """, steps AS (SELECT u.anc AS node_id, u.node AS below_id, CAST(b.depth - a.depth AS INTEGER) AS distance
  FROM up u JOIN found b ON b.node_id = u.node JOIN found a ON a.node_id = u.anc WHERE b.depth >= 0)"""
_REFS = f"""refs AS (
  SELECT DISTINCT src_table, row_id, ref_field, {_canon("ref")} AS ref, moment FROM (
    SELECT 'edge_proposals' AS src_table, proposal_id AS row_id, 'from_id' AS ref_field, from_id AS ref, proposed_at AS moment FROM edge_proposals
    UNION ALL SELECT 'edge_proposals', proposal_id, 'to_id', to_id, proposed_at FROM edge_proposals
    UNION ALL SELECT 'edges', seq, 'from_id', from_id, accepted_at FROM edges
    UNION ALL SELECT 'edges', seq, 'to_id', to_id, accepted_at FROM edges) WHERE ref IS NOT NULL),
orphans AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE {_canon("n.id")} = r.ref AND n.accepted_at <= r.moment AND (n.retired_at IS NULL OR n.retired_at > r.moment)))"""

SQL = {
    "p1_found": f"WITH {_LINKS} SELECT node_id, root_id, depth FROM found",
    "p1_closure": f"WITH {_LINKS}{_DISTANCE} SELECT node_id, below_id, distance FROM steps",
    "p1_paths": f"""WITH {_LINKS}{_DISTANCE} SELECT below_id AS node_id, list_append(list(node_id ORDER BY distance DESC), below_id) AS path FROM steps GROUP BY below_id
      UNION ALL SELECT node_id, [node_id] FROM found WHERE depth = 0""",
    "p1_cycles": f"WITH {_LINKS} SELECT root_id AS cycle_id, count(*) FILTER (WHERE depth = -1) AS n_on_cycle, count(*) FILTER (WHERE depth = -2) AS n_below FROM found WHERE depth < 0 GROUP BY root_id",
    "p5_found": f"WITH {_REFS} SELECT src_table, row_id, ref_field FROM orphans",
    "p5_report": f"""WITH {_REFS} SELECT r.src_table, strftime(r.moment, '%Y-%m') AS month, count(*) AS n_references, count(o.row_id) AS n_orphans
      FROM refs r LEFT JOIN orphans o USING (src_table, row_id, ref_field) GROUP BY 1, 2""",
}
