"""The SQL of ``graph_queries`` for an engine of another make."""

from __future__ import annotations

from graftwork.rules import DEFAULT as R
from graftwork.sources import generators as g

_SPACE = r"[\s\x0B\x{85}\p{Z}]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _short(c: str) -> str:
    return f"CASE WHEN length({_trim(c)}) > 80 THEN left({_trim(c)}, 80) || '...' ELSE {_trim(c)} END"


def _uuid(h: str) -> str:
    return rf"regexp_replace({h}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"


def _canon(c: str) -> str:
    bare = rf"replace(regexp_replace(regexp_replace(lower({c}), '^[\s\x{{A0}}{{(\[]*(urn:uuid:)?[\s{{(\[]*', ''), '[\s\x{{A0}}}})\]]*$', ''), '-', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{32}}') THEN {_uuid(bare)} ELSE {c} END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KIND = "CASE regexp_replace(lower(kind), '[^a-z]', '', 'g') WHEN 'concept' THEN 'Concept' WHEN 'learningoutcome' THEN 'LearningOutcome' END"
_RELATION = "CASE regexp_replace(lower(relation), '[^a-z]', '', 'g') WHEN 'prerequisitefor' THEN 'PrerequisiteFor' WHEN 'supports' THEN 'Supports' END"
_TAG_LIST = ", ".join(_q(t) for t in R.allowed_tags)
_KNOWN = f"list_filter(list_transform(tags, lambda t: lower({_trim('t')})), lambda t: t IN ({_TAG_LIST}))"
_FIRSTS = f"list_filter({_KNOWN}, lambda t, i: list_position({_KNOWN}, t) = i)[1:3]"
_TAGS = f"CASE WHEN len({_FIRSTS}) > 0 THEN {_FIRSTS} END"

_NODES = f"""raw AS (SELECT DISTINCT proposal_id, batch_id, pos, {_KIND} AS kind, granularity, level, text, tags FROM node_proposals),
cleaned AS (SELECT *, {_clean("coalesce(text, '')")} AS clean_text FROM raw),
keyed AS (SELECT *, lower(clean_text) AS norm_text, CASE
  WHEN kind IS NULL THEN {_q(R.unknown_kind)}
  WHEN granularity IS NULL OR regexp_replace(lower(granularity), '[^a-z]', '', 'g') <> 'sentence' THEN {_q(R.bad_granularity)}
  WHEN level IS NULL OR level < 0 OR level > 3 THEN {_q(R.bad_level)}
  WHEN clean_text = '' THEN {_q(R.empty_text)}
  WHEN NOT regexp_full_match(clean_text, '[^.!?]*[.!?]') THEN {_q(R.not_a_sentence)}
  WHEN kind = 'LearningOutcome' AND NOT (lower(clean_text) LIKE 'i can %' OR lower(clean_text) LIKE 'students can %') THEN {_q(R.bad_prefix)} END AS static_reason FROM cleaned),
placed AS (SELECT *, row_number() OVER (PARTITION BY static_reason IS NULL, norm_text, batch_id ORDER BY pos) AS k,
  min(batch_id) OVER (PARTITION BY static_reason IS NULL, norm_text) AS first_batch FROM keyed),
decided AS (SELECT p.*, CASE WHEN static_reason IS NOT NULL THEN static_reason WHEN k > 1 THEN {_q(R.node_in_batch)}
  WHEN first_batch < batch_id OR EXISTS (SELECT 1 FROM nodes n WHERE n.norm_text = p.norm_text AND n.batch_id < p.batch_id) THEN {_q(R.node_in_store)} END AS reason FROM placed p),
judged AS (SELECT *, reason IS NULL AS accepted, batch_id * 4294967296 + pos AS seq, CASE WHEN reason IS NULL THEN {_uuid("md5('graph:' || norm_text)")} END AS assigned_id, {_TAGS} AS stored_tags FROM decided),
node_events AS (SELECT seq AS event_seq, CASE WHEN accepted THEN 'NodeAccepted' ELSE 'NodeRejected' END AS event_type, assigned_id AS id, CASE WHEN accepted THEN kind END AS kind,
  CASE WHEN accepted THEN level END AS level, CASE WHEN accepted THEN stored_tags END AS tags,
  CASE WHEN clean_text = '' OR reason IN ({_q(R.bad_granularity)}, {_q(R.bad_level)}, {_q(R.unknown_kind)}) THEN coalesce(text, '') ELSE clean_text END AS text, reason FROM judged)"""

_EDGES = f"""raw_edges AS (SELECT DISTINCT proposal_id, batch_id, pos, batch_id * 4294967296 + pos AS seq, {_RELATION} AS relation, coalesce({_canon("from_id")}, '') AS from_id,
  coalesce({_canon("to_id")}, '') AS to_id, {_trim("coalesce(rationale, '')")} AS rationale FROM edge_proposals),
ranked AS (SELECT *, min(pos) OVER (PARTITION BY batch_id, from_id, to_id, relation) AS first_pos FROM raw_edges),
early AS (SELECT r.*, a.kind AS from_kind, a.level AS from_level, b.kind AS to_kind, b.level AS to_level, CASE
  WHEN r.relation IS NULL THEN {_q(R.unknown_relation)} WHEN r.pos > r.first_pos THEN {_q(R.edge_in_batch)}
  WHEN a.id IS NULL THEN {_q(R.unknown_from)} || r.from_id WHEN b.id IS NULL THEN {_q(R.unknown_to)} || r.to_id
  WHEN r.from_id = r.to_id THEN {_q(R.self_loop)}
  WHEN EXISTS (SELECT 1 FROM edges e WHERE e.from_id = r.from_id AND e.to_id = r.to_id AND e.relation = r.relation) THEN {_q(R.edge_in_store)} END AS early_reason
  FROM ranked r LEFT JOIN nodes a ON a.id = r.from_id AND a.batch_id <= r.batch_id LEFT JOIN nodes b ON b.id = r.to_id AND b.batch_id <= r.batch_id),
late AS (SELECT *, CASE WHEN relation = 'PrerequisiteFor' AND from_kind <> 'Concept' THEN {_q(R.bad_source)}
  WHEN relation = 'PrerequisiteFor' AND from_level > to_level THEN {_q(R.level_falls)} WHEN rationale = '' THEN {_q(R.no_rationale)} END AS late_reason FROM early),
deciding AS (SELECT from_id, to_id, relation, min(seq) AS seq FROM late WHERE early_reason IS NULL AND late_reason IS NULL GROUP BY ALL),
arcs AS (SELECT seq, from_id, to_id FROM deciding WHERE relation = 'PrerequisiteFor' UNION SELECT -1, from_id, to_id FROM edges WHERE relation = 'PrerequisiteFor'),
paths AS (SELECT from_id AS a, to_id AS b FROM arcs UNION SELECT p.a, x.to_id FROM paths p JOIN arcs x ON x.from_id = p.b),
on_cycle AS (SELECT row_number() OVER (ORDER BY seq, from_id, to_id) AS k, seq, from_id AS f, to_id AS t FROM arcs x WHERE EXISTS (SELECT 1 FROM paths p WHERE p.a = x.to_id AND p.b = x.from_id)),
steps AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS seq, CAST([] AS STRUCT(a VARCHAR, b VARCHAR)[]) AS closed, false AS refused
  UNION ALL SELECT e.k, e.seq,
    CASE WHEN e.seq >= 0 AND list_contains(s.closed, struct_pack(a := e.t, b := e.f)) THEN s.closed ELSE list_distinct(list_concat(s.closed, flatten(list_transform(
      list_append(list_transform(list_filter(s.closed, lambda x: x.b = e.f), lambda x: x.a), e.f), lambda l: list_transform(
      list_append(list_transform(list_filter(s.closed, lambda x: x.a = e.t), lambda x: x.b), e.t), lambda r: struct_pack(a := l, b := r)))))) END,
    e.seq >= 0 AND list_contains(s.closed, struct_pack(a := e.t, b := e.f))
  FROM steps s JOIN on_cycle e ON e.k = s.k + 1),
fate AS (SELECT d.*, d.relation = 'PrerequisiteFor' AND d.seq IN (SELECT seq FROM steps WHERE refused) AS refused FROM deciding d),
kept AS (SELECT seq, from_id, to_id FROM arcs WHERE seq NOT IN (SELECT seq FROM steps WHERE refused)),
staged AS (SELECT l.*, CASE WHEN early_reason IS NOT NULL THEN 'early' WHEN l.seq > f.seq AND NOT f.refused THEN 'taken' WHEN l.seq >= f.seq AND f.refused THEN 'cycle'
  WHEN l.seq = f.seq THEN 'accepted' ELSE 'late' END AS stage FROM late l LEFT JOIN fate f USING (from_id, to_id, relation)),
walks AS (SELECT seq, from_id AS goal, to_id AS at_ FROM staged WHERE stage = 'late' AND relation = 'PrerequisiteFor'
  UNION SELECT w.seq, w.goal, k.to_id FROM walks w JOIN kept k ON k.from_id = w.at_ AND k.seq < w.seq),
closing AS (SELECT DISTINCT seq FROM walks WHERE at_ = goal),
edge_judged AS (SELECT s.*, CASE stage WHEN 'early' THEN early_reason WHEN 'taken' THEN {_q(R.edge_in_store)} WHEN 'cycle' THEN {_q(R.cycle)} WHEN 'accepted' THEN NULL
  ELSE CASE WHEN s.seq IN (SELECT seq FROM closing) THEN {_q(R.cycle)} ELSE late_reason END END AS reason, stage = 'accepted' AS accepted FROM staged s),
edge_events AS (SELECT seq AS event_seq, CASE WHEN accepted THEN 'EdgeAccepted' ELSE 'EdgeRejected' END AS event_type, relation, CASE WHEN accepted THEN from_id END AS from_id,
  CASE WHEN accepted THEN to_id END AS to_id, CASE WHEN accepted THEN rationale END AS rationale, reason FROM edge_judged)"""

#: The shortest path that each refused row would have closed, as a number of edges.
_WITNESS = f"""trails AS (SELECT seq, to_id AS at_, from_id AS goal, CAST(0 AS BIGINT) AS n FROM edge_judged WHERE reason = {_q(R.cycle)}
  UNION SELECT w.seq, k.to_id, w.goal, w.n + 1 FROM trails w JOIN kept k ON k.from_id = w.at_ AND k.seq < w.seq WHERE w.n < {{longest}} AND w.at_ <> w.goal)"""
_WITNESSED = "SELECT seq, min(n) AS n_edges, true AS is_path FROM trails WHERE at_ = goal GROUP BY seq"
_FOLDS, _OUTCOME_EVERY = 24, 6


def _folded(c: str) -> str:
    return f"'n' || (CAST('0x' || substr(md5({_canon(c)}), 1, 4) AS BIGINT) % {_FOLDS})"


_FOLDED = f"""folded_proposals AS (SELECT * REPLACE ({_folded("from_id")} AS from_id, {_folded("to_id")} AS to_id) FROM edge_proposals),
folded_nodes AS (SELECT 'n' || k AS id, CASE WHEN k % {_OUTCOME_EVERY} = {_OUTCOME_EVERY - 1} THEN 'LearningOutcome' ELSE 'Concept' END AS kind, 0 AS level, -1 AS batch_id FROM range({_FOLDS}) t(k)),
folded_edges AS (SELECT * FROM edges WHERE false)"""
_FOLDED_EDGES = f"{_FOLDED}, " + _EDGES.replace("FROM edge_proposals)", "FROM folded_proposals)").replace("JOIN nodes ", "JOIN folded_nodes ").replace("FROM edges ", "FROM folded_edges ")

_SHORT_TEXT = _short("text")
_LINES = f"""SELECT event_seq, CASE WHEN event_type = 'NodeAccepted' THEN 'graph/events' ELSE 'graph/nodes_rejected' END AS entity, CASE WHEN event_type = 'NodeAccepted' THEN 'INFO' ELSE 'WARN' END AS level,
  CASE WHEN event_type = 'NodeAccepted' THEN 'ACCEPT node ' || kind || ' lvl ' || level || ' ' || id || ': ' || {_SHORT_TEXT} || CASE WHEN len(tags) > 0 THEN ' tags=[' || array_to_string(tags, ',') || ']' ELSE '' END
  ELSE 'REJECT node ' || {_SHORT_TEXT} || ': ' || reason END AS message FROM node_events
UNION ALL SELECT event_seq, CASE WHEN event_type = 'EdgeAccepted' THEN 'graph/events' ELSE 'graph/edges_rejected' END, CASE WHEN event_type = 'EdgeAccepted' THEN 'INFO' ELSE 'WARN' END,
  CASE WHEN event_type = 'EdgeAccepted' THEN 'ACCEPT edge ' || relation || ' ' || from_id || ' -> ' || to_id || ': ' || {_short("rationale")} ELSE 'REJECT edge ' || coalesce(relation, '?') || ': ' || reason END FROM edge_events"""

_TOP = """counted AS (SELECT n.id, n.text, (SELECT count(*) FROM edges e WHERE e.relation = 'Supports' AND e.to_id = n.id) AS supports FROM nodes n WHERE kind = 'LearningOutcome'),
best AS (SELECT * FROM counted ORDER BY supports DESC, text, id LIMIT 5)"""
_PRE = "SELECT DISTINCT from_id, to_id FROM edges WHERE relation = 'PrerequisiteFor'"
_REACH = f"pre AS ({_PRE}), reach AS (SELECT from_id, to_id FROM pre UNION SELECT r.from_id, p.to_id FROM reach r JOIN pre p ON p.from_id = r.to_id)"
_DAG = "NOT EXISTS (SELECT 1 FROM reach WHERE from_id = to_id)"
_RANK = f"""{_REACH}, ends AS (SELECT from_id AS id FROM pre UNION SELECT to_id FROM pre), ring AS (SELECT from_id AS id FROM reach WHERE from_id = to_id),
lost AS (SELECT id FROM ring UNION SELECT to_id FROM reach WHERE from_id IN (SELECT id FROM ring)), good AS (SELECT id FROM ends WHERE id NOT IN (SELECT id FROM lost)),
deep AS (SELECT id, CAST(0 AS BIGINT) AS n FROM good UNION SELECT p.to_id, d.n + 1 FROM deep d JOIN pre p ON p.from_id = d.id JOIN good ON good.id = p.to_id),
ranks AS (SELECT id, max(n) AS rank FROM deep GROUP BY id UNION ALL SELECT id, NULL FROM lost)"""
_SUMMARY = f"""{_TOP}, {_REACH}, summary AS (SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE kind = 'Concept') AS concepts,
(SELECT count(*) FROM nodes WHERE kind = 'LearningOutcome') AS learning_outcomes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE relation = 'PrerequisiteFor') AS prerequisite_edges,
(SELECT count(*) FROM edges WHERE relation = 'Supports') AS supports_edges, {_DAG} AS prereq_dag_ok,
(SELECT list(struct_pack(id := id, text := text, supports := supports) ORDER BY supports DESC, text, id) FROM best) AS top_learning_outcomes)"""
_ORDERED = "SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY seq, id) - 1 AS ord, text FROM nodes"
_SNAKE = r"lower(regexp_replace(relation, '([a-z])([A-Z])', '\1_\2', 'g'))"
_LABEL = f"replace({_clean("coalesce(rationale, '')")}, '\"', '\\\"')"


def _dot_edges(named: str) -> str:
    return f"""SELECT seq, '  "' || from_id || '" -> "' || to_id || '" [label="' || {_SNAKE} || CASE WHEN {named} THEN ': ' || {_LABEL} ELSE '' END || '"];' AS line FROM edges
  WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)"""


_DOT_NODES = f"""SELECT seq, '  "' || id || '" [label="' || replace({_clean("text")}, '"', '\\"') || '"];' AS line FROM nodes"""
_FIRST_TEN = "seq IN (SELECT seq FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) ORDER BY seq LIMIT 10)"


def _words(words: tuple[str, ...], i: str) -> str:
    return f"([{', '.join(map(_q, words))}])[({i}) % {len(words)} + 1]"


_N_C, _N_O = 1_297, 217
_CONCEPTS = f"""SELECT i AS pos, 'Concept' AS kind, 'Sentence' AS granularity, CAST(i % 4 AS INTEGER) AS level,
  {_words(g.SUBJECTS, "i")} || ' ' || {_words(g.VERBS, "i // 6")} || ' ' || {_words(g.OBJECTS, "i // 36")} || ' to ' || {_words(g.PURPOSES, "i // 216")} || '.' AS text"""
_OUTCOMES = f"""SELECT i + {{first}} AS pos, 'LearningOutcome' AS kind, 'Sentence' AS granularity, CAST(2 + i % 2 AS INTEGER) AS level,
  'I can ' || {_words(g.OUTCOME_VERBS, "i")} || ' ' || {_words(g.OUTCOME_OBJECTS, "i // 6")} || ' ' || {_words(g.OUTCOME_CONTEXTS, "i // 36")} || '.' AS text"""
_GEN_TAGS = [f"[{', '.join(f'([{_TAG_LIST}])[(i + {{first}} + {k}) % 7 + 1]' for k in range(n))}] AS tags" for n in (1, 2)]


def _generated(tags: bool, n_c: int, n_o: int) -> str:
    first = _CONCEPTS + (", " + _GEN_TAGS[0].format(first=0) if tags else "")
    second = _OUTCOMES.format(first=n_c) + (", " + _GEN_TAGS[1].format(first=n_c) if tags else "")
    return f"{first} FROM range({n_c}) t(i) UNION ALL {second} FROM range({n_o}) t(i)"


_LISTS = """c AS (SELECT id, text, row_number() OVER (ORDER BY lower(text), seq) - 1 AS r FROM nodes WHERE kind = 'Concept'),
o AS (SELECT id, text, row_number() OVER (ORDER BY lower(text), seq) - 1 AS r FROM nodes WHERE kind = 'LearningOutcome'),
sup AS (SELECT min(o.r * 3 + k) AS step, c.id AS from_id, o.id AS to_id, any_value(c.text) AS from_text, any_value(o.text) AS to_text FROM o, range(3) t(k) JOIN c ON c.r = (o.r + 2 * k) % (SELECT count(*) FROM c) GROUP BY c.id, o.id),
chain AS (SELECT a.r AS step, a.id AS from_id, b.id AS to_id, a.text AS from_text, b.text AS to_text FROM c a JOIN c b ON b.r = a.r + 1),
links AS (SELECT row_number() OVER (ORDER BY part, step) - 1 AS pos, relation, from_id, to_id, from_text, to_text, verb FROM (
  SELECT 0 AS part, step, 'Supports' AS relation, from_id, to_id, from_text, to_text, ' underpins ' AS verb FROM sup UNION ALL SELECT 1, step, 'PrerequisiteFor', from_id, to_id, from_text, to_text, ' prepares learners for ' FROM chain))"""


def _refused(ctes: str, frame: str, test: str) -> str:
    return f"WITH RECURSIVE {ctes} SELECT proposal_id, batch_id, pos, reason FROM {frame} WHERE {test}"


_NODE_REASONS = {"node_granularity": R.bad_granularity, "node_level": R.bad_level, "node_empty": R.empty_text, "node_sentence": R.not_a_sentence, "node_prefix": R.bad_prefix, "node_batch_dup": R.node_in_batch, "node_store_dup": R.node_in_store}
_EDGE_REASONS = {"edge_batch_dup": R.edge_in_batch, "edge_self_loop": R.self_loop, "edge_exists": R.edge_in_store, "edge_cycle": R.cycle, "edge_kind": R.bad_source, "edge_level": R.level_falls, "edge_rationale": R.no_rationale}

SQL: dict[str, str] = {
    "text_clean": f"SELECT doc_id, {_clean('text')} AS clean_text FROM documents",
    "text_normalize": f"SELECT DISTINCT proposal_id, lower({_clean('text')}) AS norm_text FROM node_proposals",
    "text_single_sentence": f"SELECT DISTINCT proposal_id, regexp_full_match({_clean('text')}, '[^.!?]*[.!?]') AS single FROM node_proposals",
    "text_trim": f"SELECT doc_id, {_trim('text')} AS trimmed FROM documents",
    "text_truncate": f"SELECT doc_id, {_short('text')} AS label FROM documents",
    "tags_sanitize": f"SELECT DISTINCT proposal_id, {_TAGS} AS tags FROM node_proposals",
    "tags_membership": f"SELECT DISTINCT proposal_id, coalesce(list_contains({_TAGS}, 'tests'), false) AS has_tests FROM node_proposals",
    **{name: _refused(_NODES, "judged", f"reason = {_q(reason)}") for name, reason in _NODE_REASONS.items()},
    "node_accept": f"WITH {_NODES} SELECT assigned_id AS id, kind, 'Sentence' AS granularity, level, clean_text AS text, stored_tags AS tags, norm_text, seq, batch_id FROM judged WHERE accepted",
    "node_admission": f"WITH {_NODES} SELECT batch_id, pos, accepted, reason, assigned_id FROM judged",
    "node_ids": f"WITH {_NODES} SELECT DISTINCT norm_text, {_uuid("md5('graph:' || norm_text)")} AS id FROM judged WHERE static_reason IS NULL",
    "decision_counts": f"WITH {_NODES} SELECT count(*) FILTER (WHERE accepted) AS n_accepted, count(*) FILTER (WHERE NOT accepted) AS n_rejected FROM judged",
    "events_nodes": f"WITH {_NODES} SELECT * FROM node_events",
    "event_steps": f"WITH {_NODES} SELECT event_seq, event_type, row_number() OVER (ORDER BY event_seq) - 1 AS step FROM node_events",
    **{name: _refused(_EDGES, "edge_judged", f"reason = {_q(reason)}") for name, reason in _EDGE_REASONS.items()},
    "edge_unknown_from": _refused(_EDGES, "edge_judged", "starts_with(reason, 'unknown from_id ')"),
    "edge_unknown_to": _refused(_EDGES, "edge_judged", "starts_with(reason, 'unknown to_id ')"),
    "edge_accept": f"WITH RECURSIVE {_EDGES} SELECT from_id, to_id, relation, rationale, seq, batch_id FROM edge_judged WHERE accepted",
    "edge_admission": f"WITH RECURSIVE {_EDGES} SELECT batch_id, pos, accepted, reason, CAST(NULL AS VARCHAR) AS assigned_id FROM edge_judged",
    "edge_endpoints": f"""SELECT p.*, a.kind AS from_kind, a.level AS from_level, b.kind AS to_kind, b.level AS to_level FROM (SELECT DISTINCT proposal_id, {_canon("from_id")} AS from_id, {_canon("to_id")} AS to_id FROM edge_proposals) p
      JOIN nodes a ON a.id = p.from_id JOIN nodes b ON b.id = p.to_id""",
    "events_edges": f"WITH RECURSIVE {_EDGES} SELECT * FROM edge_events",
    "event_lines": f"WITH RECURSIVE {_NODES}, {_EDGES} {_LINES}",
    "cycle_witness": f"WITH RECURSIVE {_EDGES}, {_WITNESS.format(longest=1000)} {_WITNESSED}",
    "edge_admission_folded": f"WITH RECURSIVE {_FOLDED_EDGES} SELECT batch_id, pos, accepted, reason FROM edge_judged",
    "edge_cycle_folded": _refused(_FOLDED_EDGES, "edge_judged", f"reason = {_q(R.cycle)}"),
    "edge_kind_folded": _refused(_FOLDED_EDGES, "edge_judged", f"reason = {_q(R.bad_source)}"),
    "cycle_witness_folded": f"WITH RECURSIVE {_FOLDED_EDGES}, {_WITNESS.format(longest=_FOLDS)} {_WITNESSED}",
    "prereq_dag_folded": f"""WITH RECURSIVE {_FOLDED_EDGES}, asked AS (SELECT DISTINCT 'proposed' AS links, from_id, to_id FROM raw_edges WHERE relation = 'PrerequisiteFor'
      UNION SELECT 'admitted', from_id, to_id FROM edge_judged WHERE accepted AND relation = 'PrerequisiteFor'),
      ways AS (SELECT links, from_id, to_id FROM asked UNION SELECT w.links, w.from_id, a.to_id FROM ways w JOIN asked a ON a.links = w.links AND a.from_id = w.to_id)
      SELECT links, NOT EXISTS (SELECT 1 FROM ways w WHERE w.links = l.links AND w.from_id = w.to_id) AS prereq_dag_ok FROM (VALUES ('proposed'), ('admitted')) l(links)""",
    "reachable_pairs": f"""WITH RECURSIVE {_REACH}, pairs AS (SELECT a.from_id, b.to_id FROM edges a JOIN edges b ON b.from_id = a.to_id UNION SELECT to_id, from_id FROM edges)
      SELECT p.from_id, p.to_id, r.from_id IS NOT NULL AS reaches FROM pairs p LEFT JOIN reach r ON r.from_id = p.from_id AND r.to_id = p.to_id""",
    "inventory": "SELECT seq, id, kind, level, text, tags FROM nodes",
    "inventory_json": "SELECT seq, CAST(to_json(struct_pack(id := id, kind := kind, level := level, text := text, tags := tags)) AS VARCHAR) AS item FROM nodes",
    "summary_nodes": "SELECT count(*) AS total_nodes, count(*) FILTER (WHERE kind = 'Concept') AS concepts, count(*) FILTER (WHERE kind = 'LearningOutcome') AS learning_outcomes FROM nodes",
    "summary_edges": "SELECT count(*) AS total_edges, count(*) FILTER (WHERE relation = 'PrerequisiteFor') AS prerequisite_edges, count(*) FILTER (WHERE relation = 'Supports') AS supports_edges FROM edges",
    "support_counts": "SELECT to_id AS id, count(*) AS supports FROM edges WHERE relation = 'Supports' GROUP BY to_id",
    "top_outcomes": f"WITH {_TOP} SELECT id, text, supports FROM best",
    "graph_summary": f"WITH RECURSIVE {_SUMMARY} SELECT * REPLACE (CAST(to_json(top_learning_outcomes) AS VARCHAR) AS top_learning_outcomes) FROM summary",
    "summary_lines": f"WITH {_TOP} SELECT id, 'LO ' || id || ' (' || supports || ' supports): ' || text AS message FROM best",
    "degree_stats": """SELECT round((SELECT count(*) FROM edges WHERE to_id IN (SELECT id FROM nodes)) / (SELECT count(*) FROM nodes), 6) AS avg_in_degree,
      round((SELECT count(*) FROM edges WHERE from_id IN (SELECT id FROM nodes)) / (SELECT count(*) FROM nodes), 6) AS avg_out_degree""",
    "report_lines": f"""WITH RECURSIVE {_SUMMARY} SELECT CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT list_concat([
      'Nodes: ' || total_nodes || ' (concept=' || concepts || ', learning_outcome=' || learning_outcomes || ')', 'Edges: ' || total_edges || ' (prerequisite_for=' || prerequisite_edges || ', supports=' || supports_edges || ')',
      'Prerequisite DAG: ' || CASE WHEN prereq_dag_ok THEN 'OK' ELSE 'Cycle detected' END] || CASE WHEN len(top_learning_outcomes) > 0 THEN ['Top learning outcomes by incoming supports:'] ELSE [] END,
      list_transform(top_learning_outcomes, lambda x: '  ' || x.id || ' (' || x.supports || ' supports) - ' || x.text)) AS l FROM summary))""",
    "layout_order": f"SELECT id, level, ord FROM ({_ORDERED})",
    "layout_nodes": f"SELECT id, level, ord, {_SHORT_TEXT} AS label FROM ({_ORDERED})",
    "layout_edges_directed": _PRE,
    "layout_edges_undirected": _PRE.replace("PrerequisiteFor", "Supports"),
    "dot_nodes": _DOT_NODES,
    "dot_edges": _dot_edges(f"{_LABEL} <> ''"),
    "dot_edges_first_labels": _dot_edges(f"{_LABEL} <> '' AND {_FIRST_TEN}"),
    "dot_lines": f"SELECT 0 AS section, 0 AS seq, 'digraph learning_graph {{' AS line UNION ALL SELECT 1, * FROM ({_DOT_NODES}) UNION ALL SELECT 2, * FROM ({_dot_edges(f"{_LABEL} <> ''")}) UNION ALL SELECT 3, 0, '}}'",
    "reachability": f"WITH RECURSIVE {_REACH} SELECT from_id, to_id FROM reach",
    "prereq_dag_ok": f"WITH RECURSIVE {_REACH} SELECT {_DAG} AS prereq_dag_ok",
    "prereq_rank": f"WITH RECURSIVE {_RANK} SELECT id, rank FROM ranks",
    "learning_path": f"WITH RECURSIVE {_RANK} SELECT n.id, r.rank, n.seq FROM ranks r JOIN nodes n ON n.id = r.id WHERE r.rank IS NOT NULL ORDER BY r.rank, n.seq LIMIT 10",
    "gen_concepts": f"{_CONCEPTS} FROM range({_N_C}) t(i)",
    "gen_outcomes": f"{_OUTCOMES.format(first=_N_C)} FROM range({_N_O}) t(i)",
    "gen_tags": f"SELECT pos, tags FROM ({_generated(True, _N_C, _N_O)})",
    "gen_all": _generated(True, _N_C, _N_O),
    "gen_supports": f"WITH {_LISTS} SELECT step, from_id, to_id FROM sup",
    "gen_prereq_chain": f"WITH {_LISTS} SELECT step, from_id, to_id FROM chain",
    "gen_rationale": f"WITH {_LISTS} SELECT relation, from_id, to_id, {_short('from_text')} || verb || {_short('to_text')} AS rationale FROM links",
    "gen_edge_cap": f"WITH {_LISTS} SELECT pos, relation, from_id, to_id FROM links WHERE pos < 40",
    "src_default_counts": f"SELECT kind, count(*) AS n, count(DISTINCT text) AS n_texts FROM ({_generated(False, 25, 5)}) GROUP BY kind",
    "json_nodes": f"""SELECT payload_id, body ->> '$.kind' AS kind, body ->> '$.granularity' AS granularity, CAST(body ->> '$.level' AS INTEGER) AS level, body ->> '$.text' AS text, CAST(body -> '$.tags' AS VARCHAR[]) AS tags
      FROM node_payloads WHERE json_valid(body) AND ({_KIND.replace("kind)", "body ->> '$.kind')")}) IS NOT NULL AND body ->> '$.granularity' IS NOT NULL AND body ->> '$.text' IS NOT NULL AND try_cast(body ->> '$.level' AS INTEGER) BETWEEN 0 AND 255""",
    "json_edges": f"""SELECT DISTINCT proposal_id, relation, from_id, to_id, rationale FROM edge_proposals WHERE ({_RELATION}) IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL AND rationale IS NOT NULL""",
}
