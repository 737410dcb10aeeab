"""SQL of the similarity problems: exact, by a join on the rarest words. Two alike texts share at least two of each one's rarest few."""

from __future__ import annotations

_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
_LETTERS = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def texts(name: str, sources: str) -> str:
    """CTEs over ``sources`` (side, id, text): name_t has the texts with words w and letters l, name_p the rarest words of each set of words."""
    return f"""{name}_s AS ({sources}), {name}_t AS (SELECT side, id, {_LETTERS.format("text")} AS l, {_WORDS.format("text")} AS w FROM {name}_s WHERE text IS NOT NULL),
{name}_w AS (SELECT w, row_number() OVER (ORDER BY w) AS s FROM (SELECT DISTINCT list_sort(w) AS w FROM {name}_t WHERE len(w) >= 8)),
{name}_x AS (SELECT s, len(w) AS m, unnest(w) AS x FROM {name}_w), {name}_df AS (SELECT x, count(*) AS n FROM {name}_x GROUP BY x),
{name}_r AS (SELECT s, m, x, row_number() OVER (PARTITION BY s ORDER BY n, x) AS k FROM {name}_x JOIN {name}_df USING (x)),
{name}_p AS (SELECT s, m, x FROM {name}_r WHERE k <= m - ceil(0.7 * m - 1e-9) + 2),
{name}_c AS (SELECT a.s AS sa, b.s AS sb FROM {name}_p a JOIN {name}_p b USING (x) WHERE a.s < b.s AND 10 * least(a.m, b.m) >= 7 * greatest(a.m, b.m) GROUP BY 1, 2 HAVING count(*) >= 2),
{name}_o AS (SELECT sa, sb, u.w AS wa, v.w AS wb, len(list_intersect(u.w, v.w)) AS o FROM {name}_c JOIN {name}_w u ON u.s = sa JOIN {name}_w v ON v.s = sb),
{name}_a AS (SELECT wa, wb FROM {name}_o WHERE 10 * o >= 7 * (len(wa) + len(wb) - o) UNION ALL SELECT w, w FROM {name}_w)"""


def near(name: str) -> str:
    """Pairs of ids that are alike and not the same letters."""
    return f"""SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM {name}_a a JOIN {name}_t x ON list_sort(x.w) = a.wa JOIN {name}_t y ON list_sort(y.w) = a.wb WHERE x.id <> y.id AND x.l <> y.l"""


SQL = {
    "p2_found": f"""WITH {texts("n", "SELECT DISTINCT 0 AS side, proposal_id AS id, text FROM node_proposals")}, {texts("e", "SELECT DISTINCT 0 AS side, proposal_id AS id, rationale AS text FROM edge_proposals")}
      SELECT 'node_proposals' AS src_table, * FROM ({near("n")}) UNION ALL SELECT 'edge_proposals', * FROM ({near("e")})""",
    "p4_found": f"""WITH {texts("m", "SELECT DISTINCT 0 AS side, CAST(proposal_id AS VARCHAR) AS id, text FROM node_proposals UNION ALL SELECT 1, id, text FROM nodes")},
      pairs AS (SELECT x.id AS p, y.id AS n FROM m_t x JOIN m_t y ON x.l = y.l AND x.l <> '' WHERE x.side = 0 AND y.side = 1
        UNION SELECT x.id, y.id FROM m_a a JOIN m_t x ON list_sort(x.w) = a.wa JOIN m_t y ON list_sort(y.w) = a.wb WHERE x.side = 0 AND y.side = 1
        UNION SELECT x.id, y.id FROM m_a a JOIN m_t x ON list_sort(x.w) = a.wb JOIN m_t y ON list_sort(y.w) = a.wa WHERE x.side = 0 AND y.side = 1)
      SELECT DISTINCT q.proposal_id, n.id AS node_id FROM pairs JOIN node_proposals q ON CAST(q.proposal_id AS VARCHAR) = pairs.p JOIN nodes n ON n.id = pairs.n WHERE n.batch_id < q.batch_id""",
}
