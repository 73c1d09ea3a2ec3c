"""DuckDB SQL giving the expected result of each registered query over the same tables."""

from __future__ import annotations

#: The fixture graph as common table expressions; every oracle starts from these.
GRAPH = """
entities AS (
  SELECT 'main' graph_id, 'region:'||r_regionkey id, r_name AS name, 'region' entity_type,
         '' description, '{}' properties, epoch_ms(1704067200000) + to_seconds(r_regionkey) updated_at
  FROM region
  UNION ALL SELECT 'main', 'nation:'||n_nationkey, n_name, 'nation', '', '{}',
         epoch_ms(1704067200000) + to_seconds(n_nationkey) FROM nation
  UNION ALL SELECT 'main', 'customer:'||c_custkey, c_name, 'customer', c_mktsegment,
         '{"acctbal":'||c_acctbal||'}', epoch_ms(1704067200000) + to_seconds(c_custkey) FROM customer
  UNION ALL SELECT 'main', 'supplier:'||s_suppkey, s_name, 'supplier', '',
         '{"acctbal":'||s_acctbal||'}', epoch_ms(1704067200000) + to_seconds(s_suppkey) FROM supplier
  UNION ALL SELECT 'main', 'part:'||p_partkey, p_name||' #'||p_partkey, 'part', p_brand||' '||p_type,
         '{"size":'||p_size||'}', epoch_ms(1704067200000) + to_seconds(p_partkey) FROM part
  UNION ALL SELECT 'main', 'order:'||o_orderkey, 'Order#'||o_orderkey, 'order', o_orderpriority,
         '{}', o_orderdate FROM orders
  UNION ALL SELECT DISTINCT 'text', 'source:'||source, source, 'source', '', '{}',
         epoch_ms(1704067200000) FROM documents
  UNION ALL SELECT DISTINCT 'text', 'conversation:'||conv_id, 'Conversation '||conv_id,
         'conversation', '', '{}', epoch_ms(1704067200000) + to_seconds(conv_id) FROM conversations
  UNION ALL SELECT DISTINCT 'text', 'user:'||user_id, 'User '||user_id, 'user', '', '{}',
         epoch_ms(1704067200000) + to_seconds(user_id) FROM events
),
rel_rows AS (
  SELECT 'nation:'||n_nationkey source_id, 'region:'||n_regionkey target_id,
         'in_region' relationship_type, 1.0::double weight, epoch_ms(1704067200000) updated_at FROM nation
  UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey, 'in_nation', 1.0,
         epoch_ms(1704067200000) FROM customer
  UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'in_nation', 1.0,
         epoch_ms(1704067200000) FROM supplier
  UNION ALL SELECT 'customer:'||o_custkey, 'order:'||o_orderkey, 'placed', 1.0, o_orderdate FROM orders
  UNION ALL SELECT 'order:'||l_orderkey, 'part:'||l_partkey, 'contains', max(l_quantity)/50,
         epoch_ms(1704067200000) + to_seconds(l_orderkey) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'supplier:'||l_suppkey, 'part:'||l_partkey, 'supplies', 1 - max(l_discount),
         epoch_ms(1704067200000) + to_seconds(l_partkey) FROM lineitem GROUP BY l_suppkey, l_partkey
),
relationships AS (
  SELECT 'main' graph_id, source_id||'>'||relationship_type||'>'||target_id id, rel_rows.* FROM rel_rows
),
observations AS (
  SELECT 'text' graph_id, 'doc:'||doc_id id, 'source:'||source entity_id, text AS content,
         lang AS source, epoch_ms(1704067200000) + to_seconds(doc_id) created_at FROM documents
  UNION ALL SELECT 'text', 'turn:'||conv_id||':'||turn, 'conversation:'||conv_id, text, role,
         epoch_ms(1704067200000) + to_seconds(turn) FROM conversations
  UNION ALL SELECT 'text', 'event:'||event_id, 'user:'||user_id, event_type||' '||value, 'events', ts
  FROM events
)
"""


def q(body: str, *ctes: str, recursive: bool = False) -> str:
    """A query over the graph tables, with further common table expressions in order."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([GRAPH.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


#: Columns shown for an entity or an edge page.
NOCASE = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ENDS = """
ends AS (SELECT source_id id FROM relationships UNION ALL SELECT target_id FROM relationships),
degree_of AS (
  SELECT e.id, e.name, e.entity_type, coalesce(d.degree, 0) AS degree
  FROM entities e LEFT JOIN (SELECT id, count(*) degree FROM ends GROUP BY id) d USING (id)
)
"""

PAIRS = """
pairs AS (
  SELECT DISTINCT least(source_id, target_id) a, greatest(source_id, target_id) b FROM relationships
),
simple_degree AS (
  SELECT e.id, e.name, coalesce(d.degree, 0) AS degree FROM entities e LEFT JOIN (
    SELECT id, count(*) degree FROM (SELECT a id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id
  ) d USING (id)
)
"""

AUDIT = """
rel_n AS (
  SELECT id, count(*) n FROM (
    SELECT source_id id FROM relationships
    UNION ALL SELECT target_id FROM relationships WHERE source_id <> target_id
  ) GROUP BY id
),
obs_n AS (SELECT entity_id id, count(*) n FROM observations GROUP BY entity_id),
flags AS (
  SELECT e.graph_id, e.id, e.name, e.entity_type, coalesce(r.n, 0) rel_count, coalesce(o.n, 0) obs_count,
         coalesce(r.n, 0) = 0 disconnected, trim(e.description) = '' missing_description,
         coalesce(o.n, 0) = 0 missing_observations, e.properties = '{}' empty_properties,
         coalesce(r.n, 0) = 1 low_connection
  FROM entities e LEFT JOIN rel_n r USING (id) LEFT JOIN obs_n o USING (id)
)
"""

COUNT_ROWS = """
count_rows AS (
  SELECT 'entities' "table", count(*) n FROM entities
  UNION ALL SELECT 'relationships', count(*) FROM relationships
  UNION ALL SELECT 'observations', count(*) FROM observations
)
"""

TYPES = """
etypes AS (SELECT entity_type k, count(*) n FROM entities GROUP BY 1),
rtypes AS (SELECT relationship_type k, count(*) n FROM relationships GROUP BY 1)
"""

SUMMARY_HEAD = """
SELECT 'counts' section, row_number() OVER (ORDER BY "table")::int rank, "table" AS key, n::varchar AS value
FROM count_rows
UNION ALL SELECT * FROM (SELECT 'entity_types', row_number() OVER (ORDER BY n DESC, k)::int r, k, n::varchar
  FROM etypes) WHERE r <= 10
"""

TOUCHING = """
touching AS (
  SELECT source_id entity_id, 'outgoing' direction, r.* FROM relationships r
  UNION ALL SELECT target_id, 'incoming', r.* FROM relationships r WHERE source_id <> target_id
)
"""

UNDESCRIBED = """
undescribed AS (SELECT * FROM entities WHERE coalesce(description, '') = ''),
hot AS (
  SELECT e.id, e.name, count(*) n FROM entities e JOIN observations o ON o.entity_id = e.id
  GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 5
),
metrics AS (
  SELECT (SELECT count(*) FROM entities) e, (SELECT count(*) FROM observations) o,
         (SELECT count(*) FROM undescribed) u, (SELECT max_by(name, n) FROM (SELECT * FROM hot LIMIT 1)) hn,
         (SELECT max(n) FROM hot) hc
),
acts AS (
  SELECT 1 o, 'prune_entities' k, e::varchar v FROM metrics WHERE e > 500
  UNION ALL SELECT 2, 'compact_observations', hn||'='||hc FROM metrics WHERE hc > 15
  UNION ALL SELECT 3, 'add_descriptions', u::varchar FROM metrics WHERE u > 0
  UNION ALL SELECT 4, 'consolidate_observations', printf('%.1f', o::double / e) FROM metrics WHERE o::double / e > 10
  UNION ALL SELECT 5, 'describe_many', printf('%.1f', 100 * (u::double / e)) FROM metrics WHERE u::double / e > 0.1
)
"""

NAMES_ASKED = """
asked AS (
  SELECT 'p'||p_partkey request_id, p_name||' #'||p_partkey AS name, 'part' entity_type FROM part
  UNION ALL SELECT 'c'||c_custkey, upper(c_name), NULL FROM customer
  UNION ALL SELECT 'n'||p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 's'||s_suppkey, s_name, 'customer' FROM supplier
)
"""

ORACLES: dict[str, str] = {
    "most_connected": q("SELECT id, name, entity_type, degree FROM degree_of ORDER BY degree DESC, name, id LIMIT 10", ENDS),
    "degrees": q("SELECT id, degree FROM degree_of", ENDS),
    "undirected_degrees": q("SELECT id, degree FROM simple_degree", PAIRS),
    "neighbours": q("SELECT a AS id, b AS neighbour_id FROM pairs UNION ALL SELECT b, a FROM pairs WHERE a <> b", PAIRS),
    "graph_density": q(
        """SELECT count(*) nodes, (sum(degree) // 2)::bigint edges, max(degree) max_degree,
           round((sum(degree) / 2) / (count(*)::double * (count(*) - 1) / 2), 9) density FROM simple_degree""",
        PAIRS,
    ),
    "graph_counts": q('SELECT "table", n FROM count_rows', COUNT_ROWS),
    "observation_counts": q("SELECT entity_id, count(*) observation_count FROM observations GROUP BY 1"),
    "graph_catalog": q(
        """SELECT graph_id, sum(e)::bigint entities, sum(r)::bigint relationships, sum(o)::bigint observations FROM (
             SELECT graph_id, 1 e, 0 r, 0 o FROM entities UNION ALL SELECT graph_id, 0, 1, 0 FROM relationships
             UNION ALL SELECT graph_id, 0, 0, 1 FROM observations) GROUP BY 1"""
    ),
    "select_graph": q("SELECT id, name FROM entities WHERE graph_id = 'text'"),
    "drop_graph": q("SELECT id, name FROM entities WHERE graph_id <> 'text'"),
    "valid_graph_ids": """
        SELECT url AS graph_id, regexp_full_match(url, '[A-Za-z0-9_-]+') AND length(url) <= 64 AND url <> 'graph' AS valid FROM pages
        UNION ALL SELECT DISTINCT source, regexp_full_match(source, '[A-Za-z0-9_-]+') AND length(source) <= 64
          AND source <> 'graph' FROM documents""",
    "graph_sql": q(
        """SELECT e.entity_type, r.relationship_type, count(*) n, round(avg(r.weight), 6) avg_weight
           FROM entities e JOIN relationships r ON r.source_id = e.id WHERE r.weight >= 0.5 GROUP BY 1, 2"""
    ),
    "type_distribution": q("SELECT entity_type, count(*) n FROM entities GROUP BY 1"),
    "relationship_types": q("SELECT relationship_type, count(*) n FROM relationships GROUP BY 1"),
    "entities_by_type": q(
        "SELECT entity_type, name, id, count(*) OVER (PARTITION BY entity_type) type_size FROM entities"
    ),
    "recent_entities": q(
        "SELECT id, name, epoch(updated_at)::bigint updated FROM entities ORDER BY updated_at DESC, id LIMIT 10"
    ),
    "graph_summary": q(
        SUMMARY_HEAD
        + """UNION ALL SELECT * FROM (SELECT 'relationship_types', row_number() OVER (ORDER BY n DESC, k)::int r, k, n::varchar
               FROM rtypes) WHERE r <= 10
             UNION ALL SELECT * FROM (SELECT 'most_connected', row_number() OVER (ORDER BY degree DESC, name, id)::int r, id, degree::varchar
               FROM degree_of) WHERE r <= 10
             UNION ALL SELECT * FROM (SELECT 'recent', row_number() OVER (ORDER BY updated_at DESC, id)::int r, id, name
               FROM entities) WHERE r <= 10""",
        COUNT_ROWS, TYPES, ENDS,
    ),
    "graph_health": q(
        SUMMARY_HEAD
        + """UNION ALL SELECT 'hotspots', row_number() OVER (ORDER BY n DESC, id)::int, id, n::varchar FROM hot
             UNION ALL SELECT * FROM (SELECT 'missing_descriptions', row_number() OVER (ORDER BY updated_at DESC, id)::int r, id, name
               FROM undescribed) WHERE r <= 10
             UNION ALL SELECT 'missing_description_count', 1, 'n', u::varchar FROM metrics
             UNION ALL SELECT 'actions', row_number() OVER (ORDER BY o)::int, k, v FROM acts""",
        COUNT_ROWS, TYPES, UNDESCRIBED,
    ),
    "audit_entities": q("SELECT * FROM flags", AUDIT),
    "audit_summary": q(
        """SELECT count(*) scanned, sum(disconnected::int)::bigint disconnected,
             sum(missing_description::int)::bigint missing_description,
             sum(missing_observations::int)::bigint missing_observations,
             sum(empty_properties::int)::bigint empty_properties, sum(low_connection::int)::bigint low_connection,
             round(100 * (1 - sum(disconnected::int + missing_description::int + missing_observations::int
               + empty_properties::int)::double / (count(*) * 4)), 1) quality_score FROM flags""",
        AUDIT,
    ),
    "audit_offenders": q(
        """SELECT *, count(*) OVER (PARTITION BY category) total FROM (
             SELECT 'disconnected' category, id, name, entity_type FROM flags WHERE disconnected
             UNION ALL SELECT 'missing_description', id, name, entity_type FROM flags WHERE missing_description
             UNION ALL SELECT 'missing_observations', id, name, entity_type FROM flags WHERE missing_observations
             UNION ALL SELECT 'empty_properties', id, name, entity_type FROM flags WHERE empty_properties
             UNION ALL SELECT 'low_connection', id, name, entity_type FROM flags WHERE low_connection)
           QUALIFY row_number() OVER (PARTITION BY category ORDER BY entity_type, name, id) <= 30""",
        AUDIT,
    ),
    "ambiguous_names": q(
        """SELECT folded_name, count(*) n, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) entity_types
           FROM (SELECT lower(p_name) folded_name, 'part' entity_type FROM part
                 UNION ALL SELECT lower(name), entity_type FROM entities WHERE entity_type <> 'part')
           GROUP BY 1 HAVING count(*) > 1"""
    ),
    "duplicate_keys": q(
        """SELECT 'entities' "table", lower(p_name) key1, 'part' key2, count(*) n FROM part GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'relationships', 'order:'||l_orderkey||'|part:'||l_partkey, 'contains', count(*)
           FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1"""
    ),
    "orphans": """
        SELECT 'relationships' "table", 'order:'||o_orderkey||'>placed>' AS edge, 'source_id' "column", 'customer:'||o_custkey missing_id
        FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        UNION ALL SELECT 'observations', 'doc:'||doc_id, 'entity_id', 'label:'||doc_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "list_entities": q(
        """SELECT id, name, description, epoch(updated_at)::bigint updated, (SELECT count(*) FROM entities WHERE entity_type = 'customer') total
           FROM entities WHERE entity_type = 'customer' ORDER BY updated_at DESC, id LIMIT 50 OFFSET 100"""
    ),
    "list_relationships": q(
        """SELECT id, source_name, target_name, weight, total FROM (
             SELECT r.id, s.name source_name, t.name target_name, r.weight, count(*) OVER () total,
               row_number() OVER (ORDER BY r.updated_at DESC, r.id) place
             FROM relationships r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id
             WHERE r.relationship_type = 'placed') listed
           WHERE place <= 100"""
    ),
    "list_relationships_scoped": q(
        """SELECT id, source_name, target_name, weight, total FROM (
             SELECT r.id, s.name source_name, t.name target_name, round(r.weight, 6) weight, count(*) OVER () total,
               row_number() OVER (ORDER BY r.weight DESC, r.updated_at DESC, r.id) place
             FROM touching r JOIN entities e ON e.id = r.entity_id
             JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id
             WHERE e.entity_type = 'nation') listed
           WHERE place <= 100""",
        TOUCHING,
    ),
    "graph_view_nodes": q(
        """SELECT id, name, total_entities, total_relationships, left_out FROM (
             SELECT id, name, (SELECT count(*) FROM entities) total_entities, (SELECT count(*) FROM relationships) total_relationships,
               greatest((SELECT count(*) FROM entities WHERE entity_type IN ('order', 'customer')) - 500, 0) left_out
             FROM entities WHERE entity_type IN ('order', 'customer') ORDER BY updated_at DESC, id LIMIT 500)"""
    ),
    "graph_view_edges": q(
        """SELECT r.id, s.name source_name, t.name target_name, r.relationship_type FROM relationships r
           JOIN shown s ON s.id = r.source_id JOIN shown t ON t.id = r.target_id""",
        """shown AS (SELECT * FROM entities WHERE entity_type IN ('nation', 'region', 'supplier')
           ORDER BY updated_at DESC, id LIMIT 5000)""",
    ),
    "name_contains": q(
        "SELECT id, name, entity_type FROM entities WHERE contains(lower(name), '#1') OR contains(lower(entity_type), '#1')"
    ),
    "with_names": q(
        """SELECT r.id, s.name source_name, s.entity_type source_type, t.name target_name, t.entity_type target_type
           FROM relationships r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id"""
    ),
    "relationships_of": q(
        """SELECT r.entity_id, r.direction, r.id, s.name source_name, t.name target_name, round(r.weight, 6) weight
           FROM touching r JOIN entities e ON e.id = r.entity_id AND e.entity_type = 'supplier'
           JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id""",
        TOUCHING,
    ),
    "induced_edges": q(
        """SELECT r.id FROM relationships r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id
           WHERE s.entity_type IN ('supplier', 'part') AND t.entity_type IN ('supplier', 'part')"""
    ),
    "lookup_edges": q(
        """SELECT r.id, round(r.weight, 6) weight FROM relationships r
           WHERE r.relationship_type = 'contains' AND (r.source_id, r.target_id) IN (
             SELECT 'order:'||l_orderkey, 'part:'||l_partkey FROM lineitem WHERE l_returnflag = 'R')"""
    ),
    "observations_of": q(
        """SELECT o.id, o.entity_id, e.name entity_name, e.entity_type,
             count(*) OVER (PARTITION BY o.entity_id) total FROM observations o JOIN entities e ON e.id = o.entity_id
           QUALIFY row_number() OVER (PARTITION BY o.entity_id ORDER BY o.created_at DESC, o.id) <= 20"""
    ),
    "resolve_names": q(
        f"""SELECT a.request_id, c.id entity_id, coalesce(c.n, 0)::bigint match_count,
              CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.n > 1 THEN 'ambiguous' ELSE 'ok' END status
            FROM asked a LEFT JOIN (
              SELECT a.request_id, e.id, count(*) OVER (PARTITION BY a.request_id) n,
                row_number() OVER (PARTITION BY a.request_id ORDER BY
                  CASE WHEN e.name = a.name AND e.entity_type = a.entity_type THEN 0 WHEN e.name = a.name THEN 1 ELSE 2 END,
                  e.updated_at DESC, e.id) rn
              FROM asked a JOIN entities e ON {NOCASE.format('e.name')} = {NOCASE.format('a.name')}
            ) c ON c.request_id = a.request_id AND c.rn = 1""",
        NAMES_ASKED,
    ),
    "entity_profiles": q(
        """SELECT e.id entity_id, coalesce(r.n, 0) relationship_count, coalesce(o.n, 0) observation_count,
             coalesce(r.n, 0) > 50 relationships_truncated, coalesce(o.n, 0) > 50 observations_truncated,
             least(coalesce(r.n, 0), 50)::int edges_shown, least(coalesce(o.n, 0), 50)::int observations_shown,
             (SELECT max_by(t.id, -t.rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id) rn
                FROM observations) t WHERE t.entity_id = e.id AND rn = 1) newest_observation
           FROM entities e LEFT JOIN rel_n r USING (id) LEFT JOIN obs_n o USING (id)
           WHERE e.entity_type IN ('source', 'conversation', 'supplier', 'nation')""",
        AUDIT,
    ),
    "validate_entities": """
        SELECT 'accepted' AS outcome, trim(p_name) AS name, lower(p_type) entity_type, NULL AS reason FROM part WHERE p_size > 10
        UNION ALL SELECT 'rejected', '', lower(p_type), 'name is empty' FROM part WHERE p_size <= 10
        UNION ALL SELECT 'rejected', c_name, '', 'entity_type is empty' FROM customer""",
    "validate_relationships": """
        SELECT 'accepted' AS outcome, 'order:'||l_orderkey AS source_id, round(l_quantity / 40, 6) AS weight, NULL AS reason
        FROM lineitem WHERE l_quantity <= 40
        UNION ALL SELECT 'rejected', 'order:'||l_orderkey, round(l_quantity / 40, 6), 'weight is outside [0, 1]'
        FROM lineitem WHERE l_quantity > 40""",
    "validate_observations": r"""
        SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, id, reason, length(content)::int AS chars FROM (
          SELECT 'page:'||page_id id, CASE WHEN contains(url, '/fr/') THEN '' ELSE regexp_replace(html, '^\s+|\s+$', '', 'g') END content,
            CASE WHEN contains(url, '/fr/') THEN 'content is empty' END reason FROM pages)""",
    "embedding_text": q(
        "SELECT id, name||' ('||entity_type||')'||CASE WHEN description = '' THEN '' ELSE ' '||description END AS text FROM entities"
    ),
    "property_values": q(
        """SELECT id, (properties->>'acctbal')::double acctbal, (properties->>'size')::double size, properties <> '{}' has_properties
           FROM entities"""
    ),
    "screen_batch": q(
        """SELECT name, entity_type, description = '' missing_description, id NOT IN (SELECT entity_id FROM observations) missing_observations
           FROM entities WHERE description = '' OR id NOT IN (SELECT entity_id FROM observations)"""
    ),
}

# --- traversal ------------------------------------------------------------------------------

STEPS = """
steps AS (
  SELECT source_id from_id, target_id to_id, relationship_type, 'outgoing' direction FROM relationships WHERE source_id <> target_id
  UNION ALL SELECT target_id, source_id, relationship_type, 'incoming' FROM relationships WHERE source_id <> target_id
)
"""


def reach(hops: int, seeds: str, steps: str = "steps") -> str:
    """Levels by recursion over distinct (query, node, depth) rows."""
    return f"""
links AS (SELECT DISTINCT from_id, to_id FROM {steps}),
walk(query_id, id, depth) AS (
  SELECT query_id, id, 0 FROM ({seeds})
  UNION SELECT w.query_id, l.to_id, w.depth + 1 FROM walk w JOIN links l ON l.from_id = w.id WHERE w.depth < {hops}
),
reached AS (SELECT query_id, id, min(depth) depth FROM walk GROUP BY query_id, id)
"""


USERS = """
  SELECT 'User '||user_id AS name, {1} * observation_count AS observation_count, description FROM (
    SELECT user_id, count(*) observation_count FROM events GROUP BY 1) JOIN (
    SELECT user_id, list_reduce(list(event_type ORDER BY {0}),
      lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a||chr(10)||x END) description FROM events GROUP BY 1) USING (user_id)
"""

REGIONS = "SELECT 'regions' query_id, id FROM entities WHERE entity_type = 'region'"
OWN = "SELECT id query_id, id FROM entities WHERE entity_type = '{0}'"

PARENTS = """
parents AS (
  SELECT c.query_id, c.id, c.depth, p.id parent_id, s.relationship_type, s.direction
  FROM reached c JOIN steps s ON s.to_id = c.id
  JOIN reached p ON p.query_id = c.query_id AND p.id = s.from_id AND p.depth = c.depth - 1
)
"""

ORACLES |= {
    "bfs_depths": q("SELECT id, depth FROM reached", STEPS, reach(4, REGIONS), recursive=True),
    "bfs_outgoing": q(
        "SELECT query_id, id, depth FROM reached",
        """some_steps AS (SELECT target_id from_id, source_id to_id FROM relationships
           WHERE relationship_type IN ('in_nation', 'placed', 'supplies'))""",
        reach(3, OWN.format("nation"), "some_steps"),
        recursive=True,
    ),
    "bfs_hubs": q(
        "SELECT query_id, id, depth FROM reached",
        ENDS, STEPS, reach(2, "SELECT id query_id, id FROM degree_of ORDER BY degree DESC, name, id LIMIT 10"), recursive=True,
    ),
    "bfs_budget": q(
        """SELECT query_id, least(count(*), 200)::bigint visited, count(*) > 200 truncated FROM reached GROUP BY query_id""",
        STEPS, reach(2, OWN.format("supplier")), recursive=True,
    ),
    "find_connections": q(
        "SELECT r.query_id, r.id, e.name, r.depth, r.path FROM routes r JOIN entities e USING (id) WHERE r.depth > 0",
        STEPS, reach(3, OWN.format("region")), PARENTS,
        """chosen AS (SELECT * FROM parents QUALIFY row_number() OVER (
             PARTITION BY query_id, id ORDER BY parent_id, relationship_type, direction) = 1),
           routes(query_id, id, depth, path) AS (
             SELECT query_id, id, 0, id FROM reached WHERE depth = 0
             UNION ALL SELECT c.query_id, c.id, c.depth, r.path||' '||c.relationship_type||'/'||c.direction||'/'||c.id
             FROM routes r JOIN chosen c ON c.query_id = r.query_id AND c.parent_id = r.id)""",
        recursive=True,
    ),
    "find_paths": q(
        """SELECT source_id||'>'||target_id request_id, length, rank, path FROM (
             SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY order_key)::int rank FROM routes WHERE depth = 0)
           WHERE rank <= 10""",
        STEPS,
        """pairs AS (SELECT DISTINCT 'nation:'||c_nationkey source_id, 'nation:'||s_nationkey target_id FROM lineitem
             JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
             WHERE c_nationkey <> s_nationkey)""",
        reach(5, "SELECT DISTINCT source_id query_id, source_id id FROM pairs"),
        """routes(source_id, target_id, length, depth, id, path, order_key) AS (
             SELECT source_id, target_id, r.depth, r.depth, target_id, NULL::varchar, []::struct(a varchar, b varchar, c varchar)[]
             FROM pairs JOIN reached r ON r.query_id = source_id AND r.id = target_id
             UNION ALL
             SELECT w.source_id, w.target_id, w.length, w.depth - 1, s.from_id,
               CASE WHEN w.depth = 1 THEN s.from_id||' ' ELSE '' END||s.relationship_type||'/'||s.direction||'/'||s.to_id
                 ||coalesce(' '||w.path, ''),
               list_append(w.order_key, {'a': s.from_id, 'b': s.relationship_type, 'c': s.direction})
             FROM routes w JOIN steps s ON s.to_id = w.id
             JOIN reached r ON r.query_id = w.source_id AND r.id = s.from_id AND r.depth = w.depth - 1
             WHERE w.depth > 0)""",
        recursive=True,
    ),
    "subgraph_nodes": q(
        "SELECT id, e.name, depth, false truncated FROM reached JOIN entities e USING (id)",
        STEPS, reach(2, REGIONS), recursive=True,
    ),
    "subgraph_edges": q(
        "SELECT r.id FROM relationships r JOIN reached s ON s.id = r.source_id JOIN reached t ON t.id = r.target_id",
        STEPS, reach(2, REGIONS), recursive=True,
    ),
    "subgraph_capped": q(
        """SELECT k.id, (SELECT count(*) > 200 FROM reached) truncated,
             count(r.id) kept_edges FROM kept k LEFT JOIN (SELECT * FROM relationships WHERE target_id IN (SELECT id FROM kept)) r
             ON r.source_id = k.id GROUP BY k.id""",
        STEPS, reach(2, REGIONS), "kept AS (SELECT id FROM reached ORDER BY depth, id LIMIT 200)",
        recursive=True,
    ),
}

# --- text, vectors, search ------------------------------------------------------------------

WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
#: Words as the stand-in encoder cuts them.
ENCODED = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
BENCHMARK_QUERIES = "SELECT 'item:'||item_id query_id, text FROM benchmark"
PART_QUERIES = "SELECT DISTINCT p_name||' '||p_type query_id, p_name||' '||p_type AS text FROM part"
OBSERVATION_TEXTS = "SELECT id, content AS text FROM observations"
ENTITY_TEXTS = "SELECT id, name||' '||description||' '||entity_type AS text FROM entities"
ENTITY_VECTOR_TEXTS = "SELECT id, name||' ('||entity_type||') '||description AS text FROM entities"


def bm25(name: str, docs: str, queries: str, k: int, keep: str = "true", scope: str = "true") -> str:
    """Ranked hits of ``queries(query_id, text)`` over ``docs(id, text)`` as a table ``name``."""
    return f"""
{name}_words AS (SELECT id, unnest({WORDS.format('text')}) term FROM ({docs})),
{name}_len AS (SELECT id, count(*) len FROM {name}_words GROUP BY id),
{name}_all AS (SELECT (SELECT count(*) FROM ({docs})) n, (SELECT sum(len) FROM {name}_len)::double / (SELECT count(*) FROM ({docs})) mean),
{name}_tf AS (SELECT id, term, count(*)::double f FROM {name}_words GROUP BY id, term),
{name}_df AS (SELECT term, count(*) df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT query_id, unnest(list_distinct({WORDS.format('text')})) term FROM ({queries})),
{name}_scores AS (
  SELECT q.query_id, t.id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2
    / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9) score
  FROM {name}_q q JOIN {name}_tf t USING (term) JOIN {name}_df USING (term) JOIN {name}_len l ON l.id = t.id, {name}_all
  WHERE {keep} AND {scope} GROUP BY q.query_id, t.id
),
{name} AS (
  SELECT query_id, id, round(score, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY {name}_scores.score DESC, id)::int rank
  FROM {name}_scores QUALIFY rank <= {k}
)
"""


def hash_vectors(name: str, texts: str, key: str = "id") -> str:
    """Word counts in 64 places, by the leading six bits of each word's md5."""
    place = "(strpos('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 4 + (strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1) // 4"
    return f"""
{name}_n AS (SELECT {key}, {place} b, count(*) n FROM (SELECT {key}, unnest({ENCODED.format('text')}) w FROM ({texts})) GROUP BY 1, 2),
{name} AS (SELECT {key}, list_transform(range(64), lambda i: coalesce(map_extract_value(m, i), 0)::double) v
  FROM (SELECT {key}, map(list(b::bigint), list(n)) m FROM {name}_n GROUP BY 1))
"""


def knn(name: str, queries: str, vectors: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::int rank FROM (
    SELECT q.query_id, v.id, round(list_cosine_similarity(q.v, v.v), 9) score FROM ({queries}) q, ({vectors}) v)
  QUALIFY rank <= {k}
)
"""


GIVEN_VECTORS = "SELECT 'doc:'||vec_id id, embedding::double[] v FROM embeddings"


def fuse(name: str, vec: str | None, txt: str) -> str:
    parts = [f"SELECT query_id, id, 0.5 / (60 + rank) s FROM {t}" for t in (vec, txt) if t]
    return f"{name} AS (SELECT query_id, id, sum(s) score FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2)"


ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id)::int rank"

ORACLES |= {
    "bm25_topk": q("SELECT * FROM txt", bm25("txt", OBSERVATION_TEXTS, BENCHMARK_QUERIES, 30)),
    "bm25_hot_terms": q("SELECT * FROM txt", bm25("txt", OBSERVATION_TEXTS, BENCHMARK_QUERIES, 30)),
    "vector_topk": """
        SELECT query_id, id, round(near, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id)::int rank FROM (
          SELECT 'doc:'||a.vec_id query_id, 'doc:'||b.vec_id id,
            round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) near FROM embeddings a, embeddings b)
        QUALIFY rank <= 10""",
    "vector_topk_all_buckets": """
        SELECT query_id, id, round(near, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id)::int rank FROM (
          SELECT 'doc:'||a.vec_id query_id, 'doc:'||b.vec_id id,
            round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) near FROM embeddings a, embeddings b)
        QUALIFY rank <= 10""",
    "vector_topk_approx": """
        SELECT query_id, least(count(*), 10) given, first(id ORDER BY near DESC, id) nearest, true recall_reached FROM (
          SELECT 'doc:'||a.vec_id query_id, 'doc:'||b.vec_id id,
            round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) near FROM embeddings a, embeddings b)
        GROUP BY query_id""",
    "vector_topk_l2": """
        SELECT query_id, id, round(-far, 6) score, row_number() OVER (PARTITION BY query_id ORDER BY far, id)::int rank FROM (
          SELECT 'doc:'||a.vec_id query_id, 'doc:'||b.vec_id id,
            round(list_distance(a.embedding::double[], b.embedding::double[]), 9) far FROM embeddings a, embeddings b)
        QUALIFY rank <= 5""",
    "search_observations": q(
        f"""SELECT query_id, f.id, e.name entity_name, e.entity_type, round(score, 6) relevance_score, rank
            FROM (SELECT *, {ORDER} FROM fused WHERE id IN (SELECT id FROM observations)) f
            JOIN observations o USING (id) JOIN entities e ON e.id = o.entity_id WHERE rank <= 10""",
        bm25("txt", OBSERVATION_TEXTS, BENCHMARK_QUERIES, 30),
        hash_vectors("qv", BENCHMARK_QUERIES, "query_id"),
        knn("vec", "SELECT * FROM qv", GIVEN_VECTORS, 30), fuse("fused", "vec", "txt"),
    ),
    "search_observations_scoped": q(
        f"""SELECT query_id, id, round(score, 6) relevance_score, rank FROM (SELECT *, {ORDER} FROM fused) WHERE rank <= 3""",
        bm25(
            "txt", OBSERVATION_TEXTS, "SELECT 'turn:'||conv_id||':'||turn query_id, text FROM conversations", 9,
            scope="starts_with(t.id, 'turn:') AND split_part(t.id, ':', 2) = split_part(q.query_id, ':', 2)",
        ),
        fuse("fused", None, "txt"),
    ),
    "search_entities": q(
        f"""SELECT query_id, b.id, e.name, round(score, 6) relevance_score, rank, coalesce(r.n, 0) > 20 relationships_truncated,
              least(coalesce(r.n, 0), 20)::int edges_shown
            FROM (SELECT *, {ORDER} FROM boosted) b JOIN entities e USING (id) LEFT JOIN rel_n r ON r.id = b.id WHERE rank <= 10""",
        AUDIT,
        bm25("txt", ENTITY_TEXTS, PART_QUERIES, 30),
        hash_vectors("qv", PART_QUERIES, "query_id"), hash_vectors("ev", ENTITY_VECTOR_TEXTS),
        knn("vec", "SELECT * FROM qv", "SELECT * FROM ev", 30), fuse("fused", "vec", "txt"),
        bm25("otxt", OBSERVATION_TEXTS, PART_QUERIES, 30),
        knn("ovec", "SELECT * FROM qv", GIVEN_VECTORS, 30), fuse("ofused", "ovec", "otxt"),
        """boosted AS (SELECT query_id, id, sum(s) score FROM (
             SELECT query_id, id, score s FROM fused
             UNION ALL SELECT query_id, o.entity_id, 0.5 * least(sum(score), 1.0 / 61) FROM ofused JOIN observations o USING (id) GROUP BY 1, 2)
           GROUP BY 1, 2)""",
    ),
    "search_entities_typed": q(
        f"""SELECT query_id, id, round(score, 6) relevance_score, rank FROM (
              SELECT *, {ORDER} FROM fused WHERE score >= 0.012) WHERE rank <= 5""",
        bm25("txt", ENTITY_TEXTS, PART_QUERIES, 15, keep="split_part(t.id, ':', 1) IN ('supplier', 'part')"),
        hash_vectors("qv", PART_QUERIES, "query_id"), hash_vectors("ev", ENTITY_VECTOR_TEXTS),
        knn("vec", "SELECT * FROM qv", "SELECT * FROM ev WHERE split_part(id, ':', 1) IN ('supplier', 'part')", 15),
        fuse("fused", "vec", "txt"),
    ),
    "suggest_connections": q(
        f"""SELECT entity_id, suggested_id, relevance_score, rank, linked already_connected,
              (count(*) OVER (PARTITION BY entity_id) - sum(linked::int) OVER (PARTITION BY entity_id))::bigint unconnected_count
            FROM (SELECT query_id entity_id, id suggested_id, round(score, 6) relevance_score,
                    row_number() OVER (PARTITION BY query_id ORDER BY rank)::int rank,
                    EXISTS (SELECT 1 FROM pairs WHERE a = least(query_id, id) AND b = greatest(query_id, id)) linked
                  FROM (SELECT *, {ORDER} FROM fused) WHERE rank <= 11 AND id <> query_id) WHERE rank <= 10""",
        AUDIT, PAIRS,
        bm25("txt", ENTITY_TEXTS, "SELECT f.id query_id, e.name||' '||e.entity_type||' '||e.description AS text FROM flags f JOIN entities e USING (id) WHERE disconnected", 33),
        hash_vectors("ev", ENTITY_VECTOR_TEXTS),
        knn("vec", "SELECT ev.id query_id, v FROM ev JOIN flags f ON f.id = ev.id WHERE disconnected", "SELECT * FROM ev", 33),
        fuse("fused", "vec", "txt"),
    ),
    "merge_results": q(
        """SELECT query_id, name, entity_type, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list, r, name)::int rank FROM (
               SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY list, r) = 1))
           WHERE rank <= 20""",
        ENDS,
        """both_lists AS (
             SELECT entity_type query_id, name, entity_type, 0 list, row_number() OVER (PARTITION BY entity_type ORDER BY degree DESC, id) r
             FROM degree_of QUALIFY r <= 15
             UNION ALL SELECT entity_type, name, entity_type, 1, row_number() OVER (PARTITION BY entity_type ORDER BY updated_at DESC, id) r
             FROM entities QUALIFY r <= 15)""",
    ),
    "embed_texts": q(
        f"""SELECT id, sha256(text) content_hash, 64 dim, len({ENCODED.format('text')})::double words FROM (
              SELECT id, name||' ('||entity_type||')'||CASE WHEN description = '' THEN '' ELSE ' '||description END AS text FROM entities)"""
    ),
    "embedding_cache_next": """
        SELECT sha256(text) content_hash, 'hash' model_name, CASE WHEN bool_or(lang IN ('fr', 'de'))
          THEN epoch(timestamp '2024-02-01')::bigint ELSE epoch(timestamp '2024-01-01')::bigint END used
        FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY 1""",
    "prune_cache": """
        SELECT sha256(text) content_hash, lang model_name, max(doc_id) last_used FROM documents GROUP BY 1, 2
        ORDER BY last_used DESC, content_hash, model_name LIMIT 500""",
    "embedding_report": q(
        """SELECT 'observations' "table", 'stored' kind, 'given-'||label model_name, len(embedding)::int dim, count(*) n FROM embeddings GROUP BY 3, 4
           UNION ALL SELECT 'observations', 'orphan', NULL, NULL, count(*) FROM embeddings WHERE 'doc:'||vec_id NOT IN (SELECT id FROM observations)
           UNION ALL SELECT 'observations', 'missing', NULL, NULL, count(*) FROM observations WHERE id NOT IN (SELECT 'doc:'||vec_id FROM embeddings)
           UNION ALL SELECT 'entities', 'orphan', NULL, NULL, 0
           UNION ALL SELECT 'entities', 'missing', NULL, NULL, count(*) FROM entities"""
    ),
    "upsert_vectors": """
        SELECT 'doc:'||vec_id id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS state
        FROM embeddings LEFT JOIN labels l ON l.doc_id = vec_id WHERE coalesce(l.toxic, 0) = 0""",
    "mention_links": q(
        """SELECT id observation_id, 'term:'||piece entity_id, s::int AS start, (s + length(piece))::int stop
           FROM placed WHERE piece IN (SELECT unnest(ws) FROM bench) AND regexp_full_match(piece, '[a-z0-9]{6,}')
           UNION ALL SELECT id, 'term:'||pair, s::int, (s + length(pair))::int FROM (
             SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY k) turn FROM (
               SELECT *, k // 2 - row_number() OVER (PARTITION BY id ORDER BY k) island
               FROM (SELECT *, piece||' '||after pair FROM placed WHERE gap = ' ') WHERE pair IN (SELECT pair FROM pairs)))
           WHERE turn % 2 = 1""",
        r"""bench AS (SELECT regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') ws FROM benchmark)""",
        """pairs AS (SELECT DISTINCT ws[i]||' '||ws[i + 1] pair FROM (SELECT ws, unnest(range(1, len(ws))) i FROM bench)
           WHERE regexp_full_match(pair, '[a-z0-9]{3,5} [a-z0-9]{3,5}'))""",
        """placed AS (SELECT id, k, piece, sum(length(piece)) OVER w - length(piece) s, lead(piece) OVER w gap, lead(piece, 2) OVER w after
           FROM (SELECT id, unnest(p) piece, generate_subscripts(p, 1) k FROM (
             SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+|[^a-z0-9_]+') p FROM observations))
           WINDOW w AS (PARTITION BY id ORDER BY k))""",
    ),
}

# --- mutations ------------------------------------------------------------------------------

PART_GROUPS = """
part_groups AS (
  SELECT p_name, lower(p_name) folded, min(p_partkey) first_key, max_by(p_size, p_partkey)::double size,
    list_reduce(list(p_brand||' '||p_type ORDER BY p_partkey),
      lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a||chr(10)||x END) description
  FROM part GROUP BY p_name
)
"""

EDGE_BATCH = """
batch AS (
  SELECT 'order:'||l_orderkey source_id, 'part:'||l_partkey target_id,
    CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'contains' END relationship_type,
    l_quantity / 45 weight, l_linenumber line, l_orderkey * 100 + l_linenumber * 10 seq
  FROM lineitem
),
good AS (SELECT * FROM batch WHERE weight <= 1),
incoming AS (SELECT source_id, target_id, relationship_type, max(weight) weight, max_by(line, seq)::double line, count(*) n
  FROM good GROUP BY 1, 2, 3)
"""

ENTITY_PATCHES = """
renames AS (
  SELECT s_suppkey, 'Supplier of '||s_nationkey new_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 AS ok
  FROM supplier
)
"""

MERGES = """
merges AS (
  SELECT 'c'||c_custkey request_id, c_custkey seq, 'customer:'||c_custkey s, 'customer:'||min(c_custkey) OVER w t, c_mktsegment description
  FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)
  UNION ALL SELECT 's'||s_suppkey, s_suppkey, 'supplier:'||s_suppkey, 'supplier:'||max(s_suppkey) OVER w, ''
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey)
),
m AS (SELECT * FROM merges WHERE s <> t),
mapped AS (
  SELECT r.id, coalesce(ms.t, r.source_id) source_id, coalesce(mt.t, r.target_id) target_id, relationship_type, weight,
    coalesce(ms.request_id, mt.request_id) request_id, coalesce(ms.seq, mt.seq) seq
  FROM relationships r LEFT JOIN m ms ON ms.s = r.source_id LEFT JOIN m mt ON mt.s = r.target_id
),
placed_edges AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relationship_type ORDER BY seq NULLS FIRST, request_id, id) rn,
    max(weight) OVER (PARTITION BY source_id, target_id, relationship_type) top,
    count(request_id) OVER (PARTITION BY source_id, target_id, relationship_type) moved
  FROM mapped
)
"""

ORACLES |= {
    "upsert_entities": q(
        """SELECT e.id, e.name, e.entity_type, CASE WHEN s_suppkey IS NULL THEN e.description ELSE 'nation '||s_nationkey END description,
             (properties->>'size')::double size, (properties->>'acctbal')::double acctbal, s_nationkey::double nation, s_suppkey IS NOT NULL changed
           FROM entities e LEFT JOIN supplier ON e.id = 'supplier:'||s_suppkey
           UNION ALL SELECT sha256('main'||chr(1)||folded||chr(1)||'part'), p_name, 'part', description, size, NULL, NULL, true FROM part_groups""",
        PART_GROUPS,
    ),
    "upsert_entities_status": q(
        """SELECT 'p'||p_partkey request_id, sha256('main'||chr(1)||folded||chr(1)||'part') id,
             CASE WHEN p_partkey = first_key THEN 'created' ELSE 'merged' END status FROM part JOIN part_groups USING (p_name)
           UNION ALL SELECT 's'||s_suppkey, 'supplier:'||s_suppkey, 'merged' FROM supplier
           UNION ALL SELECT 'r'||r_regionkey, NULL, 'rejected' FROM region""",
        PART_GROUPS,
    ),
    "upsert_relationships": q(
        """SELECT coalesce(r.source_id, i.source_id) source_id, coalesce(r.target_id, i.target_id) target_id,
             coalesce(r.relationship_type, i.relationship_type) relationship_type,
             round(greatest(r.weight, i.weight), 6) weight, line, i.n IS NOT NULL changed
           FROM relationships r FULL JOIN incoming i ON i.source_id = r.source_id AND i.target_id = r.target_id
             AND i.relationship_type = r.relationship_type""",
        EDGE_BATCH,
    ),
    "upsert_relationships_status": q(
        """SELECT * FROM (
             SELECT 'rejected' status, count(*) n FROM batch WHERE weight > 1
             UNION ALL SELECT 'created', count(*) FROM incoming WHERE relationship_type = 'returned'
             UNION ALL SELECT 'updated', (SELECT count(*) FROM good) - (SELECT count(*) FROM incoming WHERE relationship_type = 'returned'))
           WHERE n > 0""",
        EDGE_BATCH,
    ),
    "add_observations": q(
        """SELECT entity_id AS key, count(*) n FROM (SELECT entity_id FROM observations UNION ALL
             SELECT 'source:'||source FROM labels JOIN documents USING (doc_id)) GROUP BY 1
           UNION ALL SELECT 'added', count(*) FROM labels JOIN documents USING (doc_id)
           UNION ALL SELECT 'not_found', count(*) FROM pages"""
    ),
    "update_entities": q(
        """SELECT e.id, coalesce(r.new_name, e.name) AS name, CASE WHEN r.ok THEN 'vendor' ELSE e.entity_type END entity_type,
             CASE WHEN c_custkey IS NULL THEN e.description ELSE 'nation '||c_nationkey END description,
             CASE WHEN r.ok THEN 1.0 END::double renamed, coalesce(r.ok, false) OR c_custkey IS NOT NULL changed
           FROM entities e LEFT JOIN renames r ON r.ok AND e.id = 'supplier:'||s_suppkey
           LEFT JOIN customer ON e.id = 'customer:'||c_custkey""",
        ENTITY_PATCHES,
    ),
    "update_entities_status": q(
        """SELECT 's'||s_suppkey request_id, 'supplier:'||s_suppkey entity_id, CASE WHEN ok THEN 'updated' ELSE 'conflict' END status FROM renames
           UNION ALL SELECT 'c'||c_custkey, 'customer:'||c_custkey, 'updated' FROM customer
           UNION ALL SELECT 'n'||n_nationkey, 'nation:'||n_nationkey, 'conflict' FROM nation
           UNION ALL SELECT 'p'||page_id, NULL, 'not_found' FROM pages""",
        ENTITY_PATCHES,
    ),
    "update_relationships": q(
        """SELECT r.id, CASE WHEN p.o_orderstatus = 'F' THEN 'fulfilled' ELSE r.relationship_type END relationship_type,
             coalesce(p.w, r.weight) weight, p.w IS NOT NULL changed
           FROM relationships r LEFT JOIN (SELECT *, o_totalprice / 400000 w FROM orders WHERE o_totalprice / 400000 <= 1) p
             ON r.relationship_type = 'placed' AND r.target_id = 'order:'||o_orderkey"""
    ),
    "update_observations": q(
        """SELECT o.id, md5(CASE WHEN c.role = 'user' THEN c.role||': '||c.text ELSE o.content END) digest
           FROM observations o LEFT JOIN conversations c ON o.id = 'turn:'||conv_id||':'||turn
           UNION ALL SELECT 'request '||conv_id||':'||turn, CASE WHEN role = 'user' THEN 'updated' ELSE 'not_found' END FROM conversations"""
    ),
    "delete_entities": q(
        """SELECT 'entities' AS key, count(*) n FROM kept
           UNION ALL SELECT 'relationships', count(*) FROM kept_r
           UNION ALL SELECT 'observations', count(*) FROM observations WHERE entity_id IN (SELECT id FROM kept)
           UNION ALL SELECT relationship_type, count(*) FROM kept_r GROUP BY 1
           UNION ALL SELECT 'deleted', (SELECT count(*) FROM entities) - (SELECT count(*) FROM kept)
           UNION ALL SELECT 'not_found', (SELECT count(*) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM pages)""",
        """kept AS (SELECT * FROM entities WHERE entity_type <> 'user'
             AND id NOT IN (SELECT 'customer:'||c_custkey FROM customer WHERE c_acctbal < 0)),
           kept_r AS (SELECT * FROM relationships WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept))""",
    ),
    "delete_relationships": q(
        """SELECT id, 0::bigint deleted FROM relationships WHERE (source_id, target_id, relationship_type) NOT IN (SELECT s, t, k FROM gone)
           UNION ALL SELECT request_id, 1 FROM gone""",
        """gone AS (
             SELECT DISTINCT 'order:'||l_orderkey s, 'part:'||l_partkey t, 'contains' k, 'o-'||l_orderkey||'-'||l_partkey request_id
             FROM lineitem WHERE l_returnflag = 'R'
             UNION ALL SELECT DISTINCT 'supplier:'||l_suppkey, 'part:'||l_partkey, 'supplies', 's-'||l_suppkey||'-'||l_partkey
             FROM lineitem WHERE l_discount > 0.09)""",
    ),
    "delete_observations": q(
        """SELECT id AS key, 'left' state FROM observations WHERE id NOT IN (
             SELECT 'event:'||event_id FROM events WHERE event_type = 'error' AND value > 10)
           UNION ALL SELECT 'e'||event_id, CASE WHEN value > 10 THEN 'deleted' ELSE 'not_found' END FROM events WHERE event_type = 'error'"""
    ),
    "merge_entities": q(
        """SELECT id, source_id, target_id, relationship_type, round(top, 6) weight, moved > 0 changed FROM placed_edges WHERE rn = 1""",
        MERGES,
    ),
    "merge_entities_nodes": q(
        """SELECT e.id, e.description, 0::bigint redirected, 0::bigint removed FROM entities e WHERE e.id NOT IN (SELECT s FROM m)
           UNION ALL SELECT m.request_id, 'merged', coalesce(sum((rn = 1)::int), 0)::bigint, coalesce(sum((rn > 1)::int), 0)::bigint
           FROM m LEFT JOIN placed_edges p USING (request_id) GROUP BY m.request_id""",
        MERGES,
    ),
    "compact_observations": """
        SELECT 'c'||conv_id request_id, CASE WHEN bad THEN 'rejected' ELSE 'compacted' END status, before,
          CASE WHEN bad THEN 0 ELSE before - kept END deleted, CASE WHEN bad THEN 0 ELSE kept END kept,
          (NOT bad)::bigint added, CASE WHEN bad THEN before ELSE kept + 1 END AS "after",
          CASE WHEN bad THEN before ELSE kept + 1 END AS "left"
        FROM (SELECT conv_id, count(*) before, count(*) FILTER (role = 'user') kept, bool_or(contains(text, 'e e')) bad
              FROM conversations GROUP BY 1)""",
    "import_graph": q(
        """SELECT 'entities' "table", (SELECT count(*) FROM entities) - 1 imported, 0::bigint skipped
           UNION ALL SELECT 'relationships', count(*) FILTER (target_id <> 'nation:0' AND source_id <> 'nation:0'),
             count(*) FILTER (target_id = 'nation:0' OR source_id = 'nation:0') FROM relationships
           UNION ALL SELECT 'observations', (SELECT count(*) FROM observations), 0"""
    ),
}

MISSED_NAMES = """
  SELECT 'n'||p_partkey request_id, p_name||' ring' AS name FROM part
  UNION ALL SELECT 'u'||page_id, substr(url, length(url) - 2) FROM pages
  UNION ALL SELECT 'd'||doc_id, 'omer#'||doc_id FROM documents
"""

ORACLES |= {
    "suggest_names": q(
        """SELECT m.request_id, e.name suggestion, min(s.rank) AS rank
           FROM misses m JOIN txt s ON s.query_id = m.name JOIN entities e ON e.id = s.id GROUP BY 1, 2
           UNION ALL SELECT m.request_id, i.name, i.rank FROM misses m JOIN inside i ON i.want = m.name""",
        f"misses AS ({MISSED_NAMES})",
        bm25("txt", ENTITY_TEXTS, "SELECT DISTINCT name query_id, name AS text FROM misses", 5),
        """inside AS (SELECT want, name, row_number() OVER (PARTITION BY want ORDER BY name)::int rank FROM (
             SELECT DISTINCT m.name want, e.name FROM misses m JOIN entities e ON contains(lower(e.name), lower(m.name))
             WHERE m.name NOT IN (SELECT query_id FROM txt)) QUALIFY rank <= 5)""",
    ),
    "texts_containing": q(
        """SELECT w.want, e.id FROM wants w JOIN entities e ON contains(lower(e.name), lower(w.want))
             OR contains(lower(e.description), lower(w.want)) OR contains(lower(e.entity_type), lower(w.want))""",
        """wants AS (SELECT p_brand want FROM part UNION SELECT substr(n_name, 1, 4) FROM nation
           UNION SELECT substr(r_name, 1, 2) FROM region UNION SELECT substr(s_name, 5) FROM supplier)""",
    ),
}

ORACLES |= {
    "owned_requests": """
        SELECT 'user:'||user_id entity_id, count(*) n, 'owned' outcome FROM events GROUP BY user_id
        UNION ALL SELECT 'user:'||(user_id + 1), count(*), 'missing' FROM events GROUP BY user_id""",
    "rrf_fuse": q(
        """SELECT query_id, id, round(sum(s), 9) score FROM (
             SELECT query_id, id, 0.25 / (60 + rank) s FROM vec UNION ALL SELECT query_id, id, 0.75 / (60 + rank) FROM txt) GROUP BY 1, 2""",
        bm25("txt", OBSERVATION_TEXTS, BENCHMARK_QUERIES, 30),
        hash_vectors("qv", BENCHMARK_QUERIES, "query_id"), knn("vec", "SELECT * FROM qv", GIVEN_VECTORS, 30),
    ),
    "add_entities": q(
        """SELECT entity_type AS key, count(*) n FROM (
             SELECT entity_type, name FROM entities UNION SELECT DISTINCT lang, source FROM documents WHERE lang <> 'en') GROUP BY 1
           UNION ALL SELECT source, count(*) FROM (SELECT source FROM observations
             UNION ALL SELECT '' FROM documents WHERE length(trim(text)) > 0) GROUP BY 1
           UNION ALL SELECT 'hints', 0"""
    ),
    "load_graph": q(
        """SELECT 'entities' "table", count(*) n FROM entities WHERE graph_id = 'main'
           UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'observations', 0"""
    ),
    "export_graph": q(
        """SELECT "table", n, n ids FROM count_rows""", COUNT_ROWS
    ),
    "ingest_stream": "SELECT name, observation_count, description FROM (" + USERS.format("event_id", 1) + ")",
    "ingest_two_streams": "SELECT name, observation_count, description FROM ("
    + USERS.format("event_id % 2, event_id", 1) + ")",
    "ingest_onto_snapshot": "SELECT name, observation_count, description FROM (" + USERS.format("event_id", 2) + ")",
    "ingest_named_graph": "SELECT 'other' graph_id, name, observation_count, description FROM ("
    + USERS.format("event_id", 1) + """) UNION ALL
        SELECT 'text', 'User '||user_id, count(*), '' FROM events GROUP BY user_id""",
    "import_documents": "SELECT c_name AS name, 'customer '||c_custkey AS content FROM customer",
    "bfs_forward": q(
        "SELECT query_id, id, depth FROM reached",
        "some_steps AS (SELECT source_id from_id, target_id to_id FROM relationships)",
        reach(2, OWN.format("supplier"), "some_steps"),
        recursive=True,
    ),
    "list_relationships_deep": q(
        """SELECT id, source_name, target_name, total FROM (
             SELECT r.id, s.name source_name, t.name target_name, count(*) OVER () total,
               row_number() OVER (ORDER BY r.updated_at DESC, r.id) place
             FROM relationships r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id) listed
           WHERE place BETWEEN 12001 AND 12050"""
    ),
}
