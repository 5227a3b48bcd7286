"""Registered graph queries (GRF-*)."""

from __future__ import annotations

from opslens.operators import graph as g
from opslens.plans.registry import register
from opslens.sources import testviews as tv

_EDGES = """
tg AS (SELECT database_name || '.' || schema_name || '.' || task_name AS task_id, task_name AS label, state, database_name, schema_name,
              predecessors FROM task_graph),
ex AS (SELECT task_id, database_name, schema_name,
              unnest(CASE WHEN starts_with(trim(predecessors), '[') THEN from_json(predecessors, '["VARCHAR"]') END) AS pred FROM tg),
edges AS (SELECT DISTINCT CASE WHEN contains(trim(pred), '.') THEN trim(pred)
                               ELSE database_name || '.' || schema_name || '.' || trim(pred) END AS source, task_id AS target
          FROM ex WHERE pred IS NOT NULL AND trim(pred) <> ''),
nodes AS (SELECT n.task_id, n.label, n.state, coalesce(i.c, 0) AS predecessor_count, coalesce(o.c, 0) AS dependent_count,
                 coalesce(i.c, 0) = 0 AS is_root, coalesce(o.c, 0) = 0 AS is_leaf
          FROM (SELECT DISTINCT task_id, label, state FROM tg) n
          LEFT JOIN (SELECT target, count(*) AS c FROM edges GROUP BY 1) i ON n.task_id = i.target
          LEFT JOIN (SELECT source, count(*) AS c FROM edges GROUP BY 1) o ON n.task_id = o.source)
"""


def _tg(spark, sf):
    return tv.load(spark, sf, "task_graph")


@register("task_edges", "task_graph", op="GRF-1", sql="WITH " + _EDGES + "SELECT * FROM edges")
def _(spark, sf):
    return g.task_edges(_tg(spark, sf))


@register("task_nodes", "task_graph", op="GRF-1", sql="WITH " + _EDGES + "SELECT * FROM nodes")
def _(spark, sf):
    return g.task_nodes(_tg(spark, sf))


@register("dag_summary", "task_graph", op="GRF-2", sql="WITH RECURSIVE " + _EDGES + """,
bfs(node, d) AS (SELECT task_id, 0 FROM nodes WHERE is_root
                 UNION SELECT e.target, b.d + 1 FROM bfs b JOIN edges e ON e.source = b.node
                 WHERE b.d < (SELECT count(*) FROM nodes)),
dep AS (SELECT node, min(d) AS d FROM bfs GROUP BY 1)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count_if(is_root) FROM nodes) AS roots,
       (SELECT count_if(is_leaf) FROM nodes) AS leaves, (SELECT count(*) FROM edges) AS edges,
       (SELECT coalesce(max(d), 0) FROM dep) AS depth
""")
def _(spark, sf):
    return g.dag_summary(_tg(spark, sf))


@register("blast_radius", "task_graph", op="GRF-3", sql="WITH RECURSIVE " + _EDGES + """,
bfs(node, d) AS (SELECT 'DB.SCH_0.TASK_1', 0 UNION SELECT e.target, b.d + 1 FROM bfs b JOIN edges e ON e.source = b.node WHERE b.d < (SELECT count(*) FROM nodes)),
n AS (SELECT count(DISTINCT node) AS c FROM bfs WHERE node <> 'DB.SCH_0.TASK_1')
SELECT 'DB.SCH_0.TASK_1' AS failed_task, c AS downstream_count,
       CASE WHEN c > 10 THEN 'Critical' WHEN c > 5 THEN 'High' WHEN c > 0 THEN 'Medium' ELSE 'Isolated' END AS blast_radius FROM n
""")
def _(spark, sf):
    return g.blast_radius(_tg(spark, sf), "DB.SCH_0.TASK_1")


@register("downstream_objects", "object_dependencies", op="GRF-4", sql="""
WITH RECURSIVE ds AS (
  SELECT referencing_object_name, referencing_object_domain, referenced_object_name, 1 AS depth
  FROM object_dependencies WHERE upper(referenced_object_name) = 'T_1'
  UNION ALL
  SELECT od.referencing_object_name, od.referencing_object_domain, od.referenced_object_name, d.depth + 1
  FROM object_dependencies od JOIN ds d ON upper(od.referenced_object_name) = upper(d.referencing_object_name)
  WHERE d.depth < 5)
SELECT DISTINCT referencing_object_name AS object_name, referencing_object_domain AS object_type, depth AS dependency_depth,
       referenced_object_name AS depends_on
FROM ds
""")
def _(spark, sf):
    return g.downstream_objects(tv.load(spark, sf, "object_dependencies"), "T_1", 5)


@register("direct_dependents", "object_dependencies", op="GRF-5", sql="""
SELECT 'dependent' AS direction, referencing_object_name AS object_name, referencing_object_domain AS object_type
FROM object_dependencies WHERE upper(referenced_object_name) = 'T_10'
UNION ALL
SELECT 'depends_on', referenced_object_name, referenced_object_domain FROM object_dependencies WHERE upper(referencing_object_name) = 'T_10'
""")
def _(spark, sf):
    return g.direct_dependents(tv.load(spark, sf, "object_dependencies"), "DB_1.SCH_1.T_10")


@register("graph_impact", "task_graph", op="GRF-6", sql="WITH RECURSIVE " + _EDGES + """,
reach(anc, dsc) AS (SELECT source, target FROM edges UNION SELECT r.anc, e.target FROM reach r JOIN edges e ON r.dsc = e.source),
cnt AS (SELECT anc AS task_id, count(*) AS c FROM reach GROUP BY 1),
sc AS (SELECT DISTINCT target AS task_id FROM edges WHERE source IN (SELECT task_id FROM nodes))
SELECT n.task_id, n.label, n.state, coalesce(cnt.c, 0) AS downstream_task_count,
       CASE WHEN sc.task_id IS NULL THEN 'Root' WHEN n.dependent_count = 0 THEN 'Leaf' ELSE 'Intermediate' END AS graph_role,
       CASE WHEN coalesce(cnt.c, 0) >= 5 THEN 'High' WHEN coalesce(cnt.c, 0) >= 1 THEN 'Medium' ELSE 'Local' END AS blast_radius,
       CASE WHEN sc.task_id IS NULL THEN 'Root graph retry' ELSE 'Targeted task retry' END AS retry_scope
FROM nodes n LEFT JOIN cnt ON n.task_id = cnt.task_id LEFT JOIN sc ON n.task_id = sc.task_id
""")
def _(spark, sf):
    return g.graph_impact(_tg(spark, sf))


@register("graph_members", "task_graph", op="GRF-7", sql="WITH RECURSIVE " + _EDGES + """,
bfs(node, d) AS (SELECT 'DB.SCH_0.TASK_2', 0 UNION SELECT e.target, b.d + 1 FROM bfs b JOIN edges e ON e.source = b.node WHERE b.d < (SELECT count(*) FROM nodes))
SELECT node AS task_id, min(d) AS depth FROM bfs GROUP BY 1
""")
def _(spark, sf):
    return g.graph_members(_tg(spark, sf), "DB.SCH_0.TASK_2")


@register("topology_edges", "query_history", "sessions", op="GRF-8", sql="""
SELECT warehouse_name AS source, user_name AS target, count(*) AS weight, 'warehouse-user' AS edge_type FROM query_history
WHERE warehouse_name IS NOT NULL AND user_name IS NOT NULL GROUP BY 1, 2
UNION ALL
SELECT user_name, role_name, count(*), 'user-role' FROM query_history WHERE user_name IS NOT NULL AND role_name IS NOT NULL GROUP BY 1, 2
UNION ALL
SELECT database_name, schema_name, count(*), 'database-schema' FROM query_history
WHERE database_name IS NOT NULL AND schema_name IS NOT NULL GROUP BY 1, 2
UNION ALL
SELECT s.client_application_id, w.warehouse_name, count(*), 'client-warehouse'
FROM sessions s JOIN (SELECT DISTINCT user_name, warehouse_name FROM query_history) w ON s.user_name = w.user_name GROUP BY 1, 2
""")
def _(spark, sf):
    return g.topology_edges(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "sessions"))
