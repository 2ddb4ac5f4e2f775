"""Regions of streets, edges, connections between regions, trees and capacities."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.operators import graph, streets
from regionflow.operators import network as op
from regionflow.operators.registry import Registry
from regionflow.plans.build import build_topology as build
from regionflow.queries import inputs as src
from regionflow.queries.base import query, table
from regionflow.scale import cut_lineage

c = F.col


# --- regions of streets ---------------------------------------------------------------------------

@query("street_id:s region_id:i", f"""
    SELECT street_id, nation AS region_id FROM ({src.GRID_SQL}) g
    LEFT JOIN (SELECT n_nationkey AS region, 20.0 * n_nationkey AS s0 FROM nation) s
      ON g.x0 >= s0 AND g.x1 <= s0 + 20 AND g.y1 <= 1e9""".replace("nation AS region_id", "region AS region_id"))
def assign_by_polygon(spark, folder):
    return op.assign_by_polygon(src.grid_streets(spark, folder), src.strips(spark, folder), "street_id", "nation")


@query("street_id:s polygons:i", f"""
    SELECT street_id, count(*) AS polygons FROM ({src.GRID_SQL}) g
    JOIN nation ON g.x0 >= 20.0 * n_nationkey AND g.x1 <= 20.0 * n_nationkey + 30
    GROUP BY 1 HAVING count(*) > 1""")
def overlap_violations(spark, folder):
    wide = src.strips(spark, folder, width=30.0)
    return op.overlap_violations(op.polygon_matches(
        src.grid_streets(spark, folder), wide, "street_id", "nation"), "street_id")


_GROUPING = {1: {"segment": ["BUILDING", "MACHINERY"]}, 2: {"nation": [1, 2, 3], "segment": ["HOUSEHOLD"]},
             3: {"nation": [3, 4], "index": [5, 11, 17]}}


@query("street_id:i region_id:i", """
    SELECT c_custkey AS street_id,
           CASE WHEN c_nationkey IN (3, 4) OR c_custkey IN (5, 11, 17) THEN 3
                WHEN c_nationkey IN (1, 2, 3) OR c_mktsegment = 'HOUSEHOLD' THEN 2
                WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 END AS region_id FROM customer""")
def assign_by_mapping(spark, folder):
    rows = table(spark, folder, "customer").select(
        c("c_custkey").alias("street_id"), c("c_custkey").alias("index"), c("c_nationkey").alias("nation"),
        c("c_mktsegment").alias("segment"))
    return op.assign_by_mapping(rows, op.mapping_rows(spark, _GROUPING), ["index", "nation", "segment"])


# --- edges -------------------------------------------------------------------------------------------

_EDGE_SQL = f"""
    WITH s AS ({src.SEGMENT_SQL}), f AS ({src.STREET_SQL}),
    e AS (SELECT s.*, price * length / nullif(sum(length) OVER (PARTITION BY street_id), 0) AS priced,
                 1.0 * length / nullif(sum(length) OVER (PARTITION BY street_id), 0) AS shared, price, region_id
          FROM s JOIN f USING (street_id)),
    k AS (SELECT CASE WHEN (ax, ay) <= (bx, "by") THEN ax ELSE bx END AS ux,
                 CASE WHEN (ax, ay) <= (bx, "by") THEN ay ELSE "by" END AS uy,
                 CASE WHEN (ax, ay) <= (bx, "by") THEN bx ELSE ax END AS vx,
                 CASE WHEN (ax, ay) <= (bx, "by") THEN "by" ELSE ay END AS vy,
                 length, coalesce(priced, price) AS price, coalesce(shared, 1.0) AS source_share,
                 street_id, street_id AS source_street_id, region_id, seq FROM e)
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY ux, uy, vx, vy ORDER BY street_id DESC, seq DESC) AS rn FROM k) WHERE rn = 1"""


def _edges(spark, folder, keep_parallel=False):
    segs = op_segments(spark, folder)
    return op.edges_of_segments(segs, "street_id", ["price", "source_share"], "street_id", keep_parallel)


def op_segments(spark, folder):
    segs = streets.segments_of_vertices(src.vertices(spark, folder))
    facts = src.street_facts(spark, folder)
    return streets.add_lineage(segs.join(facts, "street_id"), "street_id")


@query("ux:d uy:d vx:d vy:d length:d street_id:i region_id:i price:d4 source_share:d", _EDGE_SQL)
def build_edges(spark, folder):
    return _edges(spark, folder).select(
        "*", c("u.x").alias("ux"), c("u.y").alias("uy"), c("v.x").alias("vx"), c("v.y").alias("vy"))


@query("region_id:i edges:i", f"""
    SELECT region_id, count(*) AS edges FROM ({_EDGE_SQL}) WHERE region_id <> 7 GROUP BY 1""")
def region_edges(spark, folder):
    edges = _edges(spark, folder).withColumn("region_id", F.when(c("region_id") != 7, c("region_id")))
    return op.region_edges(edges).groupBy("region_id").agg(F.count(F.lit(1)).alias("edges"))


# Streets on a line, cut after every fourth node group: regions of thirty nodes.
_LINE_SQL = """
    SELECT c_custkey AS k, c_custkey // 30 AS region_id, c_custkey % 30 <> 29 AND c_custkey % 8 <> 7 AS joined FROM customer"""


def _line_edges(spark, folder):
    k = c("c_custkey")
    at = lambda x: geo.point(x, F.lit(0.0))
    end = F.when((k % 30 != 29) & (k % 8 != 7), k + 1.0).otherwise(k + 0.5)
    return table(spark, folder, "customer").select(
        at(k).alias("u"), at(end).alias("v"), (end - k).alias("length"), F.floor(k / 30).alias("region_id"),
        k.alias("source_street_id"))


@query("region_id:i components:i largest:i isolated:i", f"""
    WITH e AS ({_LINE_SQL}),
    g AS (SELECT *, coalesce(sum(CASE WHEN NOT joined THEN 1 ELSE 0 END)
              OVER (PARTITION BY region_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
    s AS (SELECT region_id, part, count(*) + 1 AS nodes, count(*) AS streets, min(k) AS first FROM g GROUP BY 1, 2),
    -- a part whose last street is joined goes on in the next street's first node, which it shares
    m AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY nodes DESC, first) AS rn FROM s)
    SELECT region_id, count(*) AS components, max(nodes) AS largest,
           sum(CASE WHEN rn > 1 THEN streets ELSE 0 END) AS isolated FROM m GROUP BY 1""")
def connectivity_report(spark, folder):
    return op.connectivity_report(_line_edges(spark, folder))


@query("region_id:i length:d3 share:d", f"""
    WITH g AS ({src.GRID_SQL}),
    m AS (SELECT n_nationkey AS region_id, x1 - x0 + y1 - y0 AS len FROM g
          JOIN nation ON x0 >= 20.0 * n_nationkey AND x1 <= 20.0 * n_nationkey + 20)
    SELECT region_id, sum(len) AS length, count(*) AS share FROM m GROUP BY 1""")
def build_topology(spark, folder):
    registry = Registry(spark, 25832)
    registry.register_streets(streets.add_lineage(src.grid_streets(spark, folder), "street_id"))
    area = src.strips(spark, folder)
    built = build(registry, area, "street_id", polygon_id="nation", check_connected=False)
    return built.region_edges.groupBy("region_id").agg(
        F.sum("length").alias("length"), F.sum("source_share").alias("share"))


@query("region_id:i length:d4", f"SELECT region_id, sum(length) AS length FROM ({_EDGE_SQL}) GROUP BY 1")
def total_edge_length(spark, folder):
    return op.total_edge_length(_edges(spark, folder))


@query("x:d y:d degree:i", f"""
    WITH e AS ({_EDGE_SQL}), n AS (SELECT ux AS x, uy AS y FROM e UNION ALL SELECT vx, vy FROM e)
    SELECT x, y, count(*) AS degree FROM n GROUP BY 1, 2""")
def node_property(spark, folder):
    edges = _edges(spark, folder)
    ends = edges.select(c("u").alias("node")).union(edges.select(c("v").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return op.node_property(degrees, "degree").select("node.x", "node.y", "degree")


@query("ux:d uy:d vx:d vy:d length:d", f"SELECT ux, uy, vx, vy, length FROM ({_EDGE_SQL})")
def edge_property(spark, folder):
    return op.edge_property(_edges(spark, folder), "length").select(
        c("u.x").alias("ux"), c("u.y").alias("uy"), c("v.x").alias("vx"), c("v.y").alias("vy"), "length")


@query("ux:d uy:d vx:d vy:d region_id:i", f"SELECT ux, uy, vx, vy, region_id FROM ({_EDGE_SQL}) WHERE region_id = 3")
def subgraph_by_edge(spark, folder):
    return op.subgraph_by_edge(_edges(spark, folder), "region_id", 3).select(
        c("u.x").alias("ux"), c("u.y").alias("uy"), c("v.x").alias("vx"), c("v.y").alias("vy"), "region_id")


@query("ux:d uy:d vx:d vy:d colour:i", f"""
    SELECT ux, uy, vx, vy, CAST(ux AS BIGINT) % 4 AS colour FROM ({_EDGE_SQL})
    WHERE CAST(ux AS BIGINT) % 4 = CAST(vx AS BIGINT) % 4 AND CAST(ux AS BIGINT) % 4 <> 3""")
def subgraph_by_node(spark, folder):
    edges = _edges(spark, folder)
    nodes = op.edge_nodes(edges).withColumn("colour", c("x").cast("bigint") % 4)
    nodes = nodes.withColumn("colour", F.when(c("colour") != 3, c("colour")))
    return op.subgraph_by_node(edges, nodes, "colour").select(
        c("u.x").alias("ux"), c("u.y").alias("uy"), c("v.x").alias("vx"), c("v.y").alias("vy"), "colour")


# --- connections ------------------------------------------------------------------------------------

@query("a:i b:i length:d shared:i", """
    WITH n AS (SELECT c_custkey // 7 AS r, c_custkey AS node FROM customer UNION SELECT c_custkey // 7, c_custkey + 1 FROM customer
               UNION SELECT c_custkey // 7, c_custkey + 8 FROM customer WHERE c_custkey % 3 = 0)
    SELECT x.r AS a, y.r AS b, 0.0 AS length, count(*) AS shared FROM n x JOIN n y USING (node) WHERE x.r < y.r GROUP BY 1, 2""")
def touching_regions(spark, folder):
    k = c("c_custkey")
    steps = F.when(k % 3 == 0, F.array(k, k + 1, k + 8)).otherwise(F.array(k, k + 1))
    nodes = table(spark, folder, "customer").select(
        F.floor(k / 7).alias("region_id"), F.explode(steps).alias("node")).distinct()
    return op.touching_regions(nodes)


# All simple paths inside a block of ten from the nodes of each owned edge; the shortest counts.
_PATHS_SQL = f"""
    WITH RECURSIVE net AS ({src.NET_SQL}),
    both_ways AS (SELECT a, b, length FROM net UNION ALL SELECT b, a, length FROM net),
    owned AS (SELECT region_id, a AS node FROM net WHERE region_id IS NOT NULL
              UNION SELECT region_id, b FROM net WHERE region_id IS NOT NULL),
    walk AS (SELECT region_id AS source, node, 0.0::DOUBLE AS dist, [node] AS path FROM owned
             UNION ALL
             SELECT w.source, e.b, w.dist + e.length, list_append(w.path, e.b) FROM walk w JOIN both_ways e ON e.a = w.node
             WHERE NOT list_contains(w.path, e.b)),
    best AS (SELECT source AS a, region_id AS b, min(dist) AS length, arg_min(path, dist) AS path
             FROM walk JOIN owned USING (node) WHERE source < region_id GROUP BY 1, 2),
    hops AS (SELECT a, b, unnest(path) AS node, generate_subscripts(path, 1) AS seq FROM best),
    steps AS (SELECT a, b, node AS p, lead(node) OVER (PARTITION BY a, b ORDER BY seq) AS q FROM hops),
    third AS (SELECT DISTINCT s.a, s.b FROM steps s JOIN net ON least(p, q) = net.a AND greatest(p, q) = net.b
              WHERE net.region_id IS NOT NULL AND net.region_id NOT IN (s.a, s.b)),
    kept AS (SELECT best.* FROM best ANTI JOIN third USING (a, b))"""


def _owned(spark, folder):
    edges = cut_lineage(src.owned_network(spark, folder))
    nodes = op.edge_nodes(op.region_edges(edges), "region_id").select("region_id", "node")
    return edges, cut_lineage(nodes)


@query("a:i b:i length:d9", _PATHS_SQL + " SELECT a, b, length FROM best")
def region_distances(spark, folder):
    edges, nodes = _owned(spark, folder)
    return op.region_distances(edges, nodes)[0]


@query("a:i b:i", _PATHS_SQL + " SELECT a, b FROM third")
def foreign_connections(spark, folder):
    edges, nodes = _owned(spark, folder)
    pairs, best = op.region_distances(edges, nodes)
    return op.foreign_connections(op.connection_paths(pairs, best), edges)


@query("a:i b:i length:d9", _PATHS_SQL + " SELECT a, b, length FROM kept")
def region_connections(spark, folder):
    return op.region_connections(_owned(spark, folder)[0])[0]


@query("region_in:i region_out:i seq:i node:i", _PATHS_SQL + """
    SELECT a AS region_in, b AS region_out, seq - 1 AS seq, node FROM hops SEMI JOIN kept USING (a, b)
    UNION ALL
    SELECT b, a, max(seq) OVER (PARTITION BY a, b) - seq, node FROM hops SEMI JOIN kept USING (a, b)""")
def order_path(spark, folder):
    connections, paths = op.region_connections(_owned(spark, folder)[0])
    flows = connections.select(c("a").alias("region_in"), c("b").alias("region_out"))
    flows = flows.unionByName(flows.select(c("region_out").alias("region_in"), c("region_in").alias("region_out")))
    return op.order_path(paths, flows).withColumn("node", c("node.x"))


# --- components, groups, trees ------------------------------------------------------------------------

@query("node:i component:i", """
    WITH n AS (SELECT (c_custkey * 7919) % 1000003 AS node, c_custkey // 10 AS block FROM customer)
    SELECT node, min(node) OVER (PARTITION BY block) AS component FROM n""")
def connected_components(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey")
    last = customer.agg(F.max("c_custkey").alias("m")).first()["m"]
    k = c("c_custkey")
    name = lambda v: (v * 7919) % 1000003
    edges = customer.filter((k % 10 != 9) & (k < last)).select(name(k).alias("u"), name(k + 1).alias("v"))
    return graph.connected_components(edges, customer.select(name(k).alias("node")))


_ACTIVE_SQL = f"""
    cap AS ({src.CAPACITY_SQL}),
    act AS (SELECT a, b, length FROM ({src.CONN_SQL}) JOIN cap ca ON ca.region_id = a AND ca.capacity > 0
            JOIN cap cb ON cb.region_id = b AND cb.capacity > 0 WHERE length <= 60),
    two AS (SELECT a, b, length FROM act UNION ALL SELECT b, a, length FROM act)"""
_GROUP_SQL = f"""
    WITH RECURSIVE {_ACTIVE_SQL},
    reach AS (SELECT region_id, region_id AS node FROM cap WHERE capacity > 0
              UNION SELECT r.region_id, t.b FROM reach r JOIN two t ON t.a = r.node),
    grp AS (SELECT region_id, min(node) AS "group" FROM reach GROUP BY 1)"""


def _groups(spark, folder):
    return op.region_groups(src.capacities(spark, folder), src.connections(spark, folder), 60.0)


@query("region_id:i group:i", _GROUP_SQL + ' SELECT region_id, "group" FROM grp')
def region_groups(spark, folder):
    return _groups(spark, folder)


# An edge is in the minimum tree unless its ends are joined by edges that come before it.
@query("a:i b:i length:d9", f"""
    WITH RECURSIVE e AS ({src.CONN_SQL}),
    two AS (SELECT a, b, length, a AS ka, b AS kb FROM e UNION ALL SELECT b, a, length, a, b FROM e),
    reach AS (SELECT a AS ea, b AS eb, length AS el, a AS node FROM e
              UNION SELECT ea, eb, el, t.b FROM reach r JOIN two t ON t.a = r.node
              WHERE (t.length, t.ka, t.kb) < (r.el, r.ea, r.eb))
    SELECT a, b, length FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE ea = e.a AND eb = e.b AND node = e.b)""")
def spanning_tree(spark, folder):
    return graph.spanning_tree(src.connections(spark, folder))


# Trees by construction: parent of k inside its block of forty is the half of its number.
_TREE_SQL = """
    SELECT c_custkey AS node, CASE WHEN c_custkey % 40 > 0 THEN c_custkey - c_custkey % 40 + (c_custkey % 40) // 2 END AS parent,
           CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS capacity FROM customer"""


def _rooted(spark, folder):
    k = c("c_custkey")
    customer = table(spark, folder, "customer")
    parent = k - k % 40 + F.floor((k % 40) / 2)
    tree = customer.filter(k % 40 > 0).select(F.least(parent, k).alias("a"), F.greatest(parent, k).alias("b"))
    return graph.root_tree(tree, customer.filter(k % 40 == 0).select(k.alias("node")))


_ROOTED_SQL = f"""
    WITH RECURSIVE t AS ({_TREE_SQL}),
    d AS (SELECT node, parent, 0 AS depth, node AS root FROM t WHERE parent IS NULL
          UNION ALL SELECT t.node, t.parent, d.depth + 1, d.root FROM t JOIN d ON t.parent = d.node)"""


@query("node:i parent:i depth:i root:i", _ROOTED_SQL + " SELECT * FROM d")
def root_tree(spark, folder):
    return _rooted(spark, folder)


@query("node:i parent:i grid:d4 inflow:d4", _ROOTED_SQL + f""",
    up AS (SELECT node AS origin, node, 0 AS hops FROM t
           UNION ALL SELECT origin, t.parent, hops + 1 FROM up JOIN t USING (node) WHERE t.parent IS NOT NULL),
    g AS (SELECT up.node, sum(capacity * 1.3 / pow(0.88 * 0.95, hops)) AS grid FROM up JOIN t ON t.node = origin GROUP BY 1)
    SELECT node, parent, grid, grid / 0.88 AS inflow FROM g JOIN t USING (node)""")
def propagate_capacity(spark, folder):
    capacity = src.capacities(spark, folder).withColumnRenamed("region_id", "node")
    return graph.propagate_capacity(_rooted(spark, folder), capacity, 0.88, 0.95, 1.3)


@query("group:i region_id:i capacity:d2 added:b", _GROUP_SQL + """,
    m AS (SELECT "group", region_id, capacity, region_id % 6 = 0 AS listed FROM grp JOIN cap USING (region_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY listed DESC, capacity DESC, region_id) AS rn FROM m)
    SELECT "group", region_id, capacity, NOT listed AS added FROM r WHERE rn = 1""")
def pick_source(spark, folder):
    regions = src.capacities(spark, folder)
    listed = regions.filter(c("region_id") % 6 == 0).select("region_id")
    return op.pick_source(_groups(spark, folder), regions, listed)
