"""Street geometry, cleaning and shapes."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.operators import streets as op
from regionflow.plans.build import prepare_streets as prepare
from regionflow.queries.base import query, table
from regionflow.queries import inputs as src

c = F.col


@query("rule:s offenders:i", """
    WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN o_orderkey - 1
                      ELSE o_orderkey END AS id, o_orderkey % 41 = 0 AS short FROM orders)
    SELECT 'empty_id' AS rule, count(*) AS offenders FROM s WHERE id IS NULL
    UNION ALL SELECT 'not_a_line', count(*) FROM s WHERE short
    UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
""")
def street_violations(spark, folder):
    rows = src.bent_streets(spark, folder)
    k = c("street_id")
    faulty = rows.withColumns({
        "parts": F.when(k % 41 == 0, F.transform("parts", lambda p: F.slice(p, 1, 1))).otherwise(c("parts")),
        "street_id": F.when(k % 50 == 0, None).when(k % 31 == 0, k - 1).otherwise(k)})
    return op.street_violations(faulty, "street_id")


@query("street_id:s source_street_id:s source_share:d", f"""
    SELECT street_id, street_id AS source_street_id, 1.0 AS source_share FROM ({src.GRID_SQL})""")
def add_lineage(spark, folder):
    rows = src.grid_streets(spark, folder)
    return op.add_lineage(op.validate_streets(rows, "street_id"), "street_id")


@query("street_id:i part:i seq:i x:d y:d", f"""
    WITH b AS ({src.BENT_SQL})
    SELECT street_id, 0 AS part, 0 AS seq, x0 AS x, y0 AS y FROM b
    UNION ALL SELECT street_id, 0, 1, x1, y0 FROM b
    UNION ALL SELECT street_id, 0, 2, x1, y1 FROM b
    UNION ALL SELECT street_id, 1, 0, x0, y0 - 1 FROM b WHERE two
    UNION ALL SELECT street_id, 1, 1, x1, y0 - 1 FROM b WHERE two""")
def explode_vertices(spark, folder):
    return op.explode_vertices(src.bent_streets(spark, folder), "street_id")


@query("street_id:i seq:i ax:d ay:d bx:d by:d length:d", src.SEGMENT_SQL)
def segments(spark, folder):
    return op.segments_of_vertices(src.vertices(spark, folder))


@query("street_id:i part:i seq:i length:d start:d part_length:d", f"""
    WITH b AS ({src.BENT_SQL})
    SELECT street_id, 0 AS part, 0 AS seq, x1 - x0 AS length, 0.0 AS start, x1 - x0 + y1 - y0 AS part_length FROM b
    UNION ALL SELECT street_id, 0, 1, y1 - y0, x1 - x0, x1 - x0 + y1 - y0 FROM b
    UNION ALL SELECT street_id, 1, 0, x1 - x0, 0.0, x1 - x0 FROM b WHERE two""")
def measured_segments(spark, folder):
    return op.segments(src.bent_streets(spark, folder), "street_id")


def _grid_segments(spark, folder, flat=None):
    rows = src.grid_streets(spark, folder)
    if flat is not None:
        rows = rows.filter(c("street_id").startswith("H" if flat else "V"))
    return op.segments(rows, "street_id").withColumnRenamed("street_id", "id")


@query("a_id:s b_id:s x:d y:d", f"""
    WITH g AS ({src.GRID_SQL})
    SELECT h.street_id AS a_id, v.street_id AS b_id, v.x0 AS x, h.y0 AS y FROM g h JOIN g v
    ON h.flat AND NOT v.flat AND v.x0 BETWEEN h.x0 AND h.x1 AND h.y0 BETWEEN v.y0 AND v.y1""")
def segment_intersections(spark, folder):
    rows = _grid_segments(spark, folder).select("id", "ax", "ay", "bx", "by")
    return op.segment_intersections(rows, rows, c("a_id") < c("b_id"))


@query("street_id:s x:d y:d at:d dist:d interior:b", f"""
    WITH g AS ({src.GRID_SQL}),
    p AS (SELECT 'H' || c_custkey AS street_id, (c_custkey * 7) % 500 + c_custkey % 23 - 2.0 AS x,
                 c_custkey + c_custkey % 3 * 0.25 AS y FROM customer),
    m AS (SELECT p.*, greatest(0, least(p.x, g.x1) - g.x0) AS "at",
                 sqrt((p.x - greatest(g.x0, least(p.x, g.x1))) ** 2 + (p.y - g.y0) ** 2) AS dist, g.x1 - g.x0 AS len
          FROM p JOIN g USING (street_id))
    SELECT street_id, x, y, "at", dist, dist <= 0.5 AND "at" > 0.5 AND "at" < len - 0.5 AS interior FROM m""")
def locate_on_line(spark, folder):
    k = c("c_custkey")
    points = table(spark, folder, "customer").select(
        F.concat(F.lit("H"), k.cast("string")).alias("street_id"),
        ((k * 7) % 500 + k % 23 - F.lit(2.0)).alias("x"), (k + k % 3 * F.lit(0.25)).alias("y"))
    return op.locate_on_line(points, src.grid_streets(spark, folder), "street_id", 0.5)


@query("id:s x:d y:d at:d dist:d", f"""
    WITH g AS ({src.GRID_SQL}),
    ends AS (SELECT x0 AS x, y0 AS y FROM g UNION SELECT x1, y1 FROM g)
    SELECT street_id AS id, x, y, x - x0 AS "at", 0.0 AS dist FROM g JOIN ends
      ON flat AND ends.y = g.y0 AND ends.x > g.x0 AND ends.x < g.x1
    UNION ALL
    SELECT street_id, x, y, y - y0, 0.0 FROM g JOIN ends
      ON NOT flat AND ends.x = g.x0 AND ends.y > g.y0 AND ends.y < g.y1""")
def near_touch_vertices(spark, folder):
    lines = _grid_segments(spark, folder)
    ends = lines.select(c("ax").alias("x"), c("ay").alias("y")).union(lines.select("bx", "by"))
    return op.near_touch_vertices(ends, lines, 1e-6)


@query("id:i at:d x:d", """
    WITH RECURSIVE o AS (
      SELECT l_suppkey AS id, CAST(l_extendedprice AS DOUBLE) AS "at", CAST(l_orderkey AS DOUBLE) AS x,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k FROM lineitem),
    r AS (
      SELECT id, "at", x, k, "at" AS last, true AS kept FROM o WHERE k = 1
      UNION ALL
      SELECT o.id, o."at", o.x, o.k, CASE WHEN o."at" > r.last + 50 THEN o."at" ELSE r.last END, o."at" > r.last + 50
      FROM r JOIN o ON o.id = r.id AND o.k = r.k + 1)
    SELECT id, "at", x FROM r WHERE kept""")
def dedupe_points(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        c("l_suppkey").alias("id"), F.lit(0).alias("part"), c("l_extendedprice").alias("at"),
        c("l_orderkey").cast("double").alias("x"), c("l_linenumber").cast("double").alias("y"))
    return op.dedupe_points(rows, 50.0)


def _marks(spark, folder):
    """One or two points inside every horizontal street."""
    k = c("c_custkey")
    offsets = F.when(k % 2 == 0, F.array(F.lit(1.25))).otherwise(F.array(F.lit(1.25), F.lit(2.5)))
    return table(spark, folder, "customer").select(k, F.explode(offsets).alias("at")).select(
        F.concat(F.lit("H"), k.cast("string")).alias("id"), F.lit(0).alias("part"), "at",
        ((k * 7) % 500 + c("at")).alias("x"), k.cast("double").alias("y"))


@query("street_id:s seq:i x:d y:d", f"""
    WITH g AS ({src.GRID_SQL}),
    v AS (SELECT street_id, x0 AS x, y0 AS y FROM g UNION ALL SELECT street_id, x1, y1 FROM g
          UNION ALL SELECT street_id, x0 + 1.25, y0 FROM g WHERE flat
          UNION ALL SELECT street_id, x0 + 2.5, y0 FROM g WHERE flat AND CAST(y0 AS BIGINT) % 2 = 1)
    SELECT street_id, row_number() OVER (PARTITION BY street_id ORDER BY x, y) - 1 AS seq, x, y FROM v""")
def insert_vertex(spark, folder):
    rows = src.grid_streets(spark, folder)
    return op.explode_vertices(op.insert_vertex(rows, _marks(spark, folder), "street_id", 1e-6), "street_id")


@query("id:s piece:i x0:d x1:d length:d", f"""
    WITH g AS (SELECT * FROM ({src.GRID_SQL}) WHERE flat),
    v AS (SELECT street_id AS id, x0 AS x FROM g UNION ALL SELECT street_id, x1 FROM g
          UNION ALL SELECT street_id, x0 + 1.25 FROM g
          UNION ALL SELECT street_id, x0 + 2.5 FROM g WHERE CAST(y0 AS BIGINT) % 2 = 1)
    SELECT id, piece, x0, x1, x1 - x0 AS length FROM (
        SELECT id, row_number() OVER w AS piece, x AS x0, lead(x) OVER w AS x1 FROM v
        WINDOW w AS (PARTITION BY id ORDER BY x)) WHERE x1 IS NOT NULL""")
def split_at_points(spark, folder):
    rows = src.grid_streets(spark, folder)
    pieces = op.split_at_points(rows, _marks(spark, folder), "street_id", 1e-6)
    return pieces.withColumns({"x0": F.element_at("line", 1)["x"], "x1": F.element_at("line", -1)["x"]})


_DIVIDED_SQL = f"""
    WITH g AS ({src.GRID_SQL}), cuts AS ({src.GRID_CUTS_SQL}),
    v AS (SELECT street_id, 0.0 AS "at", x0 AS x, y0 AS y FROM g
          UNION ALL SELECT street_id, x1 - x0 + y1 - y0, x1, y1 FROM g
          UNION ALL SELECT street_id, "at", x, y FROM cuts),
    p AS (SELECT street_id, "at" AS a, lead("at") OVER w AS b, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS "by",
                 row_number() OVER w AS k, count(*) OVER (PARTITION BY street_id) - 1 AS n,
                 max("at") OVER (PARTITION BY street_id) AS total
          FROM v WINDOW w AS (PARTITION BY street_id ORDER BY "at"))
    SELECT CASE WHEN n > 1 THEN (k * 100) || street_id ELSE street_id END AS street_id, street_id AS source_street_id,
           (b - a) / total AS source_share, x AS ax, y AS ay, bx, "by"
    FROM p WHERE b IS NOT NULL"""
_DIVIDED = "street_id:s source_street_id:s source_share:d9 ax:d ay:d bx:d by:d"


@query(_DIVIDED, _DIVIDED_SQL)
def divide_at_junctions(spark, folder):
    rows = op.add_lineage(src.grid_streets(spark, folder), "street_id")
    pieces = op.divide_at_junctions(rows, "street_id", ["source_share"])
    return op.segments(pieces, "street_id", "source_street_id", "source_share")


@query("x:d y:d neighbour_x:d neighbour_y:d", f"""
    WITH s AS ({src.SEGMENT_SQL}),
    e AS (SELECT DISTINCT CASE WHEN (ax, ay) <= (bx, "by") THEN (ax, ay) ELSE (bx, "by") END AS u,
                          CASE WHEN (ax, ay) <= (bx, "by") THEN (bx, "by") ELSE (ax, ay) END AS v FROM s),
    d AS (SELECT u AS n, v AS o FROM e UNION ALL SELECT v, u FROM e)
    SELECT n[1] AS x, n[2] AS y, min(o)[1] AS neighbour_x, min(o)[2] AS neighbour_y
    FROM d GROUP BY n HAVING count(*) = 1""")
def dead_ends(spark, folder):
    segs = op.segments_of_vertices(src.vertices(spark, folder))
    a, b = geo.point(c("ax"), c("ay")), geo.point(c("bx"), c("by"))
    found = op.dead_ends(segs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))
    return found.select("node.x", "node.y", c("neighbour.x").alias("neighbour_x"), c("neighbour.y").alias("neighbour_y"))


@query("px:d py:d id:s dist:d x:d y:d", f"""
    WITH g AS ({src.GRID_SQL}),
    p AS (SELECT x0 AS px, y0 AS py FROM g WHERE NOT flat UNION SELECT x1, y1 FROM g WHERE NOT flat),
    m AS (SELECT px, py, street_id AS id, greatest(x0, least(px, x1)) AS x, y0 AS y,
                 sqrt((px - greatest(x0, least(px, x1))) ** 2 + (py - y0) ** 2) AS dist
          FROM p JOIN g ON flat AND abs(py - y0) < 6 AND y0 <> floor(py))
    SELECT px, py, id, dist, x, y FROM (
        SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY dist, id) AS rn FROM m WHERE dist < 6)
    WHERE rn = 1""")
def nearest_street(spark, folder):
    steep, flat = _grid_segments(spark, folder, False), _grid_segments(spark, folder, True)
    ends = (steep.select(c("ax").alias("px"), c("ay").alias("py")).union(steep.select("bx", "by")).distinct()
            .withColumn("node", geo.point(c("px"), c("py"))))
    # the street on the same whole height is taken as the end's own
    own = ends.select("node", F.concat(F.lit("H"), F.floor("py").cast("string")).alias("id"))
    found = op.nearest_street(ends, flat, 6.0, own)
    return found.withColumns({"px": c("node.x"), "py": c("node.y")})


@query("node:i id:i own:i", """
    WITH b AS (SELECT o_orderkey AS node, o_custkey AS own,
                      (o_custkey * 3 + o_orderkey % 2) % (SELECT count(*) FROM customer) AS id FROM orders),
    s AS (SELECT *, row_number() OVER (PARTITION BY least(own, id), greatest(own, id) ORDER BY node) AS rn FROM b)
    SELECT node, id, own FROM s WHERE rn = 1""")
def dedupe_facing(spark, folder):
    n = table(spark, folder, "customer").count()
    bridges = table(spark, folder, "orders").select(
        c("o_orderkey").alias("node"), c("o_custkey").alias("own"),
        ((c("o_custkey") * 3 + c("o_orderkey") % 2) % n).alias("id"))
    return op.dedupe_facing(bridges, bridges.select("node", c("own").alias("owner")))


def _gap_streets(spark, folder):
    """Pairs of streets with a gap of one to six; every second right one stands upright."""
    k, gap = c("c_custkey"), 1 + c("c_custkey") % 6
    x, y = F.lit(50.0) + gap, k * 100
    left = geo.line((0.0, y), (50.0, y))
    right = F.when(k % 2 == 0, geo.line((x, y), (100.0, y))).otherwise(geo.line((x, y - 3), (x, y + 3)))
    rows = table(spark, folder, "customer").select(k, F.explode(F.array(
        F.struct(F.lit("A").alias("s"), left.alias("p")), F.struct(F.lit("B").alias("s"), right.alias("p")))).alias("r"))
    return rows.select(F.concat("r.s", k.cast("string")).alias("street_id"), F.lit(False).alias("multi"),
                       F.lit(1.0).alias("value"), c("r.p").alias("parts"))


@query("street_id:s value:d vertices:i length:d", """
    WITH k AS (SELECT c_custkey AS k, 1 + c_custkey % 6 AS gap FROM customer),
    closed AS (SELECT * FROM k WHERE gap < 5)
    SELECT 'A' || k AS street_id, 1.0 AS value, 2 AS vertices, 50.0 AS length FROM k
    UNION ALL SELECT 'B' || k, 1.0, CASE WHEN k % 2 = 1 AND gap < 5 THEN 3 ELSE 2 END,
                     CASE WHEN k % 2 = 1 THEN 6 ELSE 50 - gap END FROM k
    UNION ALL SELECT '000B' || k, NULL, 2, gap FROM closed""")
def close_gaps(spark, folder):
    rows = op.close_gaps(_gap_streets(spark, folder), 5.0, "street_id")
    return rows.withColumns({"vertices": F.size(F.element_at("parts", 1)), "length": geo.line_length(c("parts"))})


@query("street_id:i", """
    SELECT c_custkey AS street_id FROM customer WHERE c_custkey < 50 OR c_custkey % 3 <> 0""")
def drop_isolated_nulls(spark, folder):
    k = c("c_custkey")
    open_end = F.when((k >= 40) & (k % 10 == 9), 0.5).otherwise(1.0)
    rows = table(spark, folder, "customer").select(
        k.alias("street_id"), F.when(k % 3 != 0, 1.0).alias("value"),
        geo.line((k, 0.0), (k + open_end, 0.0)).alias("parts"))
    # the first five blocks hang together and form the largest part; later ones end before the next
    return op.drop_isolated_nulls(rows, ["value"], "street_id")


@query(_DIVIDED)
def prepare_streets(spark, folder):
    rows = prepare(src.grid_streets(spark, folder), "street_id", 25832, 25832, divide=True, gap=2.0,
                   drop_isolated=["value"])
    return op.segments(rows, "street_id", "source_street_id", "source_share")


@query("o_orderkey:i o_totalprice:d2 o_orderpriority:s", """
    SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 5.0
             WHEN o_orderpriority = '1-URGENT' THEN (SELECT min_by(o_totalprice, o_orderkey) FROM orders
                                                     WHERE o_orderpriority = '1-URGENT') + 100
             ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_orderkey = 3 THEN 'none' ELSE o_orderpriority END AS o_orderpriority
    FROM orders""")
def patch_table(spark, folder):
    return op.patch_table(table(spark, folder, "orders"), [
        {"column": "o_totalprice", "where": "o_orderpriority", "equals": "1-URGENT", "add": 100.0},
        {"column": "o_totalprice", "where": "o_custkey", "equals": 7, "replace": 5.0},
        {"column": "o_orderpriority", "where": "index", "equals": 3, "replace": "none"}], order="o_orderkey")


# Hull edges by definition: no other point right of p -> q, nor on the line outside the edge.
_CLOUD_SQL = """
    SELECT DISTINCT o_custkey AS k, CAST(o_orderkey % 97 AS DOUBLE) AS x,
           CAST((o_orderkey * 31 + o_custkey) % 89 AS DOUBLE) AS y FROM orders"""
_HULL_SQL = f"""
    WITH p AS ({_CLOUD_SQL})
    SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM p a JOIN p b ON a.k = b.k AND (a.x, a.y) <> (b.x, b.y)
    WHERE NOT EXISTS (
        SELECT 1 FROM p r WHERE r.k = a.k AND (
            (b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < 0
            OR ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) = 0
                AND ((r.x - a.x) * (r.x - b.x) > 0 OR (r.y - a.y) * (r.y - b.y) > 0))))"""


def _cloud(spark, folder):
    k, i = c("o_custkey"), c("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("k"), (i % 97).cast("double").alias("x"), ((i * 31 + k) % 89).cast("double").alias("y"))


@query("k:i ax:d ay:d bx:d by:d", _HULL_SQL)
def convex_hull(spark, folder):
    hulls = op.convex_hull(_cloud(spark, folder), "k")
    edges = hulls.select("k", F.explode(geo.flat_segments(c("rings"))).alias("s"))
    return edges.filter(c("s.a") != c("s.b")).select(
        "k", c("s.a.x").alias("ax"), c("s.a.y").alias("ay"), c("s.b.x").alias("bx"), c("s.b.y").alias("by"))


@query("k:i x:d y:d", f"""
    WITH p AS ({_CLOUD_SQL}), m AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM p GROUP BY k)
    SELECT k, x, y FROM (SELECT p.*, row_number() OVER (PARTITION BY k ORDER BY
        sqrt((mx - x) * (mx - x) + (my - y) * (my - y)), x, y) AS rn FROM p JOIN m USING (k)) WHERE rn = 1""")
def anchor_point(spark, folder):
    return op.anchor_point(_cloud(spark, folder), "k")


@query("k:i x:d4 y:d4 area:d4", f"""
    WITH e AS ({_HULL_SQL}),
    s AS (SELECT k, sum(ax * "by" - bx * ay) / 2 AS area, sum((ax + bx) * (ax * "by" - bx * ay)) / 6 AS mx,
                 sum((ay + "by") * (ax * "by" - bx * ay)) / 6 AS my FROM e GROUP BY k),
    -- a point or a straight line of points has no area: the mean of its ends
    m AS (SELECT k, min({{'x': x, 'y': y}}) AS lo, max({{'x': x, 'y': y}}) AS hi FROM ({_CLOUD_SQL}) GROUP BY k)
    SELECT m.k, CASE WHEN area > 0 THEN mx / area ELSE (lo.x + hi.x) / 2 END AS x,
           CASE WHEN area > 0 THEN my / area ELSE (lo.y + hi.y) / 2 END AS y, coalesce(area, 0) AS area FROM m LEFT JOIN s USING (k)""")
def hull_centroid(spark, folder):
    return op.hull_centroid(op.convex_hull(_cloud(spark, folder), "k"), "k")


@query("region_id:i ax:d ay:d bx:d by:d", """
    WITH cell AS (SELECT c_nationkey AS region_id, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer),
    e AS (SELECT region_id, i AS ax, j AS ay, i + 1 AS bx, j AS "by" FROM cell
          UNION ALL SELECT region_id, i, j + 1, i + 1, j + 1 FROM cell
          UNION ALL SELECT region_id, i, j, i, j + 1 FROM cell
          UNION ALL SELECT region_id, i + 1, j, i + 1, j + 1 FROM cell)
    SELECT * FROM e GROUP BY ALL HAVING count(*) % 2 = 1""")
def dissolve(spark, folder):
    k = c("c_custkey")
    i, j = k % 40, F.floor(k / 40)
    cells = table(spark, folder, "customer").select(
        c("c_nationkey").alias("region_id"), geo.box(i, j, i + 1, j + 1).alias("rings"))
    return op.dissolve(cells, ["region_id"])


@query("point_id:i region_id:i dist:d", """
    WITH n AS (SELECT CAST((c_custkey * 7) % 500 AS DOUBLE) AS x, CAST((c_custkey * 13) % 371 AS DOUBLE) AS y,
                      c_nationkey AS region_id FROM customer),
    p AS (SELECT s_suppkey AS point_id, (s_suppkey * 17) % 701 - 90.25 AS px, (s_suppkey * 29) % 499 - 60.75 AS py
          FROM supplier)
    SELECT point_id, region_id, dist FROM (
        SELECT point_id, region_id, sqrt((x - px) ** 2 + (y - py) ** 2) AS dist,
               row_number() OVER (PARTITION BY point_id ORDER BY sqrt((x - px) ** 2 + (y - py) ** 2), region_id) AS rn
        FROM p, n) WHERE rn = 1""")
def nearest_region(spark, folder):
    k, s = c("c_custkey"), c("s_suppkey")
    nodes = table(spark, folder, "customer").select(
        c("c_nationkey").alias("region_id"), ((k * 7) % 500).cast("double").alias("x"), ((k * 13) % 371).cast("double").alias("y"))
    points = table(spark, folder, "supplier").select(
        s.alias("point_id"), ((s * 17) % 701 - F.lit(90.25)).alias("px"), ((s * 29) % 499 - F.lit(60.75)).alias("py"))
    return op.nearest_region(points, nodes)


@query("street_id:i x:d5 y:d5", f"""
    WITH v AS ({src.VERTEX_SQL}),
    s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS len,
                 lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY street_id ORDER BY seq)),
    t AS (SELECT *, sum(len) OVER (PARTITION BY street_id ORDER BY seq) AS cum,
                 sum(len) OVER (PARTITION BY street_id) AS total FROM s),
    h AS (SELECT *, row_number() OVER (PARTITION BY street_id ORDER BY seq) AS rn FROM t
          WHERE total <= 0 OR (cum >= total / 2 AND len > 0))
    SELECT street_id, CASE WHEN total <= 0 THEN x ELSE px + (total / 2 - cum + len) / nullif(len, 0) * (x - px) END AS x,
           CASE WHEN total <= 0 THEN y ELSE py + (total / 2 - cum + len) / nullif(len, 0) * (y - py) END AS y
    FROM h WHERE rn = 1""")
def path_midpoint(spark, folder):
    return op.path_midpoint(src.vertices(spark, folder), "street_id")


@query("region_id:i x0:d x1:d y0:d y1:d", """
    WITH b AS (SELECT c_nationkey AS region_id, min(c_custkey) AS x0, max(c_custkey) AS x1,
                      min(c_acctbal) AS y0, max(c_acctbal) AS y1 FROM customer GROUP BY 1)
    SELECT region_id, x0 - 0.05 * greatest(x1 - x0, y1 - y0, 1) AS x0, x1 + 0.05 * greatest(x1 - x0, y1 - y0, 1) AS x1,
           y0 - 0.05 * greatest(x1 - x0, y1 - y0, 1) AS y0, y1 + 0.05 * greatest(x1 - x0, y1 - y0, 1) AS y1 FROM b""")
def extent(spark, folder):
    rows = table(spark, folder, "customer").select(
        c("c_nationkey").alias("region_id"), c("c_custkey").cast("double").alias("x"), c("c_acctbal").alias("y"))
    return op.extent(rows, ["region_id"])
