"""Sources, datasets, coverage, routing and region answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.functions.config import config_frame
from regionflow.functions.units import convert_unit as convert
from regionflow.operators import network, registry as op, streets
from regionflow.queries import inputs as src
from regionflow.queries.base import query, table
from regionflow.queries.network import _EDGE_SQL, _edges
from regionflow.scale import spread
from regionflow.sources import writers

c = F.col


@query("dataset_id:i priority:i", """
    SELECT p_partkey AS dataset_id, p_size AS priority FROM part WHERE 'Brand#2' IN (p_brand, p_type)""")
def datasets_for(spark, folder):
    catalog = table(spark, folder, "part").select(
        c("p_partkey").alias("dataset_id"), F.array("p_brand", "p_type").alias("keys"),
        c("p_size").alias("priority"), c("p_partkey").alias("reg_order"))
    return op.datasets_for(catalog, "Brand#2")


def _scopes(spark, folder):
    return streets.dissolved_rings(src.strips(spark, folder), "dataset_id", "nation")


def _points(spark, folder):
    """Five nodes per region, spread over a few strips; some lie on strip borders."""
    k = c("c_custkey")
    return table(spark, folder, "customer").select(
        F.floor(k / 5).alias("region_id"), k.alias("node"),
        ((F.floor(k / 5) * 37 + k % 5 * 3) % 501).cast("double").alias("x"), k.cast("double").alias("y"))


_POINT_SQL = """
    SELECT c_custkey // 5 AS region_id, c_custkey AS node,
           CAST((c_custkey // 5 * 37 + c_custkey % 5 * 3) % 501 AS DOUBLE) AS x FROM customer"""


@query("node:i dataset_id:i", f"""
    SELECT DISTINCT node, dataset_id FROM ({_POINT_SQL}) p JOIN ({src.STRIPS_SQL}) s ON x BETWEEN x0 AND x1""")
def scope_covers(spark, folder):
    return op.scope_covers(_points(spark, folder), _scopes(spark, folder))


_COVERAGE_SQL = f"""
    WITH p AS ({_POINT_SQL}), hit AS (
        SELECT DISTINCT region_id, node, dataset_id FROM p JOIN ({src.STRIPS_SQL}) s ON x BETWEEN x0 AND x1),
    cov AS (SELECT p.region_id, d.dataset_id FROM p CROSS JOIN (SELECT r_regionkey AS dataset_id FROM region) d
            LEFT JOIN hit USING (region_id, node, dataset_id)
            GROUP BY 1, 2 HAVING bool_and(hit.node IS NOT NULL))"""
_COVERAGE_SQL = _COVERAGE_SQL.replace("LEFT JOIN hit USING (region_id, node, dataset_id)", """
            LEFT JOIN hit ON hit.region_id = p.region_id AND hit.node = p.node AND hit.dataset_id = d.dataset_id""")


@query("region_id:i dataset_id:i", _COVERAGE_SQL + " SELECT * FROM cov")
def region_coverage(spark, folder):
    return op.region_coverage(_points(spark, folder), _scopes(spark, folder))


def _catalog(spark, folder):
    """One scoped dataset per world region and an unscoped one with a middle priority."""
    scoped = table(spark, folder, "region").select(
        c("r_regionkey").alias("dataset_id"), F.array(F.lit("heat")).alias("keys"),
        (10 * (c("r_regionkey") + 1)).alias("priority"), c("r_regionkey").alias("reg_order"))
    everywhere = config_frame(spark, [(99, ["heat"], 25, 99)],
                              "dataset_id int, keys array<string>, priority int, reg_order int")
    return scoped.unionByName(everywhere)


@query("region_id:i dataset_id:i", _COVERAGE_SQL + """,
    cand AS (SELECT region_id, dataset_id, 10 * (dataset_id + 1) AS priority FROM cov
             UNION ALL SELECT DISTINCT region_id, 99, 25 FROM p)
    SELECT region_id, arg_max(dataset_id, priority) AS dataset_id FROM cand GROUP BY 1""")
def route(spark, folder):
    points, scopes = _points(spark, folder), _scopes(spark, folder)
    return op.route(points, op.region_coverage(points, scopes), _catalog(spark, folder), scopes, "heat")


_AREA_SCOPE_SQL = """
    SELECT c_custkey AS dataset_id, c_custkey % 50 AS x0, c_custkey % 50 + 100 + c_custkey % 7 AS x1, 50 + c_custkey % 11 AS y1
    FROM customer"""


@query("dataset_id:i", f"SELECT dataset_id FROM ({_AREA_SCOPE_SQL}) WHERE x0 <= 40 AND x1 >= 120 AND y1 >= 55")
def covering_area(spark, folder):
    k = c("c_custkey")
    scopes = table(spark, folder, "customer").select(
        k.alias("dataset_id"), geo.box(k % 50, 0, k % 50 + 100 + k % 7, 50 + k % 11).alias("rings"))
    area = spark.range(1).select(c("id").alias("area_id"), geo.box(40, 10, 120, 55).alias("rings"))
    return op.covering_area(area, scopes)


@query("dataset_id:i", f"""
    SELECT dataset_id FROM ({_AREA_SCOPE_SQL}) WHERE x0 <= 40 AND x1 >= 120 AND y1 >= 55
    ORDER BY dataset_id % 10 DESC, dataset_id LIMIT 1""")
def route_streets(spark, folder):
    k = c("c_custkey")
    customer = table(spark, folder, "customer")
    scopes = customer.select(k.alias("dataset_id"), geo.box(k % 50, 0, k % 50 + 100 + k % 7, 50 + k % 11).alias("rings"))
    catalog = customer.select(k.alias("dataset_id"), F.array(F.lit(op.STREET_NETWORK)).alias("keys"),
                              (k % 10).alias("priority"), k.alias("reg_order"))
    area = spark.range(1).select(c("id").alias("area_id"), geo.box(40, 10, 120, 55).alias("rings"))
    return config_frame(spark, [(op.route_streets(area, catalog, scopes),)], "dataset_id long")


@query("o_orderkey:i value:d9", """
    SELECT o_orderkey, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 END AS value FROM orders""")
def convert_unit(spark, folder):
    k = c("o_orderkey")
    rows = table(spark, folder, "orders").select(
        k, F.when(k % 4 != 3, c("o_totalprice")).alias("value"),
        F.element_at(F.array(F.lit("kWh"), F.lit("MWh"), F.lit("GWh"), F.lit("none")), (k % 4 + 1).cast("int")).alias("unit"))
    return convert(rows, "value", c("unit"), "MWh")


@query("region_id:i value:d", "SELECT DISTINCT c_custkey // 5 AS region_id, 2.5 AS value FROM customer")
def constant_dataset(spark, folder):
    return convert(op.constant_answer(_points(spark, folder), 2500.0), "value", "kWh", "MWh")


@query("street_id:i value:d2", """
    SELECT o_orderkey AS street_id, coalesce(a, 0) + coalesce(b, 0) AS value FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS a,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS b FROM orders)
    WHERE a IS NOT NULL OR b IS NOT NULL""")
def street_values(spark, folder):
    k = c("o_orderkey")
    rows = table(spark, folder, "orders").select(
        k, F.when(k % 3 != 0, c("o_totalprice")).alias("a"), F.when(k % 2 == 0, c("o_custkey")).alias("b"))
    return op.street_values(rows, "o_orderkey", ["a", "b"])


# The flagship: values keyed by street, over the network's edges, per region.
@query("region_id:i value:d3", f"""
    WITH e AS ({_EDGE_SQL}),
    v AS (SELECT o_orderkey AS street_id, o_totalprice + o_custkey AS value FROM orders WHERE o_orderkey % 3 <> 0)
    -- every third street has no value at all
    SELECT e.region_id, coalesce(sum(v.value * e.source_share), 0) / 1000 AS value
    FROM e LEFT JOIN v USING (street_id) GROUP BY 1""")
def street_value_by_region(spark, folder):
    k = c("o_orderkey")
    raw = table(spark, folder, "orders").select(k, *[
        F.when(k % 3 != 0, c(n)).alias(n) for n in ("o_totalprice", "o_custkey")])
    values = op.street_values(raw, "o_orderkey", ["o_totalprice", "o_custkey"])
    edges = _edges(spark, folder).select("u", "v", "region_id", "source_street_id", "source_share")
    answer = op.street_value_by_region(edges, values)
    return convert(answer, "value", "kWh", "MWh").orderBy("region_id")


_FEATURE_SQL = """
    SELECT c_custkey AS cell, CAST(c_custkey % 60 AS DOUBLE) AS x, CAST(c_custkey // 60 AS DOUBLE) AS y FROM customer"""
_HULLS_SQL = """
    SELECT s_suppkey AS region_id, (s_suppkey * 13) % 55 + 0.25 AS x0, (s_suppkey * 13) % 55 + 3.75 AS x1,
           (s_suppkey * 5) % 23 + 0.0 AS y0, (s_suppkey * 5) % 23 + 2.0 AS y1 FROM supplier"""


@query("cell:i region_id:i", f"""
    SELECT cell, region_id FROM ({_FEATURE_SQL}) f JOIN ({_HULLS_SQL}) h
    ON x <= x1 AND x + 1 >= x0 AND y <= y1 AND y + 1 >= y0""")
def fetch_in_region(spark, folder):
    k, s = c("c_custkey"), c("s_suppkey")
    x, y = k % 60, F.floor(k / 60)
    features = table(spark, folder, "customer").select(k.alias("cell"), geo.box(x, y, x + 1, y + 1).alias("rings"))
    x0, y0 = (s * 13) % 55 + F.lit(0.25), (s * 5) % 23
    hulls = table(spark, folder, "supplier").select(
        s.alias("region_id"), geo.box(x0, y0, x0 + 3.5, y0 + 2).alias("rings"))
    return op.fetch_in_region(features, hulls)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MAPPING = {"1-URGENT": "boiler", "2-HIGH": "boiler", "3-MEDIUM": "pump", "4-NOT SPECIFIED": None, "5-LOW": "exchanger"}


def cells(spark, folder):
    """One wide row of text counts per order: 1 in the order's category, sometimes unreadable."""
    k = c("o_orderkey")
    return table(spark, folder, "orders").select(
        c("o_custkey").alias("region_id"),
        *[F.when((c("o_orderpriority") == p) & (k % 97 == 0), "n/a").when(c("o_orderpriority") == p, "1")
          .otherwise("0").alias(p) for p in _PRIORITIES])


SHARE_SQL = """
    SELECT region_id, technology, CASE WHEN total > 0 THEN n / total ELSE 0 END AS share FROM (
        SELECT region_id, technology, n, sum(n) OVER (PARTITION BY region_id) AS total FROM (
            SELECT o.o_custkey AS region_id, t.technology,
                   CAST(count(*) FILTER (o.o_orderkey % 97 <> 0 AND p.technology = t.technology) AS DOUBLE) AS n
            FROM orders o
            LEFT JOIN (VALUES ('1-URGENT', 'boiler'), ('2-HIGH', 'boiler'), ('3-MEDIUM', 'pump'), ('5-LOW', 'exchanger'))
                 p(name, technology) ON p.name = o.o_orderpriority
            CROSS JOIN (VALUES ('boiler'), ('pump'), ('exchanger')) t(technology)
            GROUP BY 1, 2))"""


def shares(spark, folder):
    return op.category_shares(cells(spark, folder), _PRIORITIES, _MAPPING)


@query("region_id:i technology:s share:d9", SHARE_SQL)
def category_shares(spark, folder):
    return shares(spark, folder)


def _registry(spark, folder, key="heat"):
    """Street values of two datasets: one for the strips of world region 1, one for everywhere else."""
    k = c("c_custkey")
    values = table(spark, folder, "customer").select(
        F.concat(F.lit("H"), k.cast("string")).alias("street_id"), c("c_acctbal").alias("value"))
    scope = src.strips(spark, folder).filter("dataset_id = 1").select("rings")
    catalog = op.Registry(spark, 25832)
    catalog.register(op.StreetValueDataset(keys=[key], payload=values, unit="kWh", priority=20, scope=scope))
    catalog.register(op.ConstantDataset(keys=[key, "other"], value=3.0, unit="MWh"))
    return catalog


def _strip_regions(spark, folder):
    placed = network.assign_by_polygon(
        streets.add_lineage(src.grid_streets(spark, folder), "street_id"), src.strips(spark, folder), "street_id", "nation")
    return op.Regions(network.build_edges(placed, "street_id", ["source_share"]))


_QUERY_SQL = f"""
    WITH g AS ({src.GRID_SQL}),
    m AS (SELECT n_nationkey AS region_id, n_regionkey, flat, value FROM g
          JOIN nation ON x0 >= 20.0 * n_nationkey AND x1 <= 20.0 * n_nationkey + 20)
    SELECT region_id, CASE WHEN n_regionkey = 1 THEN sum(CASE WHEN flat THEN value ELSE 0 END) / 1000 ELSE 3.0 END AS value
    FROM m GROUP BY region_id, n_regionkey"""


@query("region_id:i value:d5", _QUERY_SQL)
def query_all(spark, folder):
    return _registry(spark, folder).query_all(_strip_regions(spark, folder), "heat", unit="MWh")


@query("region_id:i value:d", f"""
    SELECT region_id, 2.0 * count(*) AS value FROM ({src.GRID_SQL})
    JOIN (SELECT n_nationkey AS region_id FROM nation) ON x0 >= 20.0 * region_id AND x1 <= 20.0 * region_id + 20 GROUP BY 1""")
def query_function(spark, folder):
    def edges_times(payload, regions, params):
        counted = regions.edges.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
        return counted.select("region_id", (c("n") * params["factor"]).alias("value"))

    catalog = op.Registry(spark, 25832)
    catalog.register(op.Dataset(keys=["edges"], query_function=edges_times))
    return catalog.query_all(_strip_regions(spark, folder), "edges", {"factor": 2.0})


@query("key:s check:s passed:b rows:i missing:i", f"""
    WITH heat AS ({_QUERY_SQL}), share AS ({SHARE_SQL}), profile AS (
      SELECT event_type, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600) AS INT) AS hour, sum(value) AS value
      FROM events GROUP BY 1, 2),
    n(key, rows, missing) AS (
      SELECT 'residential_heat_demand', count(*), count(*) - count(value) FROM heat UNION ALL
      SELECT 'heating_shares', count(*), count(*) - count(share) FROM share UNION ALL
      SELECT 'residential_heat_demand_profile', count(*), count(*) - count(value) FROM profile UNION ALL
      SELECT 'street_network', count(*), 0 FROM ({src.GRID_SQL}))
    SELECT key, "check", rows IS NOT NULL AS passed, coalesce(rows, 0) AS rows, coalesce(missing, 0) AS missing
    FROM (VALUES
        ('residential_heat_demand_profile', 'hour is number'), ('residential_heat_demand_profile', 'value is number'),
        ('residential_electricity_demand_profile', 'hour is number'), ('residential_electricity_demand_profile', 'value is number'),
        ('residential_electricity_demand', 'region_id is any'), ('residential_electricity_demand', 'value is number'),
        ('residential_heat_demand', 'region_id is any'), ('residential_heat_demand', 'value is number'),
        ('heating_shares', 'region_id is any'), ('heating_shares', 'technology is string'),
        ('heating_shares', 'share is number'), ('street_network', 'parts is line'),
        ('linear_heat_density', 'parts is line'), ('linear_heat_density', 'heat_density_mwh_per_km is number'))
    t(key, "check") LEFT JOIN n USING (key)""")
def check_registry(spark, folder):
    """A registry that answers four of the built-in keys from the tables."""
    catalog = _registry(spark, folder, op.RESIDENTIAL_HEAT_DEMAND)
    catalog.register(op.Dataset(keys=[op.HEATING_SHARES], query_function=lambda payload, regions, params: shares(spark, folder)))
    catalog.register(op.Dataset(keys=[op.RESIDENTIAL_HEAT_DEMAND_PROFILE],
                                query_function=lambda payload, regions, params: src.profiles(spark, folder)))
    catalog.register_streets(streets.add_lineage(src.grid_streets(spark, folder), "street_id"))
    area = src.strips(spark, folder).filter("dataset_id = 1").select("rings")
    return op.check_registry(catalog, _strip_regions(spark, folder), area)


@query("k:i mx:d3 my:d3 lon:d7 lat:d7 x35:d3 y35:d3", """
    SELECT c_custkey AS k, 6378137.0 * radians(lon) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS my,
           lon, lat, 6378137.0 * radians(lon) AS x35, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y35
    FROM (SELECT c_custkey, 5 + (c_custkey * 7) % 1300 / 100.0 AS lon, 46 + (c_custkey * 13) % 900 / 100.0 AS lat FROM customer)""")
def reproject(spark, folder):
    """Forward to Web Mercator; to UTM zone 32 and back; to LAEA Europe and on to Web Mercator."""
    k = c("c_custkey")
    points = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey").select(
        k.alias("k"), geo.line((5 + (k * 7) % 1300 / F.lit(100.0), 46 + (k * 13) % 900 / F.lit(100.0))).alias("g"))
    first = lambda n: F.element_at(F.element_at(n, 1), 1)
    rows = points.withColumns({"m": c("g"), "u": c("g"), "e": c("g")})
    rows = op.reproject(rows, "m", 4326, 3857)
    rows = op.reproject(op.reproject(rows, "u", 4326, 25832), "u", 25832, 4326)
    rows = op.reproject(op.reproject(rows, "e", 4326, 3035), "e", 3035, 3857)
    return rows.select("k", first("m")["x"].alias("mx"), first("m")["y"].alias("my"), first("u")["x"].alias("lon"),
                       first("u")["y"].alias("lat"), first("e")["x"].alias("x35"), first("e")["y"].alias("y35"))


# --- series and boundaries -----------------------------------------------------------------------------

@query("name:s hour:i value:d4", f"""
    SELECT series AS name, hour, value FROM ({src.PROFILE_SQL})
    WHERE series IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END FROM customer) AND series <> 'view'""")
def resolve_static_series(spark, folder):
    k = c("c_custkey")
    referenced = table(spark, folder, "customer").select(F.when(k % 2 == 0, "click").otherwise("view").alias("name"))
    generated = config_frame(spark, [("view",)], "name string")
    available = src.profiles(spark, folder).withColumnRenamed("series", "name")
    return writers.resolve_static_series(referenced, generated, available)


@query("series:s hour:i value:d4", f"SELECT * FROM ({src.PROFILE_SQL}) WHERE hour % 4 = 0")
def select_time_steps(spark, folder):
    hours = spark.range(0, 8784, 4).select(F.lit("every fourth").alias("name"), c("id").cast("int").alias("hour"))
    return writers.select_time_steps(src.profiles(spark, folder), hours, "every fourth")


@query("ax:d ay:d bx:d by:d", """
    WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer),
    s AS (SELECT * FROM f WHERE code LIKE '12%' OR code LIKE '8%'),
    e AS (SELECT i AS ax, j AS ay, i + 1 AS bx, j AS "by" FROM s UNION ALL SELECT i, j + 1, i + 1, j + 1 FROM s
          UNION ALL SELECT i, j, i, j + 1 FROM s UNION ALL SELECT i + 1, j, i + 1, j + 1 FROM s)
    SELECT * FROM e GROUP BY ALL HAVING count(*) % 2 = 1""")
def select_boundaries(spark, folder):
    k = c("c_custkey")
    i, j = k % 40, F.floor(k / 40)
    features = table(spark, folder, "customer").select(
        k.cast("string").alias("code"), geo.box(i, j, i + 1, j + 1).alias("rings"))
    return streets.dissolve(writers.select_boundaries(features, ["1 2", "8 "]), [])
