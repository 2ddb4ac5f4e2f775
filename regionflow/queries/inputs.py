"""Inputs derived from the driver tables, each in Spark and as the same relation in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.queries.base import table
from regionflow.scale import running, spread

c = F.col


# Polylines from line items: one street per order, one vertex per item.
VERTEX_SQL = """
    SELECT l_orderkey AS street_id, 0 AS part,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seq,
           CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y
    FROM lineitem"""
SEGMENT_SQL = f"""
    SELECT * FROM (
        SELECT street_id, part, seq, x AS ax, y AS ay,
               lead(x) OVER w AS bx, lead(y) OVER w AS "by",
               sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS length
        FROM ({VERTEX_SQL}) WINDOW w AS (PARTITION BY street_id ORDER BY seq))
    WHERE bx IS NOT NULL"""


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(
        c("l_orderkey").alias("street_id"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = running(items, ["street_id"], ["l_linenumber", "l_partkey", "l_suppkey"], number="n")
    return rows.select("street_id", F.lit(0).alias("part"), (c("n") - 1).cast("int").alias("seq"),
                       c("l_partkey").cast("double").alias("x"), c("l_suppkey").cast("double").alias("y"))


# Streets with their value and region: order -> customer -> nation.
STREET_SQL = """
    SELECT o_orderkey AS street_id, o_totalprice AS price, c_nationkey AS region_id
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def street_facts(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return (orders.select("o_orderkey", "o_custkey", "o_totalprice")
            .join(customer.select(c("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
            .select(c("o_orderkey").alias("street_id"), c("o_totalprice").alias("price"),
                    c("c_nationkey").cast("bigint").alias("region_id")))


# Axis-aligned streets: one horizontal per customer, one vertical per supplier.
GRID_SQL = """
    SELECT 'H' || c_custkey AS street_id, CAST((c_custkey * 7) % 500 AS DOUBLE) AS x0,
           CAST(c_custkey AS DOUBLE) AS y0, CAST((c_custkey * 7) % 500 + 3 + 2 * c_nationkey AS DOUBLE) AS x1,
           CAST(c_custkey AS DOUBLE) AS y1, c_acctbal AS value, c_nationkey AS nation, TRUE AS flat
    FROM customer
    UNION ALL
    SELECT 'V' || s_suppkey, (s_suppkey * 11) % 500 + 0.5, s_suppkey * 15 - 40.0,
           (s_suppkey * 11) % 500 + 0.5, s_suppkey * 15 - 40.0 + 120.5, s_acctbal, s_nationkey, FALSE
    FROM supplier"""


def grid_streets(spark: SparkSession, folder: str) -> DataFrame:
    # what is done with a street costs far more than its row
    customer = spread(table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")
    supplier = table(spark, folder, "supplier")
    k, s = c("c_custkey"), c("s_suppkey")
    x0, xv, yv = (k * 7) % 500, (s * 11) % 500 + F.lit(0.5), s * 15 - F.lit(40.0)
    flat = customer.select(
        F.concat(F.lit("H"), k.cast("string")).alias("street_id"), c("c_acctbal").alias("value"),
        c("c_nationkey").alias("nation"), F.lit(False).alias("multi"),
        geo.line((x0, k), (x0 + 3 + 2 * c("c_nationkey"), k)).alias("parts"))
    steep = supplier.select(
        F.concat(F.lit("V"), s.cast("string")), c("s_acctbal"), c("s_nationkey"), F.lit(False),
        geo.line((xv, yv), (xv, yv + 120.5)))
    return flat.union(steep)


# Where the axis-aligned streets meet inside one of them: street, position along it.
GRID_CUTS_SQL = f"""
    WITH g AS ({GRID_SQL}),
    meet AS (SELECT h.street_id AS h, v.street_id AS v, v.x0 AS x, h.y0 AS y, h.x0 AS hx0, h.x1 AS hx1,
                    v.y0 AS vy0, v.y1 AS vy1
             FROM g h JOIN g v ON h.flat AND NOT v.flat
              AND v.x0 BETWEEN h.x0 AND h.x1 AND h.y0 BETWEEN v.y0 AND v.y1)
    SELECT h AS street_id, x - hx0 AS "at", x, y FROM meet WHERE x > hx0 AND x < hx1
    UNION
    SELECT v, y - vy0, x, y FROM meet WHERE y > vy0 AND y < vy1"""


# Bent streets: one L per order; every fifth has a second part.
BENT_SQL = """
    SELECT o_orderkey AS street_id, o_custkey AS customer, o_totalprice AS price,
           CAST(o_custkey % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 2 AS DOUBLE) AS y0,
           CAST(o_custkey % 500 + 3 + o_orderkey % 7 AS DOUBLE) AS x1,
           o_orderkey * 2 + 1.0 + o_orderkey % 3 * 0.25 AS y1, o_orderkey % 5 = 0 AS two
    FROM orders"""


def bent_streets(spark: SparkSession, folder: str) -> DataFrame:
    k = c("o_orderkey")
    x0, y0, x1 = c("o_custkey") % 500, k * 2, c("o_custkey") % 500 + 3 + k % 7
    y1 = k * 2 + F.lit(1.0) + (k % 3) * 0.25
    first = F.element_at(geo.line((x0, y0), (x1, y0), (x1, y1)), 1)
    second = F.element_at(geo.line((x0, y0 - 1), (x1, y0 - 1)), 1)
    return table(spark, folder, "orders").select(
        k.alias("street_id"), c("o_custkey").alias("customer"), c("o_totalprice").alias("price"),
        (k % 5 == 0).alias("multi"),
        F.when(k % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("parts"))


# Nation strips (closed boxes 20 wide) and the dataset scopes made of them.
STRIPS_SQL = """
    SELECT n_nationkey AS nation, n_regionkey AS dataset_id, 20.0 * n_nationkey AS x0, 20.0 * n_nationkey + 20 AS x1
    FROM nation"""
_LOW, _HIGH = -1e3, 1e9


def strips(spark: SparkSession, folder: str, width: float = 20.0) -> DataFrame:
    x0 = c("n_nationkey") * 20.0
    return table(spark, folder, "nation").select(
        c("n_nationkey").cast("bigint").alias("nation"), c("n_regionkey").alias("dataset_id"),
        geo.box(x0, _LOW, x0 + width, _HIGH).alias("rings"))


# Region graph on customers: blocks of ten with steps of one and three; lengths whose subset sums
# are all different inside a block.
CONN_SQL = """
    SELECT c_custkey AS a, c_custkey + step AS b,
           ((c_custkey * 31 + (c_custkey + step) * 17) % 97) + 1.0
             + pow(2.0, -1.0 - (c_custkey % 10) - CASE WHEN step = 3 THEN 9 ELSE 0 END) AS length
    FROM customer, (VALUES (1), (3)) s(step)
    WHERE c_custkey % 10 + step < 10
      AND c_custkey + step <= (SELECT max(c_custkey) FROM customer)"""


def connections(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey")
    last = customer.agg(F.max("c_custkey").alias("m")).first()["m"]
    k, step = c("c_custkey"), c("step")
    rows = customer.withColumn("step", F.explode(F.lit([1, 3]))).filter((k % 10 + step < 10) & (k + step <= last))
    fraction = F.pow(F.lit(2.0), -1.0 - (k % 10) - F.when(step == 3, 9).otherwise(0))
    return rows.select(k.alias("a"), (k + step).cast("bigint").alias("b"),
                       ((k * 31 + (k + step) * 17) % 97 + F.lit(1.0) + fraction).alias("length"))


# Grid capacity per region (customer): positive balances are active.
CAPACITY_SQL = "SELECT c_custkey AS region_id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS capacity FROM customer"


def capacities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        c("c_custkey").alias("region_id"), F.greatest(c("c_acctbal"), F.lit(0.0)).alias("capacity"))


# The region graph as a street network: three owned edges per block, all others belong to nobody.
NET_SQL = f"""
    SELECT a, b, length, CASE WHEN b = a + 1 AND a % 10 IN (0, 4, 8) THEN a // 10 * 3 + a % 10 // 4 END AS region_id
    FROM ({CONN_SQL})"""


def owned_network(spark: SparkSession, folder: str) -> DataFrame:
    a, b = c("a"), c("b")
    owner = F.when((b == a + 1) & (a % 10).isin(0, 4, 8),
                   F.floor(a / 10) * 3 + F.floor((a % 10) / 4)).cast("bigint")
    at = lambda n: geo.point(n, F.lit(0.0))
    return connections(spark, folder).select(
        at(a).alias("u"), at(b).alias("v"), "length", owner.alias("region_id"), a.alias("source_street_id"))


# Profiles: event values per type and hour of January 2024; absent hours stay absent.
PROFILE_SQL = """
    SELECT event_type AS series, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS hour,
           sum(value) AS value
    FROM events GROUP BY ALL"""


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    return (table(spark, folder, "events").groupBy(c("event_type").alias("series"), hour.cast("int").alias("hour"))
            .agg(F.sum("value").alias("value")))


# Demands per customer: heat from even, pool from odd order keys, in MWh.
DEMAND_SQL = """
    SELECT o_custkey AS region_id, CASE WHEN o_orderkey % 2 = 0 THEN 'heat' ELSE 'pool' END AS demand,
           sum(o_totalprice) / 1000.0 AS value
    FROM orders GROUP BY ALL"""
DEMAND_TYPE_SQL = """
    SELECT * FROM (VALUES (0, 'heat', 'warmth', FALSE, 0.02), (1, 'pool', 'water', TRUE, 0.0),
                          (2, 'light', 'power', FALSE, 0.01))
             t(demand_ord, demand, commodity, cooperation, yearly_decrease)"""
SERIES_SQL = """
    SELECT c_custkey AS region_id, d.demand,
           CASE WHEN d.demand = 'pool' THEN 'view' WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'error' END AS series
    FROM customer, (VALUES ('heat'), ('pool'), ('light')) d(demand)"""
