"""Demands, technology mixes, assets and their trajectories; every customer is a region."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions.config import config_frame
from regionflow.operators import catalog, energy as op
from regionflow.queries import inputs as src
from regionflow.queries import registry as reg
from regionflow.queries.base import query, table
from regionflow.scale import cut_lineage

c = F.col

_POWER = dict(opex_cost_energy=0.0, opex_cost_power=12.5, capex_cost_power=430.75)
TYPES = [
    dict(kind="decentral", name="boiler", commodity_in="gas", commodity_out="warmth", efficiency=0.9,
         technical_lifetime=20, lifetime_existing=20.0, **_POWER),
    dict(kind="decentral", name="pump", commodity_in="power", commodity_out="warmth", efficiency=2.9,
         technical_lifetime=18, lifetime_existing=20.0, **_POWER),
    dict(kind="decentral", name="exchanger", commodity_in="heat_out", commodity_out="warmth", efficiency=0.97,
         technical_lifetime=25, lifetime_existing=25.0, **_POWER),
    dict(kind="decentral", name="pool_heater", commodity_in="power", commodity_out="water", efficiency=1.0,
         technical_lifetime=25, lifetime_existing=25.0, **_POWER),
    dict(kind="central", name="plant", commodity_in="gas", commodity_out="heat_in", efficiency=0.95,
         technical_lifetime=25, capex_cost_base=150000.0, max_capacity={0: 4000.0, 5: 9000.0},
         max_capacity_per_unit=500.0, lifetime_existing=25.0, **_POWER),
    dict(kind="central", name="sewage", commodity_in="power", commodity_out="heat_in", efficiency=2.8,
         technical_lifetime=20, capex_cost_base=60000.0, max_capacity=1500.0, streets=["H7", "H12", "H40"],
         availability_profile="flow", lifetime_existing=15.0, **_POWER),
    dict(kind="chp", name="cogen", commodity_in="gas", commodity_out="heat_in", commodity_out_2="power",
         efficiency=0.48, loss=0.11, technical_lifetime=15, capex_cost_base=0.0, lifetime_existing=15.0, **_POWER),
    dict(kind="grid", name="heat_grid", commodity_in="heat_in", commodity_out="heat_out", efficiency=0.88,
         technical_lifetime=40, capex_per_km=1000000.0, lifetime_existing=40.0),
    dict(kind="pipe", name="heat_pipe", commodity_in="heat_out", commodity_out="heat_in", efficiency=0.95,
         technical_lifetime=40, capex_per_km=1000000.0, distance_threshold_m=20.0, lifetime_existing=40.0),
]
TYPE_SQL = """
    SELECT * FROM (VALUES
        (0, 'decentral', 'boiler', 'gas', 'warmth', 0.9, 20.0), (1, 'decentral', 'pump', 'power', 'warmth', 2.9, 20.0),
        (2, 'decentral', 'exchanger', 'heat_out', 'warmth', 0.97, 25.0),
        (3, 'decentral', 'pool_heater', 'power', 'water', 1.0, 25.0),
        (4, 'central', 'plant', 'gas', 'heat_in', 0.95, 25.0), (5, 'central', 'sewage', 'power', 'heat_in', 2.8, 15.0),
        (6, 'chp', 'cogen', 'gas', 'heat_in', 0.48, 15.0), (7, 'grid', 'heat_grid', 'heat_in', 'heat_out', 0.88, 40.0),
        (8, 'pipe', 'heat_pipe', 'heat_out', 'heat_in', 0.95, 40.0))
    t(ord, kind, name, commodity_in, commodity_out, efficiency, lifetime)"""
DEMAND_TYPES = [
    catalog.DemandType("heat", "warmth", False, 0.02, default_supply="boiler"),
    catalog.DemandType("pool", "water", True, 0.0, default_supply=[("pool_heater", 1.0)]),
    catalog.DemandType("light", "power", False, 0.01),
]


def types(spark):
    return catalog.type_frame(spark, TYPES)


def values(spark, folder):
    return table(spark, folder, "orders").groupBy(
        c("o_custkey").alias("region_id"), F.when(c("o_orderkey") % 2 == 0, "heat").otherwise("pool").alias("demand")).agg(
        (F.sum("o_totalprice") / 1000.0).alias("value"))


def demands(spark, folder):
    k = c("c_custkey")
    series = table(spark, folder, "customer").select(
        k.alias("region_id"), F.explode(F.lit(["heat", "pool", "light"])).alias("demand")).withColumn(
        "series", F.when(c("demand") == "pool", "view").when(c("region_id") % 2 == 0, "click").otherwise("error"))
    found = op.build_demands(values(spark, folder), series, catalog.demand_type_frame(spark, DEMAND_TYPES))
    return cut_lineage(op.peak(found, src.profiles(spark, folder)))


_DEMANDS = f"""
    prof AS ({src.PROFILE_SQL}), peaks AS (SELECT series, max(value) / sum(value) AS top FROM prof GROUP BY 1),
    dem AS (SELECT v.region_id, v.demand, t.commodity, v.value, s.series, t.demand_ord, t.cooperation, t.yearly_decrease,
                   v.value * top AS peak
            FROM ({src.DEMAND_SQL}) v JOIN ({src.DEMAND_TYPE_SQL}) t USING (demand)
            LEFT JOIN ({src.SERIES_SQL}) s USING (region_id, demand) LEFT JOIN peaks USING (series))"""


@query("region_id:i demand:s commodity:s value:d3 series:s", f"""
    WITH {_DEMANDS} SELECT * FROM dem""")
def build_demands(spark, folder):
    return demands(spark, folder)


@query("series:s hour:i value:d9", f"""
    SELECT series, hour, value / sum(value) OVER (PARTITION BY series) AS value FROM ({src.PROFILE_SQL})""")
def normalise_profile(spark, folder):
    return op.normalise_profile(src.profiles(spark, folder))


@query("region_id:i demand:s peak:d6", f"WITH {_DEMANDS} SELECT * FROM dem")
def peak(spark, folder):
    return demands(spark, folder)


@query("region_id:i demand:s year:i value:d5", f"""
    WITH {_DEMANDS} SELECT region_id, demand, year, value * pow(1 - yearly_decrease, year - 2025) AS value
    FROM dem, (VALUES (2025), (2030), (2035)) y(year)""")
def demand_by_year(spark, folder):
    return op.demand_by_year(demands(spark, folder), catalog.Scenario("s", 2025, 2037, 5, 1, "t").years)


@query("region_id:i demand:s technology:s share:d", f"""
    SELECT region_id, demand, CASE demand WHEN 'heat' THEN 'boiler' ELSE 'pool_heater' END AS technology, 1.0 AS share
    FROM ({src.DEMAND_SQL})""")
def default_mix(spark, folder):
    return values(spark, folder).join(catalog.default_mix(spark, DEMAND_TYPES), "demand")


# --- shares -------------------------------------------------------------------------------------------

def heat_shares(spark, folder):
    """Mapped shares of the heat demand; every eleventh region has none."""
    rows = reg.shares(spark, folder).withColumn("demand", F.lit("heat"))
    return rows.withColumn("share", F.when(c("region_id") % 11 == 0, 0.0).otherwise(c("share")))


_SHARES = f"""
    sh AS (SELECT region_id, 'heat' AS demand, technology, CASE WHEN region_id % 11 = 0 THEN 0 ELSE share END AS share
           FROM ({reg.SHARE_SQL}))"""
_MINIMUM = {"exchanger": 0.25, "pump": 0.1}
_MIN = """
    low AS (SELECT region_id, demand, technology, CASE WHEN (technology = 'exchanger' AND share < 0.25)
                OR (technology = 'pump' AND share < 0.1) THEN 0 ELSE share END AS share FROM sh)"""
_FORCED = """
    forced AS (SELECT c_custkey AS region_id, 'exchanger' AS technology, 0.8 AS forced FROM customer WHERE c_custkey % 5 = 0
               UNION ALL SELECT c_custkey, 'pump', 0.2 FROM customer WHERE c_custkey % 10 = 0
               UNION ALL SELECT c_custkey, 'plant', 0.5 FROM customer WHERE c_custkey % 5 = 1)"""


def _forced(spark, folder):
    k = c("c_custkey")
    row = lambda when, name, share: F.when(when, F.struct(F.lit(name).alias("technology"), F.lit(share).alias("forced")))
    rows = F.array(row(k % 5 == 0, "exchanger", 0.8), row(k % 10 == 0, "pump", 0.2), row(k % 5 == 1, "plant", 0.5))
    return table(spark, folder, "customer").select(
        k.alias("region_id"), F.inline(F.filter(rows, lambda r: r.isNotNull())))


def _serving(spark):
    return op.serving_types(types(spark), catalog.demand_type_frame(spark, DEMAND_TYPES))


@query("region_id:i technology:s share:d9", f"WITH {_SHARES}, {_MIN} SELECT * FROM low")
def apply_minimum(spark, folder):
    return op.apply_minimum(heat_shares(spark, folder), _MINIMUM)


_FORCE = f"""
    f AS (SELECT coalesce(s.region_id, f.region_id) AS region_id, coalesce(s.technology, f.technology) AS technology,
                 s.share, f.forced
          FROM low s FULL JOIN (SELECT * FROM forced WHERE technology <> 'plant'
                                AND region_id IN (SELECT region_id FROM low)) f
          ON s.region_id = f.region_id AND s.technology = f.technology),
    w AS (SELECT *, sum(forced) OVER (PARTITION BY region_id) AS fixed,
                 sum(CASE WHEN forced IS NULL THEN share END) OVER (PARTITION BY region_id) AS free FROM f),
    mixed AS (SELECT region_id, 'heat' AS demand, technology,
                     CASE WHEN fixed IS NULL THEN share WHEN forced IS NOT NULL THEN forced
                          WHEN free > 0 AND abs(1 - fixed) > 1e-8 THEN share * (1 - fixed) / free ELSE 0 END AS share,
                     fixed IS NOT NULL AS has_forced FROM w)"""


@query("region_id:i technology:s share:d9 has_forced:b", f"WITH {_SHARES}, {_MIN}, {_FORCED}, {_FORCE} SELECT * FROM mixed")
def apply_forced(spark, folder):
    low = op.apply_minimum(heat_shares(spark, folder), _MINIMUM)
    return op.apply_forced(low, _forced(spark, folder), _serving(spark))


@query("region_id:i technology:s share:d9", f"""
    WITH {_SHARES}, {_MIN} SELECT region_id, technology, share / nullif(sum(share) OVER (PARTITION BY region_id), 0) AS share FROM low""")
def normalise_shares(spark, folder):
    return op.normalise_shares(op.apply_minimum(heat_shares(spark, folder), _MINIMUM))


@query("region_id:i demand:s technology:s share:d9 is_default:b", f"""
    WITH {_SHARES}, heated AS (SELECT region_id FROM ({src.DEMAND_SQL}) WHERE demand = 'heat'), empty AS (SELECT region_id FROM sh WHERE region_id IN (SELECT region_id FROM heated) GROUP BY 1 HAVING sum(share) < 1e-8)
    SELECT region_id, demand, technology, share, FALSE AS is_default FROM sh WHERE region_id NOT IN (FROM empty)
    UNION ALL SELECT region_id, 'heat', 'boiler', 1.0, TRUE FROM ({src.DEMAND_SQL})
    WHERE demand = 'heat' AND (region_id IN (FROM empty) OR region_id NOT IN (SELECT region_id FROM sh))
    UNION ALL SELECT region_id, 'pool', 'pool_heater', 1.0, TRUE FROM ({src.DEMAND_SQL}) WHERE demand = 'pool'""")
def fallback_mix(spark, folder):
    found = demands(spark, folder)
    return op.fallback_mix(heat_shares(spark, folder), found, catalog.default_mix(spark, DEMAND_TYPES))


def mix(spark, folder, found=None):
    found = demands(spark, folder) if found is None else found
    own = heat_shares(spark, folder).join(
        found.filter("demand = 'heat'").select("region_id"), "region_id", "left_semi")
    return cut_lineage(op.technology_mix(own, found, catalog.default_mix(spark, DEMAND_TYPES), _serving(spark),
                                         _MINIMUM, _forced(spark, folder)))


# The mix rule by rule: default where there is nothing, forced where forced, else normalised, else default.
_MIX = f"""
    own AS (SELECT * FROM sh WHERE region_id IN (SELECT region_id FROM dem WHERE demand = 'heat')),
    has AS (SELECT region_id FROM own GROUP BY 1 HAVING sum(share) >= 1e-8),
    low AS (SELECT region_id, demand, technology, CASE WHEN (technology = 'exchanger' AND share < 0.25)
                OR (technology = 'pump' AND share < 0.1) THEN 0 ELSE share END AS share
            FROM own WHERE region_id IN (FROM has)),
    {_FORCED}, {_FORCE},
    tot AS (SELECT *, sum(share) OVER (PARTITION BY region_id) AS total FROM mixed),
    mix AS (SELECT region_id, demand, technology, CASE WHEN has_forced THEN share ELSE share / total END AS share
            FROM tot WHERE has_forced OR total > 0
            UNION ALL SELECT DISTINCT region_id, demand, 'boiler', 1.0 FROM tot WHERE NOT has_forced AND total = 0
            UNION ALL SELECT region_id, 'heat', 'boiler', 1.0 FROM dem WHERE demand = 'heat' AND region_id NOT IN (FROM has)
            UNION ALL SELECT region_id, 'pool', 'pool_heater', 1.0 FROM dem WHERE demand = 'pool')"""


@query("region_id:i demand:s technology:s share:d9", f"WITH {_DEMANDS}, {_SHARES}, {_MIX} SELECT * FROM mix")
def technology_mix(spark, folder):
    return mix(spark, folder)


# --- assets -------------------------------------------------------------------------------------------------

DECENTRAL_SQL = f"""
    {_DEMANDS}, {_SHARES}, {_MIX}, ty AS ({TYPE_SQL}),
    dec AS (SELECT d.region_id, d.demand, d.demand_ord, t.name, t.commodity_in, t.commodity_out, t.efficiency, t.ord,
                   coalesce(m.share, 0) * d.peak * 1000 AS existing_capacity,
                   coalesce(m.share, 0) * d.value AS existing_energy_output,
                   CASE WHEN NOT d.cooperation THEN d.series END AS series, t.lifetime
            FROM dem d JOIN ty t ON t.kind = 'decentral' AND t.commodity_out = d.commodity
            LEFT JOIN mix m ON m.region_id = d.region_id AND m.demand = d.demand AND m.technology = t.name)"""


def decentral(spark, folder):
    found = demands(spark, folder)
    return cut_lineage(op.decentral_assets(found, mix(spark, folder, found), types(spark)))


@query("region_id:i demand:s name:s existing_capacity:d4 existing_energy_output:d11 series:s",
       f"WITH {DECENTRAL_SQL} SELECT * FROM dec")
def decentral_assets(spark, folder):
    return decentral(spark, folder)


LENGTH_SQL = "SELECT c_custkey AS region_id, 100.0 + c_custkey % 37 AS length FROM customer"


def lengths(spark, folder):
    k = c("c_custkey")
    return table(spark, folder, "customer").select(k.alias("region_id"), (100.0 + k % 37).alias("length"))


def records(kind):
    return [r for r in TYPES if r["kind"] == kind]


def grids(spark, folder, fed=None):
    fed = decentral(spark, folder) if fed is None else fed
    return op.grid_assets(lengths(spark, folder), fed, records("grid"), op.of_kind(types(spark), "grid"))


GRID_SQL = f"""
    {DECENTRAL_SQL},
    grd AS (SELECT l.region_id, 'heat_grid' AS name, l.length / 1000 AS length_km,
                   coalesce((SELECT sum(existing_capacity / efficiency) FROM dec
                             WHERE dec.region_id = l.region_id AND commodity_in = 'heat_out'), 0) AS existing_capacity
            FROM ({LENGTH_SQL}) l)"""


@query("region_id:i name:s length_km:d existing_capacity:d4", f"WITH {GRID_SQL} SELECT * FROM grd")
def grid_assets(spark, folder):
    return grids(spark, folder)


@query("region_id:i name:s investment:d2", f"""
    SELECT region_id, 'heat_grid' AS name, length / 1000 * 1000000 AS investment FROM ({LENGTH_SQL})""")
def grid_cost(spark, folder):
    return op.grid_cost(grids(spark, folder))


@query("region_id:i name:s kind:s", f"""
    SELECT c_custkey AS region_id, name, kind FROM customer, ({TYPE_SQL})
    WHERE kind IN ('central', 'chp') AND commodity_out = CASE WHEN c_custkey % 3 = 0 THEN 'heat_in' ELSE 'warmth' END""")
def match_types(spark, folder):
    """Central types by the commodity each region asks for; CHPs count as central."""
    asked = table(spark, folder, "customer").select(
        c("c_custkey").alias("region_id"),
        F.when(c("c_custkey") % 3 == 0, "heat_in").otherwise("warmth").alias("commodity_out"))
    found = catalog.match_types(types(spark), "central", "commodity_out", "heat_in")
    return asked.join(found, "commodity_out")


@query("pipe:s grid:s", """
    SELECT p.p_partkey || 'p' AS pipe, min_by(g.p_partkey || 'g', g.p_partkey) AS grid FROM part p JOIN part g
    ON p.p_partkey % 2 = 0 AND g.p_partkey % 2 = 1 AND p.p_brand = g.p_type || g.p_brand[7:] AND FALSE GROUP BY 1
    UNION ALL SELECT p.p_partkey || 'p', (SELECT min(g.p_partkey) FROM part g WHERE g.p_partkey % 2 = 1
        AND g.p_brand = p.p_brand AND g.p_type = p.p_type) || 'g' FROM part p WHERE p.p_partkey % 2 = 0""")
def pipe_to_grid(spark, folder):
    """Parts as pipe (even) and grid (odd) types between their brand and type commodities."""
    k = c("p_partkey")
    even = k % 2 == 0
    rows = table(spark, folder, "part").select(
        F.when(even, "pipe").otherwise("grid").alias("kind"), k.alias("ord"),
        F.concat(k.cast("string"), F.when(even, "p").otherwise("g")).alias("name"),
        F.when(even, c("p_brand")).otherwise(c("p_type")).alias("commodity_in"),
        F.when(even, c("p_type")).otherwise(c("p_brand")).alias("commodity_out"))
    return op.pipe_to_grid(rows, strict=False)


def _street_edges(spark, folder):
    k = c("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("H"), k.cast("string")).alias("source_street_id"), F.floor(k / 4).alias("region_id"))


@query("technology:s region_id:i", """
    SELECT DISTINCT 'sewage' AS technology, c_custkey // 4 AS region_id FROM customer WHERE c_custkey IN (7, 12, 40)""")
def street_constraint(spark, folder):
    return op.street_constraint(types(spark), _street_edges(spark, folder))


def placed(spark, folder):
    """Every region is a location; the plants of every fifth have an availability profile of their own."""
    region = F.floor(c("c_custkey") / 4)
    regions = table(spark, folder, "customer").select(region.alias("region_id")).distinct()
    allowed = op.street_constraint(types(spark), _street_edges(spark, folder))
    own = regions.filter(c("region_id") % 5 == 0).select(
        F.lit("plant").alias("technology"), "region_id", F.concat(F.lit("flow_"), c("region_id").cast("string")).alias(
            "availability_profile"), F.lit(None).cast("string").alias("output_profile"))
    return op.place_central(regions.select(F.lit("heat_in").alias("commodity"), "region_id"), types(spark), allowed, own)


PLACED_SQL = """
    plc AS (SELECT r.region_id, t.name, t.kind, CASE WHEN t.name = 'sewage' THEN 'flow'
                WHEN t.name = 'plant' AND r.region_id % 5 = 0 THEN 'flow_' || r.region_id END AS availability_profile
            FROM (SELECT DISTINCT c_custkey // 4 AS region_id FROM customer) r,
            (VALUES ('plant', 'central'), ('sewage', 'central'), ('cogen', 'chp')) t(name, kind)
            WHERE t.name <> 'sewage' OR r.region_id IN (1, 3, 10))"""


@query("region_id:i name:s kind:s availability_profile:s", f"WITH {PLACED_SQL} SELECT * FROM plc")
def place_central(spark, folder):
    return placed(spark, folder)


def central(spark, folder):
    sources = table(spark, folder, "customer").groupBy(
        F.lit("heat_in").alias("commodity"), F.floor(c("c_custkey") / 4).alias("region_id")).agg(
        F.sum(F.greatest(c("c_acctbal"), F.lit(0.0)) / 10).alias("total"))
    given = [("heat_in", None, "plant", 0.8), ("heat_in", None, "cogen", 0.2), ("heat_in", 1, "cogen", 1.0),
             ("heat_in", 3, "sewage", 0.5), ("heat_in", 3, "plant", 0.5)]
    shares = config_frame(spark, given, "commodity string, region_id long, technology string, share double")
    return op.distribute_capacity(placed(spark, folder), sources, shares)


CENTRAL_SQL = f"""
    {PLACED_SQL},
    cen AS (SELECT region_id, name, kind, availability_profile, total * CASE
                WHEN region_id = 1 THEN CASE WHEN name = 'cogen' THEN 1.0 ELSE 0 END
                WHEN region_id = 3 THEN CASE WHEN name IN ('sewage', 'plant') THEN 0.5 ELSE 0 END
                WHEN name = 'plant' THEN 0.8 WHEN name = 'cogen' THEN 0.2 ELSE 0 END AS existing_capacity
            FROM plc JOIN (SELECT c_custkey // 4 AS region_id, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal / 10 ELSE 0 END) AS total
                           FROM customer GROUP BY 1) USING (region_id))"""


@query("region_id:i name:s existing_capacity:d4", f"WITH {CENTRAL_SQL} SELECT * FROM cen")
def distribute_capacity(spark, folder):
    return central(spark, folder)


def pipes(spark, folder):
    rows = op.pipe_assets(src.connections(spark, folder), records("pipe"), op.of_kind(types(spark), "pipe"))
    # the smaller region's balance is the capacity of the pipe out of it
    cap = src.capacities(spark, folder).select(c("region_id").alias("region_in"), c("capacity"))
    return rows.join(cap, "region_in").withColumn(
        "existing_capacity", F.when(c("region_in") < c("region_out"), c("capacity")).otherwise(0.0)).drop("capacity")


PIPE_SQL = f"""
    pip AS (SELECT 'heat_pipe' AS name, d.i AS region_in, d.o AS region_out, length / 1000 AS length_km,
                   CASE WHEN length < 20 THEN 0 ELSE 1000000 * (length / 1000) END AS investment,
                   CASE WHEN d.i < d.o THEN capacity ELSE 0 END AS existing_capacity
            FROM (SELECT a AS i, b AS o, length FROM ({src.CONN_SQL}) UNION ALL SELECT b, a, length FROM ({src.CONN_SQL})) d
            JOIN ({src.CAPACITY_SQL}) k ON k.region_id = d.i)"""


@query("name:s region_in:i region_out:i length_km:x investment:d4", f"WITH {PIPE_SQL} SELECT * FROM pip")
def pipe_assets(spark, folder):
    return pipes(spark, folder)


@query("name:s lo:i hi:i length_km:x", f"""
    SELECT 'heat_pipe' AS name, a AS lo, b AS hi, length / 1000 AS length_km FROM ({src.CONN_SQL})""")
def pipe_summary(spark, folder):
    return op.pipe_summary(pipes(spark, folder))


# --- trajectories ------------------------------------------------------------------------------------------

def all_assets(spark, folder):
    fed = decentral(spark, folder)
    return cut_lineage(op.asset_table(fed, grids(spark, folder, fed), central(spark, folder)))


ASSET_SQL = f"""
    {GRID_SQL}, {CENTRAL_SQL},
    ast AS (SELECT 'decentral' AS kind, name, region_id, demand, existing_capacity FROM dec
            UNION ALL SELECT 'grid', name, region_id, NULL, existing_capacity FROM grd
            UNION ALL SELECT kind, name, region_id, NULL, existing_capacity FROM cen)"""


@query("kind:s name:s region_id:i demand:s existing_capacity:d4", f"WITH {ASSET_SQL} SELECT * FROM ast")
def asset_table(spark, folder):
    return all_assets(spark, folder)


@query("kind:s name:s region_id:i year:i value:d4", f"""
    WITH {ASSET_SQL}, life AS (SELECT name, lifetime FROM ({TYPE_SQL})),
    old AS (SELECT * FROM ast JOIN life USING (name) WHERE existing_capacity <> 0)
    SELECT kind, name, region_id, 2025 AS year, existing_capacity AS value FROM old
    UNION ALL SELECT kind, name, region_id, 2025 + lifetime - 1, existing_capacity FROM old WHERE kind <> 'decentral'
    UNION ALL SELECT kind, name, region_id, 2025 + lifetime, 0.0 FROM old""")
def capacity_trajectory(spark, folder):
    rows = op.capacity_trajectory(all_assets(spark, folder), 2025)
    return op.long_trajectory(rows, "capacity", "kind", "name", "region_id")


@query("kind:s name:s region_id:i year:i value:d4", f"""
    WITH {ASSET_SQL}
    SELECT kind, name, region_id, 2025 AS year, existing_capacity AS value FROM ast
    UNION ALL SELECT kind, name, region_id, y, v FROM ast JOIN (VALUES
        ('boiler', 2026, NULL), ('pump', 2026, NULL), ('exchanger', 2026, NULL), ('pool_heater', 2026, NULL),
        ('heat_grid', 2026, NULL), ('plant', 2026, 4000.0), ('plant', 2030, 9000.0), ('sewage', 2026, 1500.0),
        ('cogen', 2026, NULL)) m(name, y, v) USING (name)""")
def max_capacity_trajectory(spark, folder):
    rows = op.max_capacity_trajectory(all_assets(spark, folder), 2025)
    return op.long_trajectory(rows, "capacity_limit", "kind", "name", "region_id")


@query("name:s region_id:i existing_capacity:d4", f"""
    WITH {CENTRAL_SQL} SELECT name, region_id, existing_capacity * 9 AS existing_capacity FROM cen
    WHERE (name = 'plant' AND existing_capacity * 9 > 4000) OR (name = 'sewage' AND existing_capacity * 9 > 1500)""")
def existing_within_max(spark, folder):
    rows = central(spark, folder).withColumn("existing_capacity", c("existing_capacity") * 9)
    return op.existing_within_max(rows)


@query("region_id:i year:i value:d2 late:b", """
    SELECT o_orderkey AS region_id, 2025 + o_orderkey % 105 AS year, o_totalprice AS value, o_orderkey % 105 > 100 AS late FROM orders
    UNION ALL SELECT o_orderkey, 2025, 1.0, o_orderkey % 105 > 100 FROM orders""")
def rebase_years(spark, folder):
    k = c("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("region_id"), F.array(
        F.struct((k % 105).cast("int").alias("year"), c("o_totalprice").alias("value")),
        F.struct(F.lit(0).alias("year"), F.lit(1.0).alias("value"))).alias("price"))
    late = op.late_years(rows, ["price"]).select("region_id", F.lit(True).alias("late"))
    return (rows.withColumn("price", op.rebase_years(c("price"), 2025)).select("region_id", F.inline("price"))
            .join(late, "region_id", "left").withColumn("late", F.coalesce("late", F.lit(False))))


TRADE = [dict(kind="Import", commodity="gas", price={0: 60.0, 20: 85.5}, co2=0.2, max_cap=1000.0, max_energy={0: 900.0, 5: 100.0}),
         dict(kind="Import", commodity="power", price=120.0, max_energy={3: 1e12}),
         dict(kind="Export", commodity="power", price={0: -40.0}, max_cap={0: 10.0, 5: 20.0}, max_energy=500.0)]


@query("commodity:s severity:s rule:s limit:d2 needed:d2", f"""
    WITH {ASSET_SQL}, use AS (
        SELECT t.commodity_in AS commodity, sum(a.existing_capacity / t.efficiency) AS power,
               sum(CASE WHEN a.kind = 'decentral' THEN e.out / t.efficiency END) AS energy,
               count(*) FILTER (a.kind <> 'decentral' AND a.existing_capacity > 0) AS central
        FROM ast a JOIN ty t USING (name)
        LEFT JOIN (SELECT name, region_id, demand, existing_energy_output AS out FROM dec) e
          ON e.name = a.name AND e.region_id = a.region_id AND e.demand = a.demand
        WHERE a.kind <> 'grid' GROUP BY 1)
    SELECT commodity, 'error' AS severity, 'capacity' AS rule, 1000.0 AS "limit", power AS needed FROM use WHERE commodity = 'gas' AND power > 1000
    UNION ALL SELECT commodity, 'error', 'energy', 900.0, energy FROM use WHERE commodity = 'gas' AND energy > 900
    UNION ALL SELECT commodity, 'error', 'energy', 1e12, energy FROM use WHERE commodity = 'power' AND energy > 1e12
    UNION ALL SELECT commodity, 'warning', 'central', CASE commodity WHEN 'gas' THEN 900 ELSE 1e12 END, central FROM use
    WHERE commodity IN ('gas', 'power') AND central > 0""")
def validate_supply(spark, folder):
    trade = catalog.trade_frame(spark, TRADE)
    return op.validate_supply(trade.filter("kind = 'Import'"), all_assets(spark, folder))


@query("region_id:i length_km:d heat:d3 pool:d3", f"""
    SELECT l.region_id, length / 1000 AS length_km, max(CASE WHEN demand = 'heat' THEN value END) AS heat,
           max(CASE WHEN demand = 'pool' THEN value END) AS pool
    FROM ({LENGTH_SQL}) l LEFT JOIN ({src.DEMAND_SQL}) d USING (region_id) GROUP BY l.region_id, length""")
def region_summary(spark, folder):
    return op.region_summary(lengths(spark, folder), values(spark, folder), ["heat", "pool"])


# --- rule checks --------------------------------------------------------------------------------------------

@query("name:s rule:s", """
    SELECT p_partkey || '' AS name, 'efficiency must be positive' AS rule FROM part WHERE p_size % 10 = 0
    UNION ALL SELECT p_partkey || '', 'commodity_out is required' FROM part WHERE p_brand = 'Brand#3'
    UNION ALL SELECT p_partkey || '', 'loss is not allowed' FROM part WHERE p_size = 7""")
def catalog_violations(spark, folder):
    size = c("p_size")
    good = {n: F.lit(1.0) for n in ("opex_cost_energy", "opex_cost_power", "capex_cost_power", "technical_lifetime")}
    frame = types(spark)
    rows = table(spark, folder, "part").select(*[expr.cast(frame.schema[n].dataType).alias(n) for n, expr in {
        **{n: F.lit(None) for n in frame.columns}, "kind": F.lit("decentral"), "name": c("p_partkey").cast("string"),
        "commodity_in": c("p_type"), "commodity_out": F.when(c("p_brand") != "Brand#3", c("p_brand")),
        "efficiency": size % 10, "loss": F.when(size == 7, 0.1), **good}.items()])
    return catalog.catalog_violations(rows)


@query("rule:s key:s", """
    SELECT 'forced region' AS rule, c_custkey || '' AS key FROM customer WHERE c_custkey % 7 = 0 AND c_acctbal <= 0
    UNION ALL SELECT 'forced sum', c_custkey || '' FROM customer WHERE c_custkey % 14 = 0
    UNION ALL SELECT 'forced type', 'plant' FROM customer WHERE c_custkey % 7 = 1 GROUP BY ALL HAVING count(*) > 0
    UNION ALL SELECT 'location region', c_custkey || '' FROM customer WHERE c_custkey % 9 = 0 AND c_acctbal <= 0
    UNION ALL SELECT 'capacity region', '4' UNION ALL SELECT 'capacity sum', 'heat_in'
    UNION ALL SELECT 'factor grid', 'gas_grid' UNION ALL SELECT 'factor value', 'heat_grid'
    UNION ALL SELECT 'default needed', 'light2' UNION ALL SELECT 'demand supply', 'light3'
    UNION ALL SELECT 'dataset', 'sun' UNION ALL SELECT 'minimum type', 'cogen'
    UNION ALL SELECT 'forced region', c_custkey || '' FROM customer WHERE c_custkey % 7 = 1 AND c_acctbal <= 0""")
def verify_config(spark, folder):
    """A configuration for all customers with a positive balance as regions, with planted faults."""
    customer, k = table(spark, folder, "customer"), c("c_custkey")
    frame = lambda rows, schema: config_frame(spark, rows, schema)
    demand_types = DEMAND_TYPES + [catalog.DemandType("light2", "warmth", False, 0.0), catalog.DemandType("light3", "sun", False, 0.0)]
    forced = customer.filter(k % 7 == 0).select(
        k.alias("region_id"), F.explode(F.lit(["boiler", "pump"])).alias("technology"),
        F.when(k % 14 == 0, 0.6).otherwise(0.4).alias("share")).unionByName(
        customer.filter(k % 7 == 1).select(k.alias("region_id"), F.lit("plant").alias("technology"), F.lit(0.5).alias("share")))
    locations = customer.filter(k % 9 == 0).select(F.lit("heat_in").alias("commodity"), k.alias("region_id"))
    return op.verify_config(
        spark, demand_types=catalog.demand_type_frame(spark, demand_types),
        defaults=catalog.default_mix(spark, demand_types), types=types(spark), trade=catalog.trade_frame(spark, TRADE),
        regions=customer.filter("c_acctbal > 0").select(k.alias("region_id")), keys=frame([("heat",)], "key string"),
        wanted_keys=frame([("heat", "heat"), ("light3", "sun")], "demand string, key string"),
        minimum=frame([("boiler", 0.1), ("cogen", 0.2)], "technology string, share double"),
        factors=frame([("heat_grid", 1.0), ("gas_grid", 1.2)], "grid string, factor double"), locations=locations,
        capacities=frame([("heat_in", 4, "plant", 0.5)], "commodity string, region_id long, technology string, share double"),
        forced=forced, with_shares=frame([], "demand string"))
