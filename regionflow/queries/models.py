"""Model-input tables: rows per kind, dimensions, profile names."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from regionflow.functions.text import PALETTE
from regionflow.operators import catalog, energy, techmap as op
from regionflow.queries import energy as en
from regionflow.queries import inputs as src
from regionflow.queries.base import query, table
from regionflow.scale import cut_lineage
from regionflow.sources import writers

c = F.col

SCENARIO = catalog.Scenario("base", 2025, 2035, 5, 1, "weeks", co2_price={2025: 55.0, 2035: 120.0},
                            co2_limit={2025: 47500.0, 2035: 0.0}, discount_rate=0.02)
SCOPED = op.region_scoped(en.TYPES)
SCOPED_SQL = "('heat_in', 'heat_out', 'warmth', 'water')"


def number_sql(value: str) -> str:
    """``%.5g`` in SQL: the general format of the database, zero by itself."""
    return f"CASE WHEN {value} = 0 THEN '0' ELSE format('{{:.5g}}', CAST({value} AS DOUBLE)) END"


def scope_sql(name: str, region: str) -> str:
    return f"CASE WHEN {name} IN {SCOPED_SQL} THEN {name} || '_D' || {region} ELSE {name} END"


@query("region_id:i commodity:s", f"""
    SELECT c_custkey AS region_id, {scope_sql('k', 'c_custkey')} AS commodity
    FROM customer, (VALUES ('gas'), ('heat_in'), ('warmth'), ('power')) t(k)""")
def scoped_commodity(spark, folder):
    rows = table(spark, folder, "customer").select(
        c("c_custkey").alias("region_id"), F.explode(F.lit(["gas", "heat_in", "warmth", "power"])).alias("k"))
    return rows.withColumn("commodity", op.scoped_commodity(c("k"), c("region_id"), SCOPED))


@query("o_orderkey:i plain:s scaled:s single:s", f"""
    SELECT o_orderkey, CASE WHEN v IS NULL AND w IS NULL THEN NULL ELSE '[2025 ' || coalesce({number_sql('v')}, 'NaN')
             || ';2030 ' || coalesce({number_sql('w')}, 'NaN') || ']' END AS plain,
           CASE WHEN v IS NULL AND w IS NULL THEN NULL ELSE '[2025 ' || coalesce({number_sql('v * 0.001')}, 'NaN')
             || ';2030 ' || coalesce({number_sql('w * 0.001')}, 'NaN') || ']' END AS scaled,
           CAST(o_totalprice AS VARCHAR) AS single
    FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 3 THEN o_totalprice * [1e-10, 1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2][o_orderkey % 13 + 1] END AS v,
                 CASE WHEN o_orderkey % 4 = 0 THEN -o_custkey / 7.0 WHEN o_orderkey % 4 = 1 THEN 0.0 END AS w FROM orders)""")
def encode_years(spark, folder):
    k = c("o_orderkey")
    v = F.when(k % 4 != 3, c("o_totalprice") * F.element_at(F.lit([float(f"1e{n}") for n in range(-10, 3)]), (k % 13 + 1).cast("int")))
    w = F.when(k % 4 == 0, -c("o_custkey") / 7.0).when(k % 4 == 1, 0.0)
    at = lambda y, value: F.struct(F.lit(y).cast("int").alias("year"), value.alias("value"))
    rows = table(spark, folder, "orders").select(k, F.array(at(2030, w), at(2025, v)).alias("s"),
                                                 F.array(at(None, c("o_totalprice"))).alias("one"))
    return rows.select(k, op.encode_years(c("s")).alias("plain"), op.encode_years(c("s"), True).alias("scaled"),
                       op.encode_years(c("one")).alias("single"))


class _Made:
    """What several kinds of rows are made from, each made once."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    @cached_property
    def demands(self):
        return en.demands(self.spark, self.folder)

    @cached_property
    def names(self):
        return series_names(self.spark, self.folder, self.demands)

    @cached_property
    def decentral(self):
        spark, folder, found = self.spark, self.folder, self.demands
        return cut_lineage(energy.decentral_assets(found, en.mix(spark, folder, found), en.types(spark)))

    @cached_property
    def central(self):
        return cut_lineage(en.central(self.spark, self.folder))


def _table(spark, folder, kind, made=None):
    """Process rows of one kind over all regions."""
    made = made or _Made(spark, folder)
    if kind == "trade":
        return op.trade_rows(trade(spark, folder), SCENARIO)
    if kind == "pipe":
        return op.pipe_rows(en.pipes(spark, folder), SCOPED, SCENARIO)
    if kind == "grid":
        return op.grid_rows(en.grids(spark, folder, made.decentral), SCOPED, SCENARIO)
    if kind in ("central", "chp"):
        rows = op.central_rows if kind == "central" else op.chp_rows
        return rows(made.central, SCOPED, SCENARIO)
    if kind == "demand":
        return op.demand_rows(made.demands, made.names, SCOPED, SCENARIO)
    return op.decentral_rows(made.decentral, made.names, SCOPED, SCENARIO)


def series_names(spark, folder, found):
    hashes = cut_lineage(op.profile_hashes(energy.normalise_profile(src.profiles(spark, folder))))
    return cut_lineage(op.series_names(hashes, op.profile_names(found, hashes)))


def trade(spark, folder):
    """One import and one export per part: commodity by its key, prices by its price and size."""
    k = c("p_partkey")
    series = lambda *rows: F.array(*[F.struct(F.lit(y).cast("int").alias("year"), v.cast("double").alias("value")) for y, v in rows])
    kinds = table(spark, folder, "part").withColumn("kind", F.explode(F.lit(["Import", "Export"])))
    return kinds.select(
        k.cast("int").alias("ord"), "kind", F.concat(F.lit("fUel "), k.cast("string")).alias("commodity"),
        F.when(k % 2 == 0, series((0, c("p_retailprice")), (10, c("p_retailprice") * 2))).otherwise(
            series((None, c("p_retailprice")))).alias("price"),
        F.when(k % 3 == 0, series((None, F.lit(0.2)))).alias("co2"),
        series((0, c("p_size"))).alias("max_cap"),
        F.when(k % 5 == 0, series((None, c("p_size") * 1000))).alias("max_energy"))


@query("conversion_process_name:s commodity_in:s commodity_out:s scenario:s opex_cost_energy:s spec_co2:s cap_max:s max_eout:s", f"""
    SELECT k || 'Fuel ' || p_partkey AS conversion_process_name,
           CASE k WHEN 'Import' THEN 'Dummy' ELSE 'fUel ' || p_partkey END AS commodity_in,
           CASE k WHEN 'Export' THEN 'Dummy' ELSE 'fUel ' || p_partkey END AS commodity_out, 'base' AS scenario,
           CASE WHEN p_partkey % 2 = 0 THEN '[2025 ' || {number_sql('p_retailprice')} || ';2035 ' || {number_sql('p_retailprice * 2')} || ']'
                ELSE CAST(p_retailprice AS VARCHAR) END AS opex_cost_energy,
           CASE WHEN p_partkey % 3 = 0 THEN '0.2' END AS spec_co2,
           '[2025 ' || {number_sql('p_size * 0.001')} || ']' AS cap_max,
           CASE WHEN p_partkey % 5 = 0 THEN CAST(CAST(p_size AS DOUBLE) AS VARCHAR) END AS max_eout
    FROM part, (VALUES ('Import'), ('Export')) t(k)""")
def trade_rows(spark, folder):
    return _table(spark, folder, "trade")


_KEPT = lambda cap, years: (f"CASE WHEN {cap} <> 0 THEN '[2025 ' || {number_sql(cap + ' * 0.001')} || ';" + str(2025 + years - 1)
                            + f" ' || {number_sql(cap + ' * 0.001')} || ';" + str(2025 + years) + " 0]' END")
_OPEN = lambda cap: f"'[2025 ' || {number_sql(cap + ' * 0.001')} || ';2026 NaN]'"


@query("conversion_process_name:s commodity_in:s commodity_out:s efficiency:d technical_lifetime:d capex_cost_base:s cap_max:s cap_res_min:s", f"""
    WITH {en.PIPE_SQL}
    SELECT 'heat_pipe_D' || region_in || '_D' || region_out AS conversion_process_name,
           'heat_out_D' || region_in AS commodity_in, 'heat_in_D' || region_out AS commodity_out, 0.95 AS efficiency,
           40 AS technical_lifetime, CAST(CAST(investment AS DOUBLE) * 0.001::DOUBLE AS VARCHAR) AS capex_cost_base,
           {_OPEN('existing_capacity')} AS cap_max, {_KEPT('existing_capacity', 40)} AS cap_res_min FROM pip""")
def pipe_rows(spark, folder):
    return _table(spark, folder, "pipe")


@query("conversion_process_name:s commodity_in:s commodity_out:s min_eout:s output_profile:s", f"""
    WITH {en._DEMANDS},
    used AS (SELECT demand, count(DISTINCT series) AS kinds FROM dem GROUP BY 1),
    firsts AS (SELECT demand, series, min(region_id) AS first FROM dem GROUP BY 1, 2)
    SELECT demand || '_D' || region_id AS conversion_process_name, {scope_sql('commodity', 'region_id')} AS commodity_in,
           'Dummy' AS commodity_out,
           '[2025 ' || {number_sql('value * 0.001')} || ';2030 ' || {number_sql('value * pow(1 - yearly_decrease::DOUBLE, 5) * 0.001')}
             || ';2035 ' || {number_sql('value * pow(1 - yearly_decrease::DOUBLE, 10) * 0.001')} || ']' AS min_eout,
           CASE WHEN kinds = 1 THEN demand ELSE demand || '_' || first END AS output_profile
    FROM dem JOIN used USING (demand) JOIN firsts USING (demand, series)""")
def demand_rows(spark, folder):
    return _table(spark, folder, "demand")


@query("conversion_process_name:s commodity_in:s commodity_out:s efficiency:d opex_cost_power:s capex_cost_power:s cap_max:s cap_res_max:s output_profile:s", f"""
    WITH {en.DECENTRAL_SQL},
    firsts AS (SELECT demand, series, min(region_id) AS first FROM dem GROUP BY 1, 2)
    SELECT name || '_D' || region_id AS conversion_process_name, {scope_sql('commodity_in', 'region_id')} AS commodity_in,
           {scope_sql('commodity_out', 'region_id')} AS commodity_out, efficiency, '12.5' AS opex_cost_power,
           '430.75' AS capex_cost_power, {_OPEN('existing_capacity')} AS cap_max,
           CASE WHEN existing_capacity <> 0 THEN '[2025 ' || {number_sql('existing_capacity * 0.001')} || ';' || CAST(2025 + lifetime AS INT) || ' 0]' END AS cap_res_max,
           CASE WHEN series IS NOT NULL THEN demand || '_' || first END AS output_profile
    FROM dec LEFT JOIN firsts USING (demand, series)""")
def decentral_rows(spark, folder):
    return _table(spark, folder, "decentral")


@query("conversion_process_name:s commodity_in:s commodity_out:s efficiency:d capex_cost_base:s cap_max:s cap_res_min:s", f"""
    WITH {en.GRID_SQL}
    SELECT name || '_D' || region_id AS conversion_process_name, 'heat_in_D' || region_id AS commodity_in,
           'heat_out_D' || region_id AS commodity_out, 0.88 AS efficiency,
           CAST(length_km::DOUBLE * 1000000::DOUBLE * 0.001::DOUBLE AS VARCHAR) AS capex_cost_base,
           {_OPEN('existing_capacity')} AS cap_max, {_KEPT('existing_capacity', 40)} AS cap_res_min FROM grd""")
def grid_rows(spark, folder):
    return _table(spark, folder, "grid")


@query("conversion_process_name:s commodity_in:s commodity_out:s efficiency:d capex_cost_base:s cap_max_unit:d cap_max:s cap_res_min:s availability_profile:s", f"""
    WITH {en.CENTRAL_SQL}
    SELECT name || '_D' || region_id AS conversion_process_name, CASE name WHEN 'plant' THEN 'gas' ELSE 'power' END AS commodity_in,
           'heat_in_D' || region_id AS commodity_out, CASE name WHEN 'plant' THEN 0.95 ELSE 2.8 END AS efficiency,
           CASE name WHEN 'plant' THEN '150.0' ELSE '60.0' END AS capex_cost_base, CASE name WHEN 'plant' THEN 0.5 END AS cap_max_unit,
           '[2025 ' || {number_sql('existing_capacity * 0.001')} || CASE name WHEN 'plant' THEN ';2026 4;2030 9]' ELSE ';2026 1.5]' END AS cap_max,
           CASE name WHEN 'plant' THEN {_KEPT('existing_capacity', 25)} ELSE {_KEPT('existing_capacity', 15)} END AS cap_res_min,
           availability_profile
    FROM cen WHERE kind = 'central'""")
def central_rows(spark, folder):
    return _table(spark, folder, "central")


@query("conversion_process_name:s commodity_in:s commodity_out:s in_frac_min:d in_frac_max:d technical_lifetime:d cap_max:s cap_res_min:s", f"""
    WITH {en.CENTRAL_SQL}, chp AS (SELECT name || '_D' || region_id AS p, region_id, existing_capacity AS cap FROM cen WHERE kind = 'chp')
    SELECT p AS conversion_process_name, 'gas' AS commodity_in, 'Help_' || p AS commodity_out, NULL AS in_frac_min, NULL AS in_frac_max,
           NULL AS technical_lifetime, NULL AS cap_max, NULL AS cap_res_min FROM chp
    UNION ALL SELECT p, 'Help_' || p, 'Dummy', 0.11, NULL, NULL, NULL, NULL FROM chp
    UNION ALL SELECT p, 'Help_' || p, 'heat_in_D' || region_id, 0.48, 0.48, 15, {_OPEN('cap')}, {_KEPT('cap', 15)} FROM chp
    UNION ALL SELECT p, 'Help_' || p, 'power', NULL, NULL, NULL, NULL, NULL FROM chp""")
def chp_rows(spark, folder):
    return _table(spark, folder, "chp")


def all_rows(spark, folder):
    made = _Made(spark, folder)
    return cut_lineage(op.subprocess_table(*[_table(spark, folder, k, made) for k in (
        "trade", "pipe", "demand", "decentral", "grid", "central", "chp")]), compact=True)


_NAMES_SQL = f"""
    {en.ASSET_SQL}, {en.PIPE_SQL},
    nam AS (SELECT k || 'Fuel ' || p_partkey AS process, CASE k WHEN 'Import' THEN 'Dummy' ELSE 'fUel ' || p_partkey END AS commodity, 0 AS block
            FROM part, (VALUES ('Import'), ('Export')) t(k)
            UNION ALL SELECT 'heat_pipe_D' || region_in || '_D' || region_out, 'heat_out_D' || region_in, 1 FROM pip
            UNION ALL SELECT demand || '_D' || region_id, {scope_sql('commodity', 'region_id')}, 2 FROM dem
            UNION ALL SELECT a.name || '_D' || region_id, {scope_sql('commodity_in', 'region_id')},
                             CASE a.kind WHEN 'decentral' THEN 3 WHEN 'grid' THEN 4 ELSE 5 END
            FROM ast a JOIN ty USING (name)
            UNION ALL SELECT name || '_D' || region_id, 'Help_' || name || '_D' || region_id, 5
            FROM ast, (VALUES (1), (2), (3)) t(n) WHERE ast.kind = 'chp')"""


@query("conversion_process_name:s commodity_in:s block:i", f"""
    WITH {_NAMES_SQL} SELECT process AS conversion_process_name, commodity AS commodity_in, block FROM nam""")
def subprocess_table(spark, folder):
    return all_rows(spark, folder)


_COLOURS = "[" + ", ".join(f"'{v}'" for v in PALETTE) + "]"


@query("conversion_process_name:s order:i color:s", f"""
    WITH d AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name || '_D' || p_size ELSE p_brand || ' ' || p_partkey END AS n FROM part),
    h AS (SELECT n, md5(regexp_replace(n, '_D.*$', '')) AS x FROM d)
    SELECT n AS conversion_process_name, row_number() OVER (ORDER BY n) - 1 AS "order",
           {_COLOURS}[CAST(((('0x' || x[1:16])::UBIGINT % 20) * 16 + ('0x' || x[17:32])::UBIGINT % 20) % 20 AS INT) + 1] AS color FROM h""")
def dimension(spark, folder):
    k = c("p_partkey")
    names = table(spark, folder, "part").select(F.when(k % 2 == 0, F.concat("p_name", F.lit("_D"), c("p_size").cast("string")))
                                                .otherwise(F.concat("p_brand", F.lit(" "), k.cast("string"))).alias("n"))
    return op.dimension(names, "n", "conversion_process_name")


@query("series:s profile_name:s", f"""
    WITH {en._DEMANDS},
    used AS (SELECT demand, count(DISTINCT series) AS kinds FROM dem GROUP BY 1),
    firsts AS (SELECT demand, min(demand_ord) AS o, series, min(region_id) AS first FROM dem GROUP BY 1, 3)
    SELECT series, arg_min(CASE WHEN kinds = 1 THEN demand ELSE demand || '_' || first END, o) AS profile_name
    FROM firsts JOIN used USING (demand) GROUP BY 1""")
def profile_names(spark, folder):
    return series_names(spark, folder, en.demands(spark, folder))


@query("name:s text:s", f"""
    SELECT series AS name, string_agg(CASE WHEN share = 0 THEN '0' ELSE format('{{:.10g}}', share) END, ' ' ORDER BY hour) AS text FROM (
        SELECT series, hour, round(value, 2) AS share FROM ({src.PROFILE_SQL})) GROUP BY 1""")
def profile_texts(spark, folder):
    rows = src.profiles(spark, folder).withColumn("value", F.round("value", 2))
    hashes = rows.select("series").distinct().withColumn("profile_hash", F.sha1("series"))
    names = hashes.select("profile_hash", c("series").alias("profile_name"))
    return writers.profile_texts(rows, cut_lineage(hashes), names)


@query("sheet:s rows:i columns:i", f"""
    WITH {_NAMES_SQL}
    SELECT 'Units' AS sheet, 7 AS rows, 4 AS columns UNION ALL SELECT 'Scenario', 1, 8 UNION ALL SELECT 'TSS', 1, 2
    UNION ALL SELECT 'Commodity', count(DISTINCT commodity), 3 FROM nam
    UNION ALL SELECT 'ConversionProcess', count(DISTINCT process), 3 FROM nam
    UNION ALL SELECT 'ConversionSubProcess', count(*), 29 FROM nam""")
def create_techmap(spark, folder):
    sheets = op.create_techmap(spark, SCENARIO, "kW", all_rows(spark, folder))
    counts = [frame.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("sheet"), "rows", F.lit(len(frame.columns)).alias("columns")) for name, frame in sheets.items()]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found
