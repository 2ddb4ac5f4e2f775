"""Solver results: parsing, tidy tables, report and chart data, investment checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions.config import config_frame
from regionflow.operators import results as op
from regionflow.queries.base import query, table
from regionflow.scale import attach, cut_lineage, dense_index

c = F.col
SCOPED = ["heat_in", "heat_out", "warmth"]

# One process per brand and customer; the brand number gives its kind. Trade processes per part.
_BASE_SQL = """
    SELECT p_brand AS brand, CAST(p_brand[7:] AS INT) AS n, o_custkey AS region, year(l_shipdate) AS year,
           l_linenumber % 2 AS half, l_quantity AS q, l_discount AS d, l_extendedprice AS e, l_partkey AS part
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""
_KIND_SQL = "CASE WHEN n % 8 = 5 THEN 'chp' ELSE ['decentral', 'central', 'grid', 'pipe'][n % 4 + 1] END"
_RAW_SQL = f"""
    SELECT brand, n, region, year, {_KIND_SQL} AS kind, CASE WHEN n % 8 = 5 THEN half ELSE 0 END AS half,
           sum(q) AS cap_active, sum(d) AS cap_new, sum(e) AS eouttot, CAST(count(*) AS DOUBLE) AS newly_installed_units
    FROM ({_BASE_SQL}) GROUP BY ALL"""
OUTPUT_SQL = f"""
    SELECT brand || '_D' || region || CASE kind WHEN 'pipe' THEN '_D' || (region + 1) ELSE '' END AS cp,
           CASE kind WHEN 'chp' THEN 'Help_' || brand || '_D' || region WHEN 'grid' THEN 'heat_in_D' || region
                WHEN 'pipe' THEN 'heat_out_D' || region ELSE 'fuel' END AS cin,
           CASE kind WHEN 'decentral' THEN 'warmth_D' || region WHEN 'central' THEN 'heat_in_D' || region
                WHEN 'grid' THEN 'heat_out_D' || region WHEN 'pipe' THEN 'heat_in_D' || (region + 1)
                ELSE CASE half WHEN 0 THEN 'heat_in_D' || region ELSE 'power' END END AS cout,
           year, cap_active, cap_new, eouttot, newly_installed_units, kind, brand, n, region, half
    FROM ({_RAW_SQL})
    UNION ALL
    SELECT CASE WHEN part % 2 = 0 THEN 'Import' ELSE 'Export' END || 'Fuel ' || part,
           CASE WHEN part % 2 = 0 THEN 'Dummy' ELSE 'fUel ' || part END, CASE WHEN part % 2 = 0 THEN 'fUel ' || part ELSE 'Dummy' END,
           year, sum(q), sum(d), sum(e), CAST(count(*) AS DOUBLE), 'trade', NULL, part, NULL, NULL
    FROM ({_BASE_SQL}) GROUP BY part, year"""
_OUT = f"out AS ({OUTPUT_SQL})"


def _base(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", F.year("l_shipdate").alias("year"), (c("l_linenumber") % 2).alias("half"),
        c("l_quantity").alias("q"), c("l_discount").alias("d"), c("l_extendedprice").alias("e"))
    part = table(spark, folder, "part").select(c("p_partkey").alias("l_partkey"), c("p_brand").alias("brand"))
    orders = table(spark, folder, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("region"))
    rows = items.join(part, "l_partkey").join(orders, "l_orderkey").drop("l_orderkey")
    return cut_lineage(rows, compact=True).withColumn("n", _number())


def _number():
    return F.substring("brand", 7, 9).cast("int")


def _sums():
    return [F.sum("q").alias("cap_active"), F.sum("d").alias("cap_new"), F.sum("e").alias("eouttot"),
            F.count(F.lit(1)).cast("double").alias("newly_installed_units")]


def _kind(n):
    return F.when(n % 8 == 5, "chp").otherwise(F.element_at(F.array(
        F.lit("decentral"), F.lit("central"), F.lit("grid"), F.lit("pipe")), n % 4 + 1))


def outputs(spark, folder, base=None):
    """``cp, cin, cout, year`` and measures, as the solver's tables would give them."""
    base = _base(spark, folder) if base is None else base
    n = c("n")
    raw = base.groupBy("brand", "n", "region", "year", F.when(n % 8 == 5, c("half")).otherwise(0).alias("half")).agg(*_sums())
    raw = raw.withColumn("kind", _kind(n))
    r, text = c("region").cast("string"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    after = (c("region") + 1).cast("string")
    name = text(c("brand"), "_D", r)
    kind = c("kind")
    made = raw.select(
        F.when(kind == "pipe", text(name, "_D", after)).otherwise(name).alias("cp"),
        F.when(kind == "chp", text("Help_", name)).when(kind == "grid", text("heat_in_D", r))
        .when(kind == "pipe", text("heat_out_D", r)).otherwise("fuel").alias("cin"),
        F.when(kind == "decentral", text("warmth_D", r)).when(kind == "central", text("heat_in_D", r))
        .when(kind == "grid", text("heat_out_D", r)).when(kind == "pipe", text("heat_in_D", after))
        .when(c("half") == 0, text("heat_in_D", r)).otherwise("power").alias("cout"),
        "year", *op.MEASURES)
    part = c("l_partkey")
    even, fuel = part % 2 == 0, text("fUel ", part.cast("string"))
    trade = base.groupBy("l_partkey", "year").agg(*_sums()).select(
        text(F.when(even, "Import").otherwise("Export"), "Fuel ", part.cast("string")).alias("cp"),
        F.when(even, "Dummy").otherwise(fuel).alias("cin"), F.when(even, fuel).otherwise("Dummy").alias("cout"),
        "year", *op.MEASURES)
    return cut_lineage(made.unionByName(trade), compact=True)


def solver_tables(spark, folder):
    """The outputs taken apart into the solver's id tables.

    A subprocess and its years travel as one row; its names are looked up once and make room for their ids.
    """
    years = F.collect_list(F.struct((c("year") - 1900).alias("y_id"), "cap_active", F.when(c("cap_new") != 0, c("cap_new")).alias("cap_new"),
                                    "eouttot", "newly_installed_units"))
    rows = outputs(spark, folder)
    subs = cut_lineage(rows.groupBy("cp", "cin", "cout").agg(years.alias("years")), compact=True)
    subs = subs.withColumn("cs_id", F.monotonically_increasing_id())
    process = dense_index(subs.select(c("cp").alias("name")).distinct(), "name", "id")
    names = subs.select(c("cin").alias("name")).unionByName(subs.select(c("cout").alias("name"))).distinct()
    commodity = dense_index(names, "name", "id")
    year = rows.select(c("year").alias("value")).distinct().withColumn("id", c("value") - 1900)
    look = lambda frame, table_, column, key: attach(
        frame, table_.select(c("name").alias(column), c("id").alias(key)), [column]).drop(column)
    ids = subs.select("cs_id", "cp", "cin", "cout").join(process.select(c("name").alias("cp"), c("id").alias("cp_id")), "cp").drop("cp")
    ids = look(look(ids, commodity, "cin", "cin_id"), commodity, "cout", "cout_id")
    return {"conversion_process": process, "commodity": commodity, "year": year,
            "conversion_subprocess": ids.select(c("cs_id").alias("id"), "cp_id", "cin_id", "cout_id"),
            "output_cs_y": subs.select("cs_id", F.inline("years"))}


@query("cp:s cin:s cout:s year:i cap_active:d2 cap_new:d4 eouttot:d2 newly_installed_units:d1", f"WITH {_OUT} SELECT * FROM out")
def subprocess_outputs(spark, folder):
    return op.subprocess_outputs(solver_tables(spark, folder))


@query("opex:d2 capex:d2 totex:d2", """
    SELECT sum(o_totalprice) AS opex, sum(o_custkey) AS capex, sum(o_totalprice) + sum(o_custkey) AS totex FROM orders""")
def global_totals(spark, folder):
    row = table(spark, folder, "orders").agg(F.sum("o_totalprice").alias("opex"), F.sum("o_custkey").alias("capex"))
    return op.global_totals(row.withColumn("totex", c("opex") + c("capex")))


@query("year:i amount:d2", "SELECT year(l_shipdate) AS year, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1")
def emissions_by_year(spark, folder):
    items = table(spark, folder, "lineitem")
    year = items.select(F.year("l_shipdate").alias("value")).distinct().withColumn("id", c("value") - 1900)
    rows = items.select((F.year("l_shipdate") - 1900).alias("y_id"), c("l_extendedprice").alias("total_annual_co2_emission"))
    return op.emissions_by_year(rows, year)


@query("cp:s cin:s cout:s year:i cap_active:d2 cap_new:d4 eouttot:d4", f"""
    WITH {_OUT} SELECT cp, cin, cout, year, cap_active * 1000 AS cap_active, cap_new * 1000 AS cap_new, eouttot / 1.0 AS eouttot FROM out""")
def rescale_results(spark, folder):
    return op.rescale_results(outputs(spark, folder), "kW")


# --- tidy tables ----------------------------------------------------------------------------------------

def assets(spark, folder, base=None):
    base = _base(spark, folder) if base is None else base
    # what follows from the brand is made again when the rows are read, not stored
    own = cut_lineage(base.select("brand", "region").distinct()).withColumn("n", _number())
    kind = c("kind")
    return own.withColumn("kind", _kind(c("n"))).select(
        "kind", c("brand").alias("name"), c("region").alias("region_id"),
        F.when(kind == "grid", "heat_in").when(kind == "pipe", "heat_out").otherwise("fuel").alias("commodity_in"),
        F.when(kind == "decentral", "warmth").when(kind == "grid", "heat_out").otherwise("heat_in").alias("commodity_out"),
        F.when(kind == "chp", "power").alias("commodity_out_2"))


def _solved(spark, folder):
    """Outputs and assets of one reading of the base rows."""
    base = _base(spark, folder)
    return outputs(spark, folder, base), assets(spark, folder, base)


def _pipes(spark, folder, own=None):
    own = assets(spark, folder) if own is None else own
    return own.filter("kind = 'pipe'").select(
        "name", c("region_id").alias("region_in"), (c("region_id") + 1).alias("region_out"), "commodity_in", "commodity_out")


def demands(spark, folder):
    """Heat in most regions, a second demand on the same commodity in every third."""
    k = c("c_custkey")
    rows = table(spark, folder, "customer").withColumn("_d", F.explode(F.filter(
        F.array(F.when(k % 7 != 3, 0), F.when(k % 3 == 0, 1)), lambda v: v.isNotNull())))
    return rows.select(k.alias("region_id"), c("_d").alias("demand_ord"), F.lit("warmth").alias("commodity"),
                       F.when(c("_d") == 0, "heat").otherwise("baths").alias("demand"),
                       (100.0 + k % 50).alias("value"), F.lit(0.02).alias("yearly_decrease"))


_DEMAND_NAME = "CASE WHEN region % 3 = 0 THEN 'baths' WHEN region % 7 <> 3 THEN 'heat' END"
_TIDY = "year:i technology:s region_id:i capacity:d2 energy_output:d2 new_capacity:d4"
_TIDY_SQL = "year, brand AS technology, region AS region_id, cap_active AS capacity, eouttot AS energy_output, cap_new AS new_capacity"
_DEC_SQL = f"""
    WITH {_OUT}, dec AS (SELECT {_DEMAND_NAME} AS demand, {_TIDY_SQL} FROM out WHERE kind = 'decentral' AND {_DEMAND_NAME} IS NOT NULL)"""


def _decentral(spark, folder, solved=None):
    out, own = solved or _solved(spark, folder)
    return op.decentral_results(out, own, demands(spark, folder), SCOPED)


@query("demand:s " + _TIDY, _DEC_SQL + " SELECT * FROM dec")
def decentral_results(spark, folder):
    return _decentral(spark, folder)


@query("commodity:s newly_installed_units:d1 " + _TIDY, f"""
    WITH {_OUT} SELECT CASE WHEN kind = 'chp' AND half = 1 THEN 'power' ELSE 'heat_in' END AS commodity, {_TIDY_SQL}, newly_installed_units
    FROM out WHERE kind IN ('central', 'chp')""")
def central_results(spark, folder):
    return op.central_results(*_solved(spark, folder), SCOPED)


@query("commodity:s " + _TIDY, f"WITH {_OUT} SELECT 'heat_in' AS commodity, {_TIDY_SQL} FROM out WHERE kind = 'grid'")
def grid_results(spark, folder):
    return op.grid_results(*_solved(spark, folder), SCOPED)


@query("commodity:s year:i technology:s region_id_from:i region_id_to:i capacity:d2 energy_output:d2 new_capacity:d4", f"""
    WITH {_OUT} SELECT 'heat_in' AS commodity, {_TIDY_SQL}, region AS region_id_from, region + 1 AS region_id_to FROM out WHERE kind = 'pipe'""")
def pipe_results(spark, folder):
    out, own = _solved(spark, folder)
    return op.pipe_results(out, _pipes(spark, folder, own), SCOPED)


def _trade(spark, folder):
    return table(spark, folder, "part").select(
        F.explode(F.lit(["Import", "Export"])).alias("kind"), F.concat(F.lit("fUel "), c("p_partkey").cast("string")).alias("commodity"))


@query("commodity:s year:i capacity:d2 energy_output:d2 new_capacity:d4", f"""
    WITH {_OUT} SELECT cout AS commodity, {_TIDY_SQL} FROM out WHERE kind = 'trade' AND cin = 'Dummy'""")
def import_results(spark, folder):
    return op.import_results(outputs(spark, folder), _trade(spark, folder))


@query("commodity:s year:i capacity:d2 energy_input:d2 new_capacity:d4", f"""
    WITH {_OUT} SELECT cin AS commodity, year, cap_active AS capacity, eouttot AS energy_input, cap_new AS new_capacity
    FROM out WHERE kind = 'trade' AND cout = 'Dummy'""")
def export_results(spark, folder):
    return op.export_results(outputs(spark, folder), _trade(spark, folder))


@query("position:i year:i technology:s", f"""
    WITH {_OUT}, g AS (SELECT year, brand AS technology FROM out WHERE kind = 'grid')
    SELECT row_number() OVER (ORDER BY year, technology) - 1 AS position, year, technology FROM g""")
def sort_results(spark, folder):
    """The sorted rows numbered in the order they come out."""
    rows = op.sort_results(op.grid_results(*_solved(spark, folder), SCOPED).select("year", "technology"))
    ranged = cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))
    return dense_index(ranged, "at", "position")


# --- report -----------------------------------------------------------------------------------------------------

def _display_sql(value: str, labels: list[str]) -> str:
    text = "CASE "
    for label, size in zip(labels, ("1", "1e3", "1e6")):
        text += f"WHEN abs(CAST(format('{{:.2f}}', {value} / {size}) AS DOUBLE)) < 1000 THEN format('{{:.2f}}', {value} / {size}) || ' {label}' "
    return text + f"ELSE format('{{:.2f}}', {value} / 1e9) || ' {labels[3]}' END"


@query("o_orderkey:i money:s co2:s", f"""
    SELECT o_orderkey, {_display_sql('(v * 1e3)', ['€', 'k€', 'Mio €', 'Bil €'])} AS money,
           {_display_sql('(v / 1e3)', ['t', 'kt', 'Mio t', 'Bil t'])} AS co2
    FROM (SELECT o_orderkey, o_totalprice * [1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2, 1e3, 1e4][o_orderkey % 9 + 1] AS v FROM orders)""")
def format_scaled(spark, folder):
    k = c("o_orderkey")
    rows = table(spark, folder, "orders").select(k, (c("o_totalprice") * F.element_at(F.lit([float(f"1e{n}") for n in range(-4, 5)]), (k % 9 + 1).cast("int"))).alias("v"))
    return rows.select(k, op.format_scaled(c("v"), "money", "k EUR").alias("money"),
                       op.format_scaled(c("v") / 1e3, "co2", "t").alias("co2"))


_REPORT = ["commodity", "year", "technology", "region_id", "region_id_from", "region_id_to", "capacity [kW]",
           "energy_output [MWh]", "new_capacity [kW]"]


@query("table:s rows:i commodity:s year:i technology:s region_id:i region_id_from:i region_id_to:i capacity:d2 energy_output:d2 "
       "new_capacity:d4", f"""
    WITH {_OUT}, k AS (SELECT *, CASE kind WHEN 'grid' THEN 'grids' ELSE 'pipes' END AS "table" FROM out WHERE kind IN ('grid', 'pipe'))
    SELECT "table", count(*) OVER (PARTITION BY kind) AS rows, 'heat_in' AS commodity, year, brand AS technology,
           CASE WHEN kind = 'grid' THEN region END AS region_id, CASE WHEN kind = 'pipe' THEN region END AS region_id_from,
           CASE WHEN kind = 'pipe' THEN region + 1 END AS region_id_to, cap_active AS capacity, eouttot AS energy_output,
           cap_new AS new_capacity FROM k""")
def report_tables(spark, folder):
    """All rows of both tables under their displayed headers, with the report's own counts."""
    out, own = _solved(spark, folder)
    groups = {"grids": op.grid_results(out, own, SCOPED), "pipes": op.pipe_results(out, _pipes(spark, folder, own), SCOPED)}
    totals = out.agg(F.sum("eouttot").alias("opex"), F.sum("cap_new").alias("capex"), F.sum("cap_active").alias("totex"))
    emissions = out.groupBy("year").agg(F.sum("eouttot").alias("amount"))
    found = op.report_tables(groups, totals, emissions, "kW", {"system": "all customers", "scenario": "base"})
    shown = [found[n].select(F.lit(n).alias("table"), *[
        (c(f"`{name}`") if name in found[n].columns else F.lit(None)).alias(name.split(" ")[0]) for name in _REPORT])
        for n in groups]
    return shown[0].unionByName(shown[1]).join(found["counts"], "table")


# --- chart data ---------------------------------------------------------------------------------------------------

@query("demand:s " + _TIDY, _DEC_SQL + " SELECT * FROM dec WHERE year = 1996 AND technology = 'Brand#4'")
def slice_results(spark, folder):
    return op.slice_results(_decentral(spark, folder), 1996, "Brand#4")


@query("demand:s " + _TIDY, _DEC_SQL + " SELECT * FROM dec WHERE new_capacity > 0.001")
def active_rows(spark, folder):
    return op.active_rows(_decentral(spark, folder), "new_capacity")


@query("region_id:i year:i technology:s value:d4 share:d8", _DEC_SQL + """
    SELECT region_id, year, technology, sum(new_capacity) AS value,
           sum(new_capacity) / sum(sum(new_capacity)) OVER (PARTITION BY region_id, year) AS share
    FROM dec WHERE year IN (1995, 1997) AND new_capacity > 0 GROUP BY 1, 2, 3""")
def decentral_share(spark, folder):
    return op.decentral_share(_decentral(spark, folder), "new_capacity", [1995, 1997])


@query("region_id:i demand:s value:d6", """
    SELECT c_custkey AS region_id, d AS demand, (100.0 + c_custkey % 50) * pow(0.98, 6) AS value
    FROM customer, (VALUES ('heat'), ('baths')) t(d) WHERE CASE d WHEN 'heat' THEN c_custkey % 7 <> 3 ELSE c_custkey % 3 = 0 END""")
def demand_in_year(spark, folder):
    return op.demand_in_year(demands(spark, folder), "warmth", 1990, 1996)


def _fed_assets(own):
    """Decentral technologies of even regions are fed by the grid."""
    return own.withColumn("commodity_in", F.when((c("kind") == "decentral") & (c("region_id") % 2 == 0), "heat_out").otherwise(c("commodity_in")))


@query("region_id:i technology:s value:d2", _DEC_SQL + """
    SELECT region_id, technology, sum(capacity) AS value FROM dec WHERE year = 1996 AND region_id % 2 = 0 AND capacity > 0 GROUP BY 1, 2""")
def grid_supplied(spark, folder):
    solved = _solved(spark, folder)
    return op.grid_supplied(_decentral(spark, folder, solved), _fed_assets(solved[1]), "heat_out", 1996)


@query("region_id:i length_km:d grid_value:d2 demands:s central:s grid_fed:s", _DEC_SQL + f""",
    act AS (SELECT region AS region_id, cap_active AS grid_value FROM out WHERE kind = 'grid' AND brand = 'Brand#6' AND year = 1996 AND cap_active > 0.001),
    cen AS (SELECT region AS region_id, string_agg(brand || '=' || format('{{:.1f}}', cap_active), ';' ORDER BY brand, cap_active) AS central
            FROM out WHERE kind IN ('central', 'chp') AND year = 1996 AND cap_active > 0.001 AND NOT (kind = 'chp' AND half = 1) GROUP BY 1),
    fed AS (SELECT region_id, string_agg(technology || '=' || format('{{:.1f}}', v), ';' ORDER BY technology) AS grid_fed FROM (
            SELECT region_id, technology, sum(capacity) AS v FROM dec WHERE year = 1996 AND region_id % 2 = 0 GROUP BY 1, 2) GROUP BY 1)
    SELECT region_id, region_id % 37 / 10.0 AS length_km, grid_value,
           CASE WHEN region_id % 2 = 0 THEN 'heat=' || format('{{:.1f}}', CAST(region_id % 50 AS DOUBLE)) END AS demands, central, grid_fed
    FROM act LEFT JOIN cen USING (region_id) LEFT JOIN fed USING (region_id)""")
def grid_overview(spark, folder):
    out, original = _solved(spark, folder)
    own = _fed_assets(original).withColumn("length_km", c("region_id") % 37 / 10.0)
    types = config_frame(spark, [("grid", "Brand#6", "heat_in", "heat_out")], "kind string, name string, commodity_in string, commodity_out string")
    served = table(spark, folder, "customer").filter("c_custkey % 2 = 0").select(
        c("c_custkey").alias("region_id"), F.lit("heat").alias("demand"), F.lit("heat_out").alias("commodity"),
        (c("c_custkey") % 50).cast("double").alias("value"), F.lit(0.0).alias("yearly_decrease"))
    found = op.grid_overview("Brand#6", types, own, served, op.grid_results(out, original, SCOPED),
                             op.central_results(out, original, SCOPED), _decentral(spark, folder, (out, original)), 1990, 1996)
    text = lambda n: F.array_join(F.transform(n, lambda e: F.concat(e["name"], F.lit("="), F.format_string("%.1f", e["value"]))), ";")
    return found.withColumns({n: text(n) for n in ("demands", "central", "grid_fed")})


@query("technology:s region_in:i region_out:i active:b value:d2", f"""
    WITH {_OUT}, p AS (SELECT DISTINCT brand, region, region + 1 AS nxt FROM out WHERE kind = 'pipe'),
    live AS (SELECT brand, region, cap_active AS v FROM out WHERE kind = 'pipe' AND year = 1996 AND cap_active > 20)
    SELECT brand AS technology, region AS region_in, nxt AS region_out, TRUE AS active, v AS value FROM live JOIN p USING (brand, region)
    UNION ALL SELECT DISTINCT brand, region, nxt, FALSE, NULL FROM p ANTI JOIN live USING (brand, region)
    UNION ALL SELECT brand, region + 500000, region + 500001, FALSE, NULL FROM p WHERE region % 9 = 0""")
def pipe_status(spark, folder):
    """Pipes of every type; the two directions of an unused pair appear once."""
    out, own = _solved(spark, folder)
    pipes = _pipes(spark, folder, own)
    known = pipes.select(c("name").alias("technology"), "region_in", "region_out").distinct()
    far = known.filter("region_in % 9 = 0").select(
        "technology", (c("region_in") + 500000).alias("a"), (c("region_in") + 500001).alias("b"))
    known = known.union(far).union(far.select("technology", "b", "a"))
    found = op.pipe_results(out, pipes, SCOPED)
    found = found.withColumn("capacity", F.when(c("capacity") > 20, c("capacity")).otherwise(0.0))
    return op.pipe_status(known, found, 1996)


@query("cp:s base:s first:i second:i", f"""
    WITH {_OUT} SELECT DISTINCT cp, coalesce(brand, cp) AS base, region AS first, CASE kind WHEN 'pipe' THEN region + 1 END AS second FROM out""")
def parse_names(spark, folder):
    rows = op.parse_names(outputs(spark, folder).select("cp").distinct(), "cp")
    return rows.withColumns({"first": F.get("regions", F.lit(0)), "second": F.get("regions", F.lit(1))})


@query("region_id:i", f"WITH {_OUT} SELECT region AS region_id FROM out WHERE region IS NOT NULL UNION SELECT region + 1 FROM out WHERE kind = 'pipe'")
def regions_of(spark, folder):
    return op.regions_of(outputs(spark, folder), "cp")


@query("base:s", f"""
    WITH {_OUT}, n AS (SELECT cin AS name FROM out UNION SELECT cout FROM out)
    SELECT DISTINCT regexp_replace(regexp_replace(name, '_D[0-9]+$', ''), '_D[0-9]+$', '') AS base FROM n""")
def base_names(spark, folder):
    rows = outputs(spark, folder)
    return op.base_names(rows.select(c("cin").alias("name")).union(rows.select("cout")), "name")


def _commodities(rows):
    return rows.select(c("cin").alias("name")).union(rows.select("cout")).distinct()


def _flows(spark, folder):
    rows = outputs(spark, folder).withColumn("eintot", c("eouttot") * 1.25)
    return rows, _commodities(rows)


@query("scope:s cp:s cout:s year:i", f"""
    WITH {_OUT}
    SELECT 'region' AS scope, cp, cout, year FROM out WHERE cout = 'heat_in_D5' AND (region = 5 OR (kind = 'pipe' AND region = 4))
    UNION ALL SELECT 'bare', cp, cout, year FROM out WHERE cout = 'power' AND (region = 5 OR (kind = 'pipe' AND region = 4))
    UNION ALL SELECT 'global', cp, cout, year FROM out WHERE cout = 'power'
    UNION ALL SELECT 'all', cp, cout, year FROM out WHERE cout LIKE 'warmth_D%'""")
def scope_filter(spark, folder):
    rows, names = _flows(spark, folder)
    pick = lambda scope, commodity, region: op.scope_filter(rows, commodity, region, "cout", names).select(
        F.lit(scope).alias("scope"), "cp", "cout", "year")
    return (pick("region", "heat_in", 5).union(pick("bare", "power", 5)).union(pick("global", "power", None))
            .union(pick("all", "warmth", op.ALL_REGIONS)))


@query("metric:s cp:s year:i value:d5", f"""
    WITH {_OUT}
    SELECT 'energy_consumption' AS metric, brand AS cp, year, sum(eouttot * 1.25) AS value FROM out WHERE cin LIKE 'heat_out_D%' GROUP BY 2, 3
    UNION ALL SELECT 'energy_production', brand, year, sum(eouttot) FROM out WHERE cout LIKE 'warmth_D%' GROUP BY 2, 3
    UNION ALL SELECT 'active_capacity', cp, year, cap_active FROM out WHERE cout = 'power'
    UNION ALL SELECT 'new_capacity', cp, year, cap_new FROM out WHERE cout = 'heat_in_D7' AND (region = 7 OR kind = 'pipe')""")
def bars(spark, folder):
    rows, names = _flows(spark, folder)
    pick = lambda metric, commodity, region: op.bars(rows, metric, commodity, region, names).select(
        F.lit(metric).alias("metric"), "cp", "year", "value")
    return (pick("energy_consumption", "heat_out", op.ALL_REGIONS).union(pick("energy_production", "warmth", op.ALL_REGIONS))
            .union(pick("active_capacity", "power", None)).union(pick("new_capacity", "heat_in", 7)))


@query("metric:s cp:s time:i value:d3", """
    WITH h AS (SELECT event_type || '_D' || user_id AS cp, event_type AS base, user_id, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS time,
                      sum(value) AS v FROM events GROUP BY ALL)
    SELECT 'energy_production' AS metric, base AS cp, time, sum(v) AS value FROM h GROUP BY 2, 3
    UNION ALL SELECT 'power_consumption', cp, time, v * 2 FROM h WHERE user_id = 7""")
def timeseries(spark, folder):
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    user = c("user_id").cast("string")
    rows = table(spark, folder, "events").groupBy(
        F.concat("event_type", F.lit("_D"), user).alias("cp"), F.concat(F.lit("heat_D"), user).alias("cout"),
        hour.cast("int").alias("time")).agg(F.sum("value").alias("eouttime")).withColumns(
        {"cin": c("cout"), "year": F.lit(2024), "pin": c("eouttime") * 2})
    rows = cut_lineage(rows)
    names = rows.select(c("cout").alias("name")).distinct()
    first = op.timeseries(rows, "energy_production", 2024, "heat", op.ALL_REGIONS, names)
    second = op.timeseries(rows, "power_consumption", 2024, "heat", 7, names)
    return first.withColumn("metric", F.lit("energy_production")).unionByName(
        second.withColumn("metric", F.lit("power_consumption")))


@query("source:s target:s value:d5 source_i:i target_i:i", f"""
    WITH {_OUT}, y AS (SELECT * FROM out WHERE year = 1996),
    l AS (SELECT CASE WHEN kind = 'pipe' AND region <> 7 THEN 'from Region ' || region ELSE cin END AS source, cp AS target, eouttot * 1.25 AS value
          FROM y WHERE cin <> 'Dummy' AND NOT starts_with(cin, 'Help_') AND (region = 7 OR kind = 'trade' OR (kind = 'pipe' AND region = 6))
          UNION ALL
          SELECT cp, CASE WHEN kind = 'pipe' AND region = 7 THEN 'to Region 8' ELSE cout END, eouttot
          FROM y WHERE cout <> 'Dummy' AND (region = 7 OR kind = 'trade' OR (kind = 'pipe' AND region = 6))),
    n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT source AS node FROM l UNION SELECT target FROM l))
    SELECT source, target, value, a.i AS source_i, b.i AS target_i FROM l JOIN n a ON a.node = source JOIN n b ON b.node = target""")
def sankey_links(spark, folder):
    rows, _ = _flows(spark, folder)
    return op.sankey_numbers(cut_lineage(op.sankey_links(rows, 1996, 7)))


# --- investment ---------------------------------------------------------------------------------------------------

def _params(rows):
    """Costs by process number: every third has a base cost, every fourth a limited unit."""
    n = F.coalesce(F.regexp_extract("cp", r"#([0-9]+)", 1).try_cast("int"), F.lit(0))
    return rows.select("cp", "cin", "cout", "year", F.when(n % 3 == 0, n * 1000.0).otherwise(0.0).alias("capex_cost_base"),
                       (n * 10.0).alias("capex_cost_power"), (n + 2.0).alias("technical_lifetime"),
                       F.when(n % 4 == 0, 0.04).alias("cap_max_unit"))


_PARAM = "par AS (SELECT *, coalesce(CASE WHEN kind <> 'trade' THEN n END, 0) AS k FROM out)"


@query("cp:s cin:s cout:s", f"WITH {_OUT}, {_PARAM} SELECT DISTINCT cp, cin, cout FROM par WHERE k % 3 = 0 AND k > 0")
def base_cost_set(spark, folder):
    return op.base_cost_set(_params(outputs(spark, folder)))


@query("cp:s cin:s cout:s year:i cap_new:d4 unit_size:d2 rule:s", f"""
    WITH {_OUT}, {_PARAM}
    SELECT cp, cin, cout, year, cap_new, 0.04 AS unit_size, 'capacity above built units' AS rule FROM par
    WHERE k % 12 = 0 AND k > 0 AND cap_new > 0.04 * newly_installed_units + 0.000001
    UNION ALL SELECT cp, cin, cout, year, cap_new, 1000000.0, 'unlimited unit built more than once' FROM par
    WHERE k % 3 = 0 AND k % 4 <> 0 AND k > 0 AND newly_installed_units > 1""")
def unit_build_check(spark, folder):
    rows = outputs(spark, folder)
    return op.unit_build_check(rows, _params(rows))


@query("investment:d1 base:d1 salvage:d1 capex:d1", f"""
    WITH {_OUT}, {_PARAM}, m AS (SELECT max(year) AS last FROM par),
    s AS (SELECT pow(0.97, year - 1990) AS disc, cap_new * k * 10.0 AS p,
                 CASE WHEN k % 3 = 0 THEN newly_installed_units * k * 1000.0 ELSE 0 END AS b,
                 greatest(0, 1 - (last - year + 1) / (k + 2.0)) AS keep FROM par, m)
    SELECT sum(disc * p) AS investment, sum(disc * b) AS base, sum((p + b) * keep) * 0.7 AS salvage,
           sum(disc * p) + sum(disc * b) - sum((p + b) * keep) * 0.7 AS capex FROM s""")
def capex_accounting(spark, folder):
    rows = outputs(spark, folder)
    last = rows.agg(F.max("year").alias("m")).first()["m"]
    discount = rows.select("year").distinct().withColumn("d", F.pow(F.lit(0.97), c("year") - 1990))
    return op.capex_accounting(rows, _params(rows), discount, last, 0.7)
