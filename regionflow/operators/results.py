"""Solver result tables back into tidy tables, summaries and chart data."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.text import base_name, capitalised, name_regions, region_name, two_places
from regionflow.functions.units import SYSTEM_LABELS, result_factors
from regionflow.operators.energy import of_kind
from regionflow.operators.techmap import DUMMY, scoped_commodity
from regionflow.scale import attach, cut_lineage, dense_index, with_totals

c = F.col
#: Results at or below this count as inactive.
ACTIVE = 1e-3
MEASURES = ["cap_active", "cap_new", "eouttot", "newly_installed_units"]


# --- reading ------------------------------------------------------------------------------------------

def subprocess_outputs(tables: dict[str, DataFrame]) -> DataFrame:
    """``cp, cin, cout, year`` and the measures (NULL = 0) from the solver's six tables."""
    commodity = tables["commodity"]
    # names meet the subprocesses, of which there are fewer than results, and each name replaces its id
    named = (tables["conversion_subprocess"].select(c("id").alias("cs_id"), "cp_id", "cin_id", "cout_id")
             .join(tables["conversion_process"].select(c("id").alias("cp_id"), c("name").alias("cp")), "cp_id").drop("cp_id")
             .join(commodity.select(c("id").alias("cin_id"), c("name").alias("cin")), "cin_id").drop("cin_id")
             .join(commodity.select(c("id").alias("cout_id"), c("name").alias("cout")), "cout_id").drop("cout_id"))
    rows = (tables["output_cs_y"].select("cs_id", "y_id", *MEASURES)
            .join(tables["year"].select(c("id").alias("y_id"), c("value").alias("year")), "y_id").drop("y_id")
            .join(named, "cs_id"))
    return rows.select("cp", "cin", "cout", c("year").cast("int").alias("year"),
                       *[F.coalesce(c(m), F.lit(0.0)).cast("double").alias(m) for m in MEASURES])


def global_totals(output_global: DataFrame) -> DataFrame:
    """One row ``opex, capex, totex``; zeros if the solver wrote none, an error if it wrote several."""
    several = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the solver wrote more than one row of totals")))
    return output_global.agg(*[F.coalesce(several.cast("double"), F.max(c(n).cast("double")), F.lit(0.0)).alias(n)
                               for n in ("opex", "capex", "totex")])


def emissions_by_year(output_y: DataFrame, year: DataFrame) -> DataFrame:
    rows = output_y.join(year.select(c("id").alias("y_id"), c("value").alias("year")), "y_id")
    return (rows.groupBy(c("year").cast("int").alias("year"))
            .agg(F.sum("total_annual_co2_emission").alias("amount")).orderBy("year"))


#: Result columns and the quantity whose factor rescales them.
QUANTITY = {"cap_active": "power", "cap_new": "power", "eouttot": "energy", "opex": "money", "capex": "money",
            "totex": "money", "amount": "co2_emissions"}


def rescale_results(rows: DataFrame, system_unit: str) -> DataFrame:
    """Solver units back to the system's units, for every known column present."""
    factors = result_factors(system_unit)
    return rows.withColumns({n: c(n) / F.lit(factors[q]) for n, q in QUANTITY.items() if n in rows.columns})


# --- tidy tables ----------------------------------------------------------------------------------------

def _values() -> list[Column]:
    return [c("cap_active").alias("capacity"), c("eouttot").alias("energy_output"), c("cap_new").alias("new_capacity")]


def _matched(assets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of the assets' processes: equal ``cp, cin, cout``."""
    return assets.join(outputs, ["cp", "cin", "cout"])


def _named(assets: DataFrame, scoped: list[str]) -> DataFrame:
    return assets.withColumns({
        "cp": region_name(c("name"), c("region_id")),
        "cin": scoped_commodity(c("commodity_in"), c("region_id"), scoped),
        "cout": scoped_commodity(c("commodity_out"), c("region_id"), scoped)})


def decentral_results(outputs: DataFrame, assets: DataFrame, demands: DataFrame, scoped: list[str]) -> DataFrame:
    """Rows per demand; two demands on one commodity of a region: the last one names the result."""
    names = demands.groupBy("region_id", c("commodity").alias("commodity_out")).agg(
        F.max_by("demand", "demand_ord").alias("demand"))
    own = assets.filter("kind = 'decentral'").select("name", "region_id", "commodity_in", "commodity_out").distinct()
    rows = _matched(_named(own.join(names, ["region_id", "commodity_out"]), scoped), outputs)
    return rows.select("demand", "year", c("name").alias("technology"), "region_id", *_values())


def central_results(outputs: DataFrame, assets: DataFrame, scoped: list[str]) -> DataFrame:
    """Rows per output commodity; a CHP gives one per output, both fed by its helper commodity."""
    own = assets.filter(c("kind").isin("central", "chp"))
    chp = c("kind") == "chp"
    outs = F.when(chp, F.array("commodity_out", "commodity_out_2")).otherwise(F.array("commodity_out"))
    process = region_name(c("name"), c("region_id"))
    rows = own.select("name", "region_id", "commodity_in", "kind", F.explode(outs).alias("commodity")).withColumns({
        "cp": process, "cout": scoped_commodity(c("commodity"), c("region_id"), scoped),
        "cin": F.when(chp, F.concat(F.lit("Help_"), process)).otherwise(
            scoped_commodity(c("commodity_in"), c("region_id"), scoped))})
    return _matched(rows, outputs).select("commodity", "year", c("name").alias("technology"), "region_id",
                                          *_values(), "newly_installed_units")


def grid_results(outputs: DataFrame, assets: DataFrame, scoped: list[str]) -> DataFrame:
    rows = _matched(_named(assets.filter("kind = 'grid'"), scoped), outputs)
    return rows.select(c("commodity_in").alias("commodity"), "year", c("name").alias("technology"), "region_id", *_values())


def pipe_results(outputs: DataFrame, pipes: DataFrame, scoped: list[str]) -> DataFrame:
    rows = pipes.withColumns({
        "cp": region_name(c("name"), c("region_in"), c("region_out")),
        "cin": scoped_commodity(c("commodity_in"), c("region_in"), scoped),
        "cout": scoped_commodity(c("commodity_out"), c("region_out"), scoped)})
    return _matched(rows, outputs).select(
        c("commodity_out").alias("commodity"), "year", c("name").alias("technology"),
        c("region_in").alias("region_id_from"), c("region_out").alias("region_id_to"), *_values())


def _trade_results(outputs: DataFrame, trade: DataFrame, kind: str) -> DataFrame:
    imported = F.lit(kind == "Import")
    rows = trade.filter(c("kind") == kind).select(
        "commodity", F.concat("kind", capitalised(c("commodity"))).alias("cp"),
        F.when(imported, DUMMY).otherwise(c("commodity")).alias("cin"),
        F.when(imported, c("commodity")).otherwise(DUMMY).alias("cout"))
    return _matched(rows, outputs)


def import_results(outputs: DataFrame, trade: DataFrame) -> DataFrame:
    return _trade_results(outputs, trade, "Import").select("commodity", "year", *_values())


def export_results(outputs: DataFrame, trade: DataFrame) -> DataFrame:
    return _trade_results(outputs, trade, "Export").select("commodity", "year", *_values()).withColumnRenamed(
        "energy_output", "energy_input")


def sort_results(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[n for n in ("year", "technology") if n in rows.columns])


# --- report ------------------------------------------------------------------------------------------------

# Size of the given unit, and display units from small to large.
MONEY_SIZE = {"EUR": 1.0, "k EUR": 1e3, "Mio EUR": 1e6}
CO2_SIZE = {"t": 1.0, "kilo t": 1e3, "Mio t": 1e6}
MONEY_DISPLAY = [("€", 1.0), ("k€", 1e3), ("Mio €", 1e6), ("Bil €", 1e9)]
CO2_DISPLAY = [("t", 1.0), ("kt", 1e3), ("Mio t", 1e6), ("Bil t", 1e9)]


def format_scaled(value: Column, kind: str, unit: str) -> Column:
    """``12.35 Mio €``: the smallest display unit that keeps the rounded value below 1000."""
    sizes, display = (MONEY_SIZE, MONEY_DISPLAY) if kind == "money" else (CO2_SIZE, CO2_DISPLAY)
    amount = value * sizes[unit]

    def text(label: str, size: float) -> tuple[Column, Column]:
        rounded = two_places(amount / size)
        return F.abs(rounded) < 1000, F.concat(F.format_string("%.2f", rounded), F.lit(f" {label}"))

    fits, shown = text(*display[0])
    result = F.when(fits, shown)
    for label, size in display[1:-1]:
        fits, shown = text(label, size)
        result = result.when(fits, shown)
    return F.when(value.isNotNull(), result.otherwise(text(*display[-1])[1]))


def with_unit_headers(rows: DataFrame, system_unit: str) -> DataFrame:
    labels = SYSTEM_LABELS[system_unit]
    return rows.withColumnsRenamed({
        "capacity": f"capacity [{labels['power']}]", "new_capacity": f"new_capacity [{labels['power']}]",
        "energy_output": f"energy_output [{labels['energy']}]"})


def report_tables(groups: dict[str, DataFrame], totals: DataFrame, emissions: DataFrame, system_unit: str,
                  metadata: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a report: metadata, formatted costs and emissions, the sorted rows of each result
    group, and how many rows each has.

    A group's rows are stored: the sort reads them twice, to find its ranges and to sort, and the count once more.
    """
    groups = {name: cut_lineage(rows, compact=True) for name, rows in groups.items()}
    labels = SYSTEM_LABELS[system_unit]
    spark = totals.sparkSession
    tables = {
        "metadata": spark.createDataFrame(list(metadata.items()), "key string, value string"),
        "costs": totals.select(*[format_scaled(c(n), "money", labels["money"]).alias(n) for n in ("opex", "capex", "totex")]),
        "emissions": emissions.withColumn("amount", format_scaled(c("amount"), "co2", labels["co2_emissions"])),
    }
    for name, rows in groups.items():
        tables[name] = with_unit_headers(sort_results(rows), system_unit)
    tables["counts"] = reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, rows in groups.items()])
    return tables


# --- chart data ----------------------------------------------------------------------------------------------

def slice_results(rows: DataFrame | None, year: int, technology: str | None = None) -> DataFrame | None:
    """Rows of one year, optionally one technology; a missing table stays missing."""
    if rows is None:
        return None
    found = rows.filter(c("year") == year)
    return found if technology is None else found.filter(c("technology") == technology)


def active_rows(rows: DataFrame, metric: str) -> DataFrame:
    return rows.filter(c(metric) > ACTIVE)


# Chart metrics and the result columns they show.
DECENTRAL_METRICS = {"energy_output": "energy_output", "new_capacity": "new_capacity", "active_capacity": "capacity"}
GRID_METRICS = {"capacity": "capacity", "energy_output": "energy_output"}


def decentral_share(rows: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """Per region, year and technology the summed positive values and their share of the total."""
    if metric not in DECENTRAL_METRICS:
        raise DataError(f"unknown metric {metric!r}")
    if not years:
        raise DataError("at least one year is needed")
    column = DECENTRAL_METRICS[metric]
    sums = (rows.filter(c("year").isin(years) & (c(column) > 0))
            .groupBy("region_id", "year", "technology").agg(F.sum(column).alias("value")))
    shared = with_totals(sums, ["region_id", "year"], _total=F.sum("value"))
    return shared.withColumn("share", c("value") / c("_total")).drop("_total")


def demand_in_year(demands: DataFrame, commodity: str, start: int, year: int) -> DataFrame:
    """Demand per region of one commodity, ``max(0, year - start)`` years after the start."""
    after = max(0, year - start)
    return demands.filter(c("commodity") == commodity).select(
        "region_id", "demand", (c("value") * F.pow(1 - c("yearly_decrease"), F.lit(after))).alias("value"))


def grid_supplied(rows: DataFrame, assets: DataFrame, commodity: str, year: int, column: str = "capacity") -> DataFrame:
    """Summed positive values of decentral technologies fed by ``commodity``: ``region_id, technology, value``."""
    fed = assets.filter((c("kind") == "decentral") & (c("commodity_in") == commodity)).select(
        "region_id", c("name").alias("technology")).distinct()
    return (rows.filter((c("year") == year) & (c(column) > 0)).join(fed, ["region_id", "technology"], "left_semi")
            .groupBy("region_id", "technology").agg(F.sum(column).alias("value")))


def _as_list(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """A region's (label, value) pairs as one sorted array; a region has a handful of technologies."""
    return rows.groupBy("region_id").agg(F.array_sort(F.collect_list(
        F.struct(c(label).alias("name"), c(value).alias("value")))).alias(name))


def grid_overview(grid_name: str, types: DataFrame, assets: DataFrame, demands: DataFrame, grids: DataFrame,
                  central: DataFrame, decentral: DataFrame, start: int, year: int, metric: str = "capacity") -> DataFrame:
    """One row per region where the grid is active in ``year``: its length, the demands it serves, its
    value, central technologies feeding it and decentral technologies fed by it."""
    if metric not in GRID_METRICS:
        raise DataError(f"unknown metric {metric!r}")
    column = GRID_METRICS[metric]
    grid = of_kind(types, "grid").filter(c("name") == grid_name).select("commodity_in", "commodity_out").first()
    if grid is None:
        raise DataError(f"grid {grid_name!r} not found")
    own = slice_results(grids.filter(c("commodity") == grid["commodity_in"]), year, grid_name)
    active = active_rows(own, column).select("region_id", c(column).alias("grid_value"))
    lengths = assets.filter((c("kind") == "grid") & (c("name") == grid_name)).select("region_id", "length_km")
    served = demand_in_year(demands, grid["commodity_out"], start, year)
    feeding = active_rows(slice_results(central.filter(c("commodity") == grid["commodity_in"]), year), column)
    fed = grid_supplied(decentral, assets, grid["commodity_out"], year, column)
    return (active.join(lengths, "region_id", "left")
            .join(_as_list(served, "demands", "demand", "value"), "region_id", "left")
            .join(_as_list(feeding, "central", "technology", column), "region_id", "left")
            .join(_as_list(fed, "grid_fed", "technology", "value"), "region_id", "left"))


def pipe_status(pipes: DataFrame, results: DataFrame, year: int, metric: str = "capacity") -> DataFrame:
    """Active directed pipes with their value; inactive pairs once: ``region_in, region_out, active, value``.

    If ``pipes`` has a column ``technology``, each type's pipes are judged by that type's results and the column is kept.
    """
    column, own = GRID_METRICS[metric], [n for n in pipes.columns if n == "technology"]
    live = active_rows(slice_results(results, year), column).select(
        *own, c("region_id_from").alias("region_in"), c("region_id_to").alias("region_out"), c(column).alias("value"))
    key = [*own, "region_in", "region_out"]
    known = pipes.select(key).distinct()
    active = known.join(live, key).select(*key, F.lit(True).alias("active"), "value")
    rest = known.join(live, key, "left_anti")
    once = rest.select(*own, F.least("region_in", "region_out").alias("region_in"),
                       F.greatest("region_in", "region_out").alias("region_out")).distinct()
    return active.unionByName(once.select(*key, F.lit(False).alias("active"), F.lit(None).cast("double").alias("value")))


# --- names with region suffixes ----------------------------------------------------------------------------

def parse_names(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumns({"base": base_name(c(column)), "regions": name_regions(c(column))})


def regions_of(names: DataFrame, column: str) -> DataFrame:
    return (names.select(F.explode(name_regions(c(column))).alias("region_id")).distinct().orderBy("region_id"))


def base_names(names: DataFrame, column: str) -> DataFrame:
    return names.select(base_name(c(column)).alias("base")).distinct().orderBy("base")


ALL_REGIONS = "all regions"


def scope_filter(rows: DataFrame, commodity: str, region, column: str, commodities: DataFrame) -> DataFrame:
    """Rows whose ``column`` is the commodity in scope: global (None), one region, or all regions.

    One region falls back to the bare commodity and keeps processes that are global or touch the
    region. ``commodities(name)`` are all known names.
    """
    def known(name: str) -> bool:
        return not commodities.filter(c("name") == name).isEmpty()

    if region == ALL_REGIONS:
        found = rows.filter(base_name(c(column)) == commodity)
        if commodities.filter(base_name(c("name")) == commodity).isEmpty():
            raise DataError(f"no commodity with base name {commodity!r}")
        return found
    if region is None:
        if not known(commodity):
            raise DataError(f"commodity {commodity!r} not found; it may exist per region")
        return rows.filter(c(column) == commodity)
    if not isinstance(region, int):
        raise DataError(f"invalid region {region!r}")
    name = next((n for n in (f"{commodity}_D{region}", commodity) if known(n)), None)
    if name is None:
        raise DataError(f"commodity {commodity!r} not found in region {region}")
    touching = name_regions(c("cp"))
    return rows.filter((c(column) == name) & ((F.size(touching) == 0) | F.array_contains(touching, F.lit(region).cast("bigint"))))


# Metric -> (result column, commodity side).
BAR_METRICS = {"energy_consumption": ("eintot", "cin"), "energy_production": ("eouttot", "cout"),
               "active_capacity": ("cap_active", "cout"), "new_capacity": ("cap_new", "cout")}
SERIES_METRICS = {"energy_consumption": ("eintime", "cin"), "energy_production": ("eouttime", "cout"),
                  "power_consumption": ("pin", "cin"), "power_production": ("pout", "cout")}


def _scoped_values(rows: DataFrame, metric: tuple[str, str], commodity: str, region, commodities: DataFrame,
                   axes: list[str]) -> DataFrame:
    variable, side = metric
    found = scope_filter(rows, commodity, region, side, commodities).withColumn("value", c(variable))
    if region == ALL_REGIONS:
        return found.groupBy(base_name(c("cp")).alias("cp"), *axes).agg(F.sum("value").alias("value"))
    return found.select("cp", *axes, "value")


def bars(outputs: DataFrame, metric: str, commodity: str, region, commodities: DataFrame) -> DataFrame:
    """Yearly value per process; over all regions suffixes are stripped and values summed."""
    if metric not in BAR_METRICS:
        raise DataError(f"unsupported metric {metric!r}")
    return _scoped_values(outputs, BAR_METRICS[metric], commodity, region, commodities, ["year"])


def timeseries(hourly: DataFrame, metric: str, year: int, commodity: str, region, commodities: DataFrame) -> DataFrame:
    """Hourly value per process in one year."""
    if metric not in SERIES_METRICS:
        raise DataError(f"unsupported metric {metric!r}")
    rows = hourly.filter(c("year") == year)
    if rows.isEmpty():
        raise DataError(f"year {year} is not in the results")
    return _scoped_values(rows, SERIES_METRICS[metric], commodity, region, commodities, ["year", "time"])


def sankey_links(outputs: DataFrame, year: int, region: int) -> DataFrame:
    """Flows of one region: ``source, target, value``.

    Helper nodes are dropped; the foreign end of a pipe becomes ``from Region x`` / ``to Region y``.
    """
    rows = outputs.filter(c("year") == year)
    helper = lambda n: (c(n) == DUMMY) | c(n).startswith("Help_")
    of_process = name_regions(c("cp"))
    pipe = F.size(of_process) == 2
    r_in, r_out = F.get(of_process, F.lit(0)), F.get(of_process, F.lit(1))

    def local(name: str) -> Column:
        found = name_regions(c(name))
        return (F.size(found) == 0) | (F.get(found, F.lit(0)) == region)

    consumed = (rows.filter(~helper("cin") & ~helper("cp") & (c("cin") != c("cp")))
                .filter(F.when(pipe, (r_in == region) | (r_out == region)).otherwise(local("cp") & local("cin")))
                .select(F.when(pipe & (r_in != region), F.concat(F.lit("from Region "), r_in.cast("string")))
                        .otherwise(c("cin")).alias("source"), c("cp").alias("target"), c("eintot").alias("value")))
    produced = (rows.filter(~helper("cout") & ~helper("cp") & (c("cout") != c("cp")))
                .filter(F.when(pipe, (r_in == region) | (r_out == region)).otherwise(local("cp") & local("cout")))
                .select(c("cp").alias("source"),
                        F.when(pipe & (r_in == region), F.concat(F.lit("to Region "), r_out.cast("string")))
                        .otherwise(c("cout")).alias("target"), c("eouttot").alias("value")))
    return consumed.unionByName(produced)


def sankey_numbers(links: DataFrame) -> DataFrame:
    """Links with 0-based node numbers in name order."""
    nodes = links.select(c("source").alias("node")).unionByName(links.select(c("target").alias("node"))).distinct()
    numbered = dense_index(nodes, "node", "number")
    rows = attach(links, numbered.select(c("node").alias("source"), c("number").alias("source_i")), ["source"])
    return attach(rows, numbered.select(c("node").alias("target"), c("number").alias("target_i")), ["target"])


# --- investment bookkeeping ------------------------------------------------------------------------------------

#: A unit size of 1e6 means "no limit"; such processes build 0 or 1 units.
UNLIMITED_UNIT = 1e6
_KEY = ["cp", "cin", "cout"]


def base_cost_set(params: DataFrame) -> DataFrame:
    """Processes with a positive base cost in some year."""
    return params.filter("capex_cost_base > 0").select(*_KEY).distinct()


def unit_build_check(results: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of :func:`base_cost_set` processes that break the unit rules: ``..., rule``.

    New capacity may not exceed unit size times units built; an unlimited unit is built at most once.
    """
    sizes = params.groupBy(*_KEY).agg(F.max("cap_max_unit").alias("unit_size"))
    rows = results.join(base_cost_set(params), _KEY, "left_semi").join(sizes, _KEY)
    size = F.coalesce("unit_size", F.lit(UNLIMITED_UNIT))
    units = c("newly_installed_units")
    slack = 1e-6 * F.greatest(F.lit(1.0), size)
    rules = F.array(
        F.when(c("cap_new") > size * units + slack, "capacity above built units"),
        F.when((size == UNLIMITED_UNIT) & ~units.isin(0, 1), "unlimited unit built more than once"))
    return rows.select(*_KEY, "year", "cap_new", "newly_installed_units", size.alias("unit_size"),
                       F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def capex_accounting(results: DataFrame, params: DataFrame, discount: DataFrame, last_year: int,
                     horizon_discount: float) -> DataFrame:
    """One row ``investment, base, salvage, capex``.

    ``discount(year, d)`` and the discount to the horizon are inputs. Salvage is the unused
    straight-line share of every investment whose lifetime reaches beyond the last year.
    """
    rows = (results.join(params.select(*_KEY, "year", "capex_cost_power", "capex_cost_base", "technical_lifetime"),
                         [*_KEY, "year"])
            .join(base_cost_set(params).withColumn("_based", F.lit(True)), _KEY, "left")
            .join(discount, "year"))
    power = c("cap_new") * c("capex_cost_power")
    base = F.when(c("_based"), c("newly_installed_units") * c("capex_cost_base")).otherwise(0.0)
    used = F.lit(last_year) - c("year") + 1
    left = F.when(used < c("technical_lifetime"), 1 - used / c("technical_lifetime")).otherwise(0.0)
    sums = rows.agg(F.sum(c("d") * power).alias("investment"), F.sum(c("d") * base).alias("base"),
                    (F.sum((power + base) * left) * horizon_discount).alias("salvage"))
    return sums.withColumn("capex", c("investment") + c("base") - c("salvage"))
