"""The six model-input tables handed to a solver."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.config import config_frame
from regionflow.functions.text import capitalised, colour_of, general_format, region_name
from regionflow.functions.units import MODEL_SCALE, model_units
from regionflow.operators.catalog import YEARS, Scenario, year_values
from regionflow.operators.energy import (
    capacity_trajectory, demand_by_year, grid_cost, max_capacity_trajectory, rebase_years, require_empty)
from regionflow.scale import attach, cut_lineage, dense_index, running

c = F.col

# The columns of the process table and their types.
SUBPROCESS_COLUMNS = {
    "conversion_process_name": "string", "commodity_in": "string", "commodity_out": "string",
    "scenario": "string", "spec_co2": "string", "efficiency": "double",
    "technical_lifetime": "double", "technical_availability": "double", "c_rate": "double",
    "efficiency_charge": "double", "is_storage": "boolean", "opex_cost_energy": "string",
    "opex_cost_power": "string", "capex_cost_power": "string", "capex_cost_base": "string",
    "cap_active": "string", "cap_max_unit": "double", "max_eout": "string", "min_eout": "string",
    "cap_min": "string", "cap_max": "string", "cap_res_min": "string", "cap_res_max": "string",
    "out_frac_min": "double", "out_frac_max": "double", "in_frac_min": "double",
    "in_frac_max": "double", "availability_profile": "string", "output_profile": "string",
}
DUMMY = "Dummy"


def region_scoped(records: list[dict]) -> list[str]:
    """Commodities that exist per region: those of grids and those decentral technologies make."""
    names = set()
    for record in records:
        if record["kind"] == "grid":
            names |= {record["commodity_in"], record["commodity_out"]}
        elif record["kind"] == "decentral":
            names.add(record["commodity_out"])
    return sorted(names)


def scoped_commodity(name: Column, region: Column, scoped: list[str]) -> Column:
    """``<name>_D<region>`` for region-scoped commodities, else the name."""
    return F.when(name.isin(scoped), region_name(name, region)).otherwise(name)


def encode_years(series: Column, scale: bool = False) -> Column:
    """Year-value rows as ``[year value;year NaN]`` text, 5 significant digits.

    A single number stays a plain number, all values missing gives NULL. ``scale`` converts to
    model units.
    """
    scaled = (lambda v: v * MODEL_SCALE) if scale else (lambda v: v)
    single = F.element_at(series, 1)
    ordered = F.array_sort(series)
    text = F.array_join(F.transform(ordered, lambda e: F.concat(
        e["year"].cast("string"), F.lit(" "),
        F.coalesce(general_format(scaled(e["value"]), 5), F.lit("NaN")))), ";")
    return (F.when(series.isNull() | (F.size(series) == 0) | ~F.exists(series, lambda e: e["value"].isNotNull()),
                   F.lit(None).cast("string"))
            .when((F.size(series) == 1) & single["year"].isNull(), scaled(single["value"]).cast("string"))
            .otherwise(F.concat(F.lit("["), text, F.lit("]"))))


def _number(value: Column, scale: bool = False) -> Column:
    return (value * MODEL_SCALE if scale else value).cast("string")


def _rows(table: DataFrame, scenario: Scenario, order: list[Column], block: int, **columns: Column) -> DataFrame:
    """Project to the process table's columns plus its order (``block``, ``ord``)."""
    given = {"scenario": F.lit(scenario.name), **columns}
    unknown = set(given) - set(SUBPROCESS_COLUMNS)
    assert not unknown, unknown
    return table.select(
        F.lit(block).alias("block"), F.struct(*[o.cast("long").alias(f"o{i}") for i, o in enumerate(order)]).alias("ord"),
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in SUBPROCESS_COLUMNS.items()])


def _order(*columns: str) -> list[Column]:
    keys = [c(n) for n in columns]
    return keys + [F.lit(0)] * (4 - len(keys))


def trade_rows(trade: DataFrame, scenario: Scenario) -> DataFrame:
    """Imports come from ``Dummy``, exports go there; the export's energy limit is an output limit."""
    years = lambda n: rebase_years(c(n), scenario.start_year)
    imported = c("kind") == "Import"
    return _rows(
        trade.withColumn("_e", F.when(imported, 0).otherwise(1)), scenario, _order("_e", "ord"), 0,
        conversion_process_name=F.concat("kind", capitalised(c("commodity"))),
        commodity_in=F.when(imported, DUMMY).otherwise(c("commodity")),
        commodity_out=F.when(imported, c("commodity")).otherwise(DUMMY),
        opex_cost_energy=encode_years(years("price")), spec_co2=encode_years(years("co2")),
        cap_max=encode_years(years("max_cap"), True), max_eout=encode_years(years("max_energy"), True))


def _bounded(assets: DataFrame, start: int) -> DataFrame:
    return max_capacity_trajectory(capacity_trajectory(assets, start), start)


def _bounds() -> dict[str, Column]:
    kept = encode_years(c("capacity"), True)
    return {"cap_max": encode_years(c("capacity_limit"), True), "cap_res_min": kept, "cap_res_max": kept}


def pipe_rows(pipes: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    return _rows(
        _bounded(pipes, scenario.start_year), scenario, _order("ord", "region_in", "region_out"), 1,
        conversion_process_name=region_name(c("name"), c("region_in"), c("region_out")),
        commodity_in=scoped_commodity(c("commodity_in"), c("region_in"), scoped),
        commodity_out=scoped_commodity(c("commodity_out"), c("region_out"), scoped),
        efficiency=c("efficiency"), technical_lifetime=c("technical_lifetime"),
        capex_cost_base=_number(c("investment"), True), **_bounds())


def demand_rows(demands: DataFrame, names: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    """``names``: ``series, profile_name`` from :func:`profile_names`."""
    yearly = demand_by_year(demands, scenario.years)
    paths = yearly.groupBy("region_id", "demand", "demand_ord", "commodity", "series").agg(
        F.array_sort(F.collect_list(F.struct("year", "value"))).alias("path"))
    rows = attach(paths, names, ["series"])
    return _rows(
        rows, scenario, _order("region_id", "demand_ord"), 2,
        conversion_process_name=region_name(c("demand"), c("region_id")),
        commodity_in=scoped_commodity(c("commodity"), c("region_id"), scoped),
        commodity_out=F.lit(DUMMY), min_eout=encode_years(c("path"), True), output_profile=c("profile_name"))


def decentral_rows(assets: DataFrame, names: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    rows = attach(_bounded(assets, scenario.start_year), names, ["series"])
    require_empty(rows.filter(c("series").isNotNull() & c("profile_name").isNull()).select("name", "region_id"),
                  "the output profile matches no demand profile")
    return _rows(
        rows, scenario, _order("region_id", "demand_ord", "ord"), 3,
        conversion_process_name=region_name(c("name"), c("region_id")),
        commodity_in=scoped_commodity(c("commodity_in"), c("region_id"), scoped),
        commodity_out=scoped_commodity(c("commodity_out"), c("region_id"), scoped),
        efficiency=c("efficiency"), technical_lifetime=c("technical_lifetime"),
        opex_cost_energy=_number(c("opex_cost_energy")), opex_cost_power=_number(c("opex_cost_power")),
        capex_cost_power=_number(c("capex_cost_power")), output_profile=c("profile_name"), **_bounds())


def grid_rows(grids: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    return _rows(
        grid_cost(_bounded(grids, scenario.start_year)), scenario, _order("region_id", "ord"), 4,
        conversion_process_name=region_name(c("name"), c("region_id")),
        commodity_in=scoped_commodity(c("commodity_in"), c("region_id"), scoped),
        commodity_out=scoped_commodity(c("commodity_out"), c("region_id"), scoped),
        efficiency=c("efficiency"), technical_lifetime=c("technical_lifetime"),
        capex_cost_base=_number(c("investment"), True), **_bounds())


def _central_costs() -> dict[str, Column]:
    return dict(
        technical_lifetime=c("technical_lifetime"), opex_cost_energy=_number(c("opex_cost_energy")),
        opex_cost_power=_number(c("opex_cost_power")), capex_cost_power=_number(c("capex_cost_power")),
        capex_cost_base=_number(c("capex_cost_base"), True), cap_max_unit=c("max_capacity_per_unit") * MODEL_SCALE,
        output_profile=c("output_profile"), availability_profile=c("availability_profile"), **_bounds())


def central_rows(assets: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    plain = assets.filter("kind = 'central'")
    return _rows(
        _bounded(plain, scenario.start_year), scenario, _order("region_id", "ord"), 5,
        conversion_process_name=region_name(c("name"), c("region_id")),
        commodity_in=scoped_commodity(c("commodity_in"), c("region_id"), scoped),
        commodity_out=scoped_commodity(c("commodity_out"), c("region_id"), scoped),
        efficiency=c("efficiency"), **_central_costs())


def chp_rows(assets: DataFrame, scoped: list[str], scenario: Scenario) -> DataFrame:
    """Four rows per CHP through a helper commodity: input, loss, main output, second output."""
    chps = _bounded(assets.filter("kind = 'chp'"), scenario.start_year)
    rows = chps.withColumn("step", F.explode(F.lit([0, 1, 2, 3])))
    process = region_name(c("name"), c("region_id"))
    helper = F.concat(F.lit("Help_"), process)
    scope = lambda n: scoped_commodity(c(n), c("region_id"), scoped)
    main = c("step") == 2
    costs = {n: F.when(main, v) for n, v in _central_costs().items()}
    return _rows(
        rows, scenario, _order("region_id", "ord", "step"), 5,
        conversion_process_name=process,
        commodity_in=F.when(c("step") == 0, scope("commodity_in")).otherwise(helper),
        commodity_out=F.when(c("step") == 0, helper).when(c("step") == 1, F.lit(DUMMY))
        .when(main, scope("commodity_out")).otherwise(scope("commodity_out_2")),
        in_frac_min=F.when(c("step") == 1, c("loss")).when(main, c("efficiency")),
        in_frac_max=F.when(main, c("efficiency")), **costs)


def subprocess_table(*blocks: DataFrame) -> DataFrame:
    """All rows; ``block`` and ``ord`` keep the fixed kind order (sort by them to write a sheet)."""
    return reduce(DataFrame.unionByName, blocks)


def dimension(names: DataFrame, column: str, output: str) -> DataFrame:
    """Distinct names with their position in sorted order and a colour."""
    distinct = names.select(c(column).alias(output)).filter(c(output).isNotNull()).distinct()
    return dense_index(distinct, output, "order").withColumn("color", colour_of(c(output)))


# --- profiles ---------------------------------------------------------------------------------------

def profile_hashes(profiles: DataFrame) -> DataFrame:
    """``series, profile_hash`` of the values in hour order, each as a share of the series' sum.

    No series is gathered: a digest adds up two hashes of (position, share) over the rows, so it merges over tasks in any
    order; the series' sum is added up in decimals, which no order changes. Series with equal digests are compared row by row with the first of them; one that
    differs after all has its own name as its digest. A NULL value is a share of its own.
    """
    totals = profiles.groupBy("series").agg(F.coalesce(
        F.try_sum(c("value").try_cast("decimal(38,20)")).cast("double"), F.sum("value")).alias("_t"))
    shares = cut_lineage(running(
        attach(profiles.select("series", "hour", "value"), totals, ["series"], "inner").withColumn(
            "share", F.coalesce(F.try_divide("value", "_t").cast("string"), F.lit("null"))
        ).select("series", "hour", "share"), ["series"], ["hour", "share"], number="at"))
    wide = "decimal(20,0)"
    sums = [F.sum(F.xxhash64("at", "share", F.lit(k)).cast(wide)).cast("string") for k in (1, 2)]
    digests = cut_lineage(shares.groupBy("series").agg(F.count(F.lit(1)).alias("_n"), *[s.alias(f"_s{k}") for k, s in enumerate(sums)])
                          .select("series", F.sha1(F.concat_ws(" ", F.col("_n").cast("string"), "_s0", "_s1")).alias("profile_hash")))
    # Equal digests: each series against the first with its digest, place by place.
    first = digests.groupBy("profile_hash").agg(F.min("series").alias("_first"))
    others = digests.join(first, "profile_hash").filter(c("series") != c("_first")).select("series", "_first")
    theirs = shares.select(c("series").alias("_first"), "at", c("share").alias("_share"))
    differing = (attach(shares, others, ["series"], "inner").join(theirs, ["_first", "at"])
                 .filter(c("share") != c("_share")).select("series").distinct().withColumn("_own", F.sha1("series")))
    return digests.join(differing, "series", "left").select("series", F.coalesce("_own", "profile_hash").alias("profile_hash"))


def profile_names(demands: DataFrame, hashes: DataFrame) -> DataFrame:
    """``profile_hash, profile_name``: the demand's name if its profile is the same everywhere,
    else with the region; a profile shared by demands keeps the first name."""
    used = attach(demands.select("region_id", "demand", "demand_ord", "series"), hashes, ["series"], "inner")
    kinds = used.select("demand", "profile_hash").distinct().groupBy("demand").agg(
        F.count(F.lit(1)).alias("_kinds"))
    # per demand and profile only the first region can give the name
    first = used.groupBy("demand", "profile_hash").agg(
        F.min("demand_ord").alias("demand_ord"), F.min("region_id").alias("region_id"))
    named = first.join(kinds, "demand").withColumn(
        "name", F.when(c("_kinds") == 1, c("demand")).otherwise(F.concat("demand", F.lit("_"), c("region_id").cast("string"))))
    return named.groupBy("profile_hash").agg(
        F.min_by("name", F.struct("demand_ord", "region_id")).alias("profile_name"))


def series_names(hashes: DataFrame, names: DataFrame) -> DataFrame:
    return attach(hashes, names, ["profile_hash"], "inner").select("series", "profile_name")


# --- the whole set ------------------------------------------------------------------------------------

def scenario_table(spark: SparkSession, scenario: Scenario) -> DataFrame:
    """The scenario row: the CO2 price is scaled, the limit is not."""
    raw = config_frame(
        spark, [(scenario.name, scenario.start_year, scenario.end_year, scenario.year_gap,
                 float(scenario.discount_rate), scenario.tss, year_values(scenario.co2_limit),
                 year_values(scenario.co2_price))],
        "scenario_name string, from_year int, until_year int, year_step int, discount_rate double, "
        f"TSS string, lim {YEARS}, price {YEARS}")
    return raw.select("scenario_name", "from_year", "until_year", "year_step", "discount_rate", "TSS",
                      encode_years(c("lim")).alias("annual_co2_limit"),
                      encode_years(c("price"), True).alias("co2_price"))


def create_techmap(spark: SparkSession, scenario: Scenario, system_unit: str, subprocesses: DataFrame
                   ) -> dict[str, DataFrame]:
    """The six tables by sheet name; only a system in kW terms matches their scaling."""
    if system_unit != "kW":
        raise DataError(f"model tables need a system in kW, got {system_unit}")
    return {
        "Units": model_units(spark, "MW"),
        "Scenario": scenario_table(spark, scenario),
        "Commodity": dimension(subprocesses, "commodity_in", "commodity_name"),
        "ConversionProcess": dimension(subprocesses, "conversion_process_name", "conversion_process_name"),
        "ConversionSubProcess": subprocesses.select(*SUBPROCESS_COLUMNS),
        "TSS": config_frame(spark, [(scenario.tss, scenario.dt_hours)], "TSS_name string, dt int"),
    }
