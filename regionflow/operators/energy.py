"""From region values to demands, technology mixes, capacities and assets."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.config import times
from regionflow.functions.units import UNITS
from regionflow.operators.catalog import SUB_KINDS
from regionflow.scale import attach, cut_lineage, with_totals

c = F.col

#: Relative and absolute tolerance of "is 0" and "is 1" tests on shares.
_RTOL, _ATOL = 1e-5, 1e-8


def is_close(value: Column, target: float) -> Column:
    return F.abs(value - target) <= _ATOL + _RTOL * abs(target)


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise with some examples if a query for offenders finds any."""
    bad = rows.limit(20).collect()
    if bad:
        raise DataError(f"{message}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in bad))


# --- demands and profiles ---------------------------------------------------------------------------

def build_demands(values: DataFrame, series: DataFrame, types: DataFrame) -> DataFrame:
    """Demands per region: ``region_id, demand, commodity, value, series, ...``.

    ``values``: ``region_id, demand, value`` in the system's energy unit; ``series``: the profile
    of each region and demand (``region_id, demand, series``); NULL or zero values are no demand.
    """
    found = values.filter(c("value").isNotNull() & (c("value") != 0))
    rows = found.join(types, "demand")
    return rows.join(series, ["region_id", "demand"], "left")


def check_demands(demands: DataFrame, profiles: DataFrame) -> None:
    require_empty(demands.filter(F.isnan("value")).select("region_id", "demand"), "demand value is not a number")
    known = profiles.select("series").distinct()
    require_empty(demands.join(known, "series", "left_anti").select("region_id", "demand"),
                  "demand profile is empty")


def normalise_profile(profiles: DataFrame) -> DataFrame:
    """``series, hour, value`` divided by the series' sum."""
    rows = with_totals(profiles, ["series"], _total=F.sum("value"))
    return rows.select("series", "hour", F.try_divide("value", "_total").alias("value"))


def profile_peaks(profiles: DataFrame) -> DataFrame:
    """Largest value of each normalised series: ``series, peak_share``."""
    return profiles.groupBy("series").agg(F.try_divide(F.max("value"), F.sum("value")).alias("peak_share"))


def peak(demands: DataFrame, profiles: DataFrame) -> DataFrame:
    """Demands with ``peak``: value times the largest normalised profile value."""
    rows = attach(demands, profile_peaks(profiles), ["series"])
    return rows.withColumn("peak", c("value") * c("peak_share")).drop("peak_share")


def demand_by_year(demands: DataFrame, years: list[int]) -> DataFrame:
    """Demand for each scenario year, shrinking by ``yearly_decrease`` per year since the first."""
    rows = demands.withColumn("year", F.explode(F.lit(years)))
    return rows.withColumn("value", c("value") * F.pow(
        1 - c("yearly_decrease"), c("year") - min(years)))


# --- technology mix -----------------------------------------------------------------------------------

def apply_minimum(shares: DataFrame, minimum: dict[str, float]) -> DataFrame:
    """Shares below their technology's minimum become 0."""
    if not minimum:
        return shares
    limits = F.create_map(*[F.lit(v) for pair in minimum.items() for v in pair])
    limit = F.coalesce(F.element_at(limits, c("technology")), F.lit(-1.0))
    return shares.withColumn("share", F.when(c("share") < limit, 0.0).otherwise(c("share")))


def apply_forced(shares: DataFrame, forced: DataFrame, serving: DataFrame) -> DataFrame:
    """Forced shares replace the region's own; the others are scaled to fill the rest.

    ``shares``: ``region_id, demand, technology, share``; ``forced``: ``region_id, technology,
    forced``; ``serving``: ``demand, technology`` (what can serve a demand). Regions without
    forced shares are left alone; with no mass or no rest the others become 0.
    """
    asked = shares.select("region_id", "demand").distinct()
    forced = (asked.join(forced, "region_id").join(serving, ["demand", "technology"], "left_semi"))
    rows = shares.join(forced, ["region_id", "demand", "technology"], "full")
    free = F.when(c("forced").isNull(), c("share"))
    rows = with_totals(rows, ["region_id", "demand"], _forced=F.sum("forced"), _free=F.sum(free))
    rest = 1.0 - c("_forced")
    scaled = F.when((c("_free") > 0) & ~is_close(rest, 0.0), c("share") * rest / c("_free")).otherwise(0.0)
    share = (F.when(c("_forced").isNull(), c("share"))
             .when(c("forced").isNotNull(), c("forced")).otherwise(scaled))
    return rows.select("region_id", "demand", "technology", share.alias("share"),
                       c("_forced").isNotNull().alias("has_forced"))


def normalise_shares(shares: DataFrame) -> DataFrame:
    """Divide by the region's sum unless it is 1; a zero sum gives NULL shares."""
    rows = with_totals(shares, ["region_id", "demand"], _total=F.sum("share"))
    share = F.when(is_close(c("_total"), 1.0), c("share")).otherwise(F.try_divide("share", "_total"))
    return rows.withColumn("share", share).drop("_total")


def fallback_mix(shares: DataFrame, demands: DataFrame, defaults: DataFrame) -> DataFrame:
    """Demands whose shares sum to about zero (or are missing) get their default mix.

    Returns ``region_id, demand, technology, share, is_default``.
    """
    key = ["region_id", "demand"]
    sums = shares.groupBy(*key).agg(F.sum("share").alias("_total"))
    without = (demands.select(*key).join(sums, key, "left")
               .filter(is_close(F.coalesce("_total", F.lit(0.0)), 0.0)).select(*key))
    filled = without.join(defaults, "demand").select(*key, "technology", "share", F.lit(True).alias("is_default"))
    kept = shares.join(without, key, "left_anti").select(*key, "technology", "share", F.lit(False).alias("is_default"))
    return kept.unionByName(filled)


def missing_defaults(shares: DataFrame, demands: DataFrame, defaults: DataFrame) -> DataFrame:
    """Demands that need a default mix but have none configured."""
    key = ["region_id", "demand"]
    sums = shares.groupBy(*key).agg(F.sum("share").alias("_total"))
    return (demands.select(*key).join(sums, key, "left")
            .filter(is_close(F.coalesce("_total", F.lit(0.0)), 0.0))
            .join(defaults, "demand", "left_anti").select(*key))


def technology_mix(shares: DataFrame, demands: DataFrame, defaults: DataFrame, serving: DataFrame,
                   minimum: dict[str, float], forced: DataFrame) -> DataFrame:
    """Shares per demand after defaults, minimum shares, forced shares and normalisation.

    If minimum shares wipe out a mix that has no forced share, the default mix is used.
    """
    key = ["region_id", "demand"]
    # both are read several times below
    start = cut_lineage(fallback_mix(shares, demands, defaults))
    own = apply_minimum(start.filter(~c("is_default")).drop("is_default"), minimum)
    mixed = cut_lineage(apply_forced(own, forced, serving))
    fixed = mixed.filter("has_forced").drop("has_forced")
    plain = normalise_shares(mixed.filter(~c("has_forced")).drop("has_forced"))
    wiped = plain.filter(c("share").isNull()).select(*key).distinct()
    rescued = wiped.join(defaults, "demand").select(*key, "technology", "share")
    return reduce(DataFrame.unionByName, [
        start.filter("is_default").drop("is_default"), fixed,
        plain.filter(c("share").isNotNull()), rescued])


# --- assets ----------------------------------------------------------------------------------------------

_TYPE_FIELDS = ["commodity_in", "commodity_out", "commodity_out_2", "efficiency", "loss", "technical_lifetime",
                "opex_cost_energy", "opex_cost_power", "capex_cost_power", "capex_cost_base", "capex_per_km",
                "distance_threshold_m", "max_capacity_per_unit", "max_capacity", "availability_profile",
                "output_profile", "lifetime_existing"]


def of_kind(types: DataFrame, kind: str) -> DataFrame:
    return types.filter(c("kind").isin(*SUB_KINDS[kind]))


def serving_types(types: DataFrame, demand_types: DataFrame) -> DataFrame:
    """``demand, technology``: decentral technologies whose output is the demand's commodity."""
    return (of_kind(types, "decentral").select(c("commodity_out").alias("commodity"), c("name").alias("technology"))
            .join(demand_types.select("demand", "commodity"), "commodity").select("demand", "technology"))


def power_per_energy(system_unit: str) -> float:
    """Factor from the system's energy per hour to its power (kW system: MWh per hour to kW)."""
    energy = {"kW": "MWh", "MW": "GWh", "GW": "TWh"}[system_unit]
    return UNITS[energy][1] / UNITS[system_unit][1]


def decentral_assets(demands: DataFrame, shares: DataFrame, types: DataFrame, system_unit: str = "kW",
                     strict: bool = True) -> DataFrame:
    """One asset per region, demand and matching technology, also at share 0.

    Capacity is share times peak, energy share times value. The demand's own profile is fixed for
    the asset unless technologies cooperate. Demands without a matching technology are supplied
    by import.
    """
    decentral = of_kind(types, "decentral")
    key = ["region_id", "demand", "technology"]
    if strict:
        suppliable = demands.join(decentral.select(c("commodity_out").alias("commodity")).distinct(),
                                  "commodity", "left_semi").select("region_id", "demand", "commodity")
        stray = (shares.filter("share > 0").join(suppliable, ["region_id", "demand"])
                 .join(decentral.select(c("commodity_out").alias("commodity"), c("name").alias("technology")),
                       ["commodity", "technology"], "left_anti"))
        require_empty(stray.select(*key), "share cannot be assigned to any technology")
    rows = demands.join(decentral.withColumnRenamed("name", "technology")
                        .withColumn("commodity", c("commodity_out")), "commodity")
    rows = rows.join(shares.select(*key, "share"), key, "left")
    share = F.coalesce("share", F.lit(0.0))
    return rows.select(
        F.lit("decentral").alias("kind"), c("technology").alias("name"), "ord", "region_id", "demand", "demand_ord",
        *[n for n in _TYPE_FIELDS if n != "output_profile"],
        (share * c("peak") * power_per_energy(system_unit)).alias("existing_capacity"),
        (share * c("value")).alias("existing_energy_output"),
        F.when(~c("cooperation"), c("series")).alias("series"))


def grid_assets(lengths: DataFrame, decentral: DataFrame, grid_records: list[dict], grid_types: DataFrame
                ) -> DataFrame:
    """One grid per type and region: length in km, capacity fed to decentral technologies.

    ``lengths``: ``region_id, length`` (m). A technology belongs to the first grid type with its
    input commodity.
    """
    regions = times(lengths, [(r["name"],) for r in grid_records], "name string")
    rows = regions.join(grid_types, "name")
    first = grid_types.groupBy(c("commodity_out").alias("commodity_in")).agg(F.min_by("name", "ord").alias("name"))
    fed = (decentral.join(first, "commodity_in").drop(decentral["name"])
           .groupBy("region_id", first["name"]).agg(
               F.sum(c("existing_capacity") / c("efficiency")).alias("existing_capacity")))
    rows = rows.join(fed, ["region_id", "name"], "left")
    return rows.select(F.lit("grid").alias("kind"), "name", "ord", "region_id", *_TYPE_FIELDS,
                       (c("length") / 1000.0).alias("length_km"),
                       F.coalesce("existing_capacity", F.lit(0.0)).alias("existing_capacity"))


def pipe_to_grid(types: DataFrame, strict: bool = True) -> DataFrame:
    """``pipe, grid``: the grid type with the pipe's commodities swapped; first by order."""
    pipes, grids = of_kind(types, "pipe"), of_kind(types, "grid")
    # one grid per pair of commodities before the join: many types may share a pair
    first = grids.groupBy(c("commodity_out").alias("i"), c("commodity_in").alias("o")).agg(
        F.min_by("name", "ord").alias("grid"), F.min("ord").alias("ord"))
    wanted = pipes.select(c("name").alias("pipe"), c("commodity_in").alias("i"), c("commodity_out").alias("o"))
    pairs = attach(wanted, first, ["i", "o"]).groupBy("pipe").agg(F.min_by("grid", "ord").alias("grid"))
    if strict:
        require_empty(pairs.filter(c("grid").isNull()).select("pipe"), "no grid type fits the pipe")
    return pairs


def street_constraint(types: DataFrame, edges: DataFrame) -> DataFrame:
    """``technology, region_id`` where a street-bound technology may be placed: one of its streets
    suffices. Technologies without streets are not listed."""
    if "source_street_id" not in edges.columns:
        raise DataError("edges carry no source street id")
    bound = types.filter(F.size("streets") > 0).select(
        c("name").alias("technology"), F.explode("streets").alias("source_street_id"))
    present = edges.filter(c("region_id").isNotNull()).select(
        "region_id", c("source_street_id").cast("string").alias("source_street_id"))
    return present.join(bound, "source_street_id").select("technology", "region_id").distinct()


def place_central(locations: DataFrame, types: DataFrame, allowed: DataFrame,
                  profiles: DataFrame | None = None) -> DataFrame:
    """Central technologies (and CHPs) in every listed region: ``commodity, region_id`` joined to
    the types; ``allowed`` comes from :func:`street_constraint`. An instance has its type's profile names unless
    ``profiles`` (``technology, region_id, availability_profile, output_profile``) names others for it."""
    rows = locations.select("commodity", "region_id").distinct().join(
        of_kind(types, "central").withColumn("commodity", c("commodity_out")), "commodity")
    free = rows.filter(F.coalesce(F.size("streets"), F.lit(0)) <= 0)
    bound = rows.filter(F.size("streets") > 0).join(
        allowed.withColumnRenamed("technology", "name"), ["name", "region_id"], "left_semi")
    placed = free.unionByName(bound).select("kind", "name", "ord", "region_id", *_TYPE_FIELDS)
    if profiles is None:
        return placed
    names = ["availability_profile", "output_profile"]
    own = profiles.select(c("technology").alias("name"), "region_id", *[c(n).alias(f"_{n}") for n in names])
    return placed.join(own, ["name", "region_id"], "left").select(
        "kind", "name", "ord", "region_id", *[F.coalesce(f"_{n}", n).alias(n) if n in names else c(n) for n in _TYPE_FIELDS])


def distribute_capacity(placed: DataFrame, sources: DataFrame, shares: DataFrame, strict: bool = True) -> DataFrame:
    """Existing capacity of central assets in the source regions.

    ``sources``: ``commodity, region_id, total``; ``shares``: ``commodity, region_id`` (NULL =
    default)``, technology, share``. A region's own list wins over the default.
    """
    positive = sources.filter("total > 0")
    own = shares.filter(c("region_id").isNotNull())
    default = shares.filter(c("region_id").isNull()).drop("region_id")
    with_own = positive.join(own, ["commodity", "region_id"])
    rest = positive.join(own.select("commodity", "region_id").distinct(), ["commodity", "region_id"], "left_anti")
    with_default = rest.join(default, "commodity")
    given = with_own.unionByName(with_default).select(
        "commodity", "region_id", "technology", (c("total") * c("share")).alias("existing_capacity"))
    if strict:
        require_empty(rest.join(default.select("commodity").distinct(), "commodity", "left_anti")
                      .select("commodity", "region_id"), "no capacity shares configured")
        require_empty(given.join(placed.select(c("name").alias("technology"), "region_id"),
                                 ["technology", "region_id"], "left_anti"),
                      "technology with existing capacity is not placed in the region")
    rows = placed.join(given.select(c("technology").alias("name"), "region_id", "existing_capacity"),
                       ["name", "region_id"], "left")
    return rows.withColumn("existing_capacity", F.coalesce("existing_capacity", F.lit(0.0)))


def pipe_assets(connections: DataFrame, pipe_records: list[dict], pipe_types: DataFrame) -> DataFrame:
    """Pipes of every type in both directions of every connection."""
    directions = F.array(F.struct(c("a").alias("i"), c("b").alias("o")), F.struct(c("b").alias("i"), c("a").alias("o")))
    rows = connections.select((c("length") / 1000.0).alias("length_km"), F.explode(directions).alias("d"))
    rows = rows.select(c("d.i").alias("region_in"), c("d.o").alias("region_out"), "length_km")
    rows = times(rows, [(r["name"],) for r in pipe_records], "name string").join(pipe_types, "name")
    cost = F.when(c("length_km") * 1000 < c("distance_threshold_m"), 0.0).otherwise(c("capex_per_km") * c("length_km"))
    return rows.select(F.lit("pipe").alias("kind"), "name", "ord", "region_in", "region_out", *_TYPE_FIELDS,
                       "length_km", cost.alias("investment"), F.lit(0.0).alias("existing_capacity"))


def grid_cost(grids: DataFrame) -> DataFrame:
    return grids.withColumn("investment", c("length_km") * c("capex_per_km"))


# --- trajectories -----------------------------------------------------------------------------------------

def _at(year: Column, value: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), value.cast("double").alias("value"))


def capacity_trajectory(assets: DataFrame, start: int, strict: bool = True) -> DataFrame:
    """``capacity``: year-value rows of the existing capacity, NULL without any.

    Decentral capacity falls linearly to 0 at the end of its phase-out; all other kinds keep it
    until the year before retirement.
    """
    has = F.coalesce(c("existing_capacity"), F.lit(0.0)) != 0
    if strict:
        require_empty(assets.filter(has & c("lifetime_existing").isNull()).select("kind", "name"),
                      "existing capacity without a phase-out or retirement time")
    end = F.lit(start) + c("lifetime_existing")
    gone = _at(end, F.lit(0.0))
    first = _at(F.lit(start), c("existing_capacity"))
    path = F.when(c("kind") == "decentral", F.array(first, gone)).otherwise(
        F.array(first, _at(end - 1, c("existing_capacity")), gone))
    return assets.withColumn("capacity", F.when(has & c("lifetime_existing").isNotNull(), path))


def max_capacity_trajectory(assets: DataFrame, start: int) -> DataFrame:
    """``capacity_limit``: the existing capacity in the start year, then the type's maximum.

    Without a maximum the next year is unbounded (NULL); a single number holds from the next
    year; of a year map, year 0 means the next year unless year 1 is given itself.
    """
    first = F.array(_at(F.lit(start), F.coalesce(c("existing_capacity"), F.lit(0.0))))
    limits = c("max_capacity")
    scalar = F.size(limits) == 1
    single = F.element_at(limits, 1)
    has_one = F.exists(limits, lambda e: e["year"] == 1)
    mapped = F.transform(
        F.filter(limits, lambda e: ~((e["year"] == 0) & has_one)),
        lambda e: _at(F.lit(start) + F.when(e["year"] == 0, 1).otherwise(e["year"]), e["value"]))
    rest = (F.when(limits.isNull() | (c("kind").isin("decentral", "grid", "pipe")),
                   F.array(_at(F.lit(start + 1), F.lit(None))))
            .when(scalar & single["year"].isNull(), F.array(_at(F.lit(start + 1), single["value"])))
            .otherwise(mapped))
    return assets.withColumn("capacity_limit", F.concat(first, rest))


def long_trajectory(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.inline(column))


def earliest_value(series: Column) -> Column:
    """Value of the earliest year of year-value rows (the value itself for a single number)."""
    return F.element_at(F.array_sort(series), 1)["value"]


def existing_within_max(assets: DataFrame) -> DataFrame:
    """Assets whose existing capacity exceeds their maximum of the earliest year."""
    return assets.filter((c("existing_capacity") > 0) & (c("existing_capacity") > earliest_value(c("max_capacity"))))


def rebase_years(series: Column, start: int) -> Column:
    """Years since the start as calendar years; rows without a year stay so."""
    return F.transform(series, lambda e: F.struct(
        (e["year"] + start).alias("year"), e["value"].alias("value")))


def late_years(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a relative year above 100, which must be a calendar year by mistake."""
    late = reduce(lambda a, b: a | b, [F.coalesce(F.exists(n, lambda e: e["year"] > 100), F.lit(False)) for n in columns])
    return rows.filter(late)


# --- whole-system checks --------------------------------------------------------------------------------------

def validate_supply(imports: DataFrame, assets: DataFrame) -> DataFrame:
    """Imports whose first-year limits existing consumers exceed: ``commodity, severity, rule,
    limit, needed``.

    ``needed`` of a warning is the number of central assets with existing capacity under an
    energy limit.
    """
    users = assets.filter(c("kind").isin("decentral", "central", "chp"))
    central = c("kind").isin("central", "chp")
    sums = users.groupBy(c("commodity_in").alias("commodity")).agg(
        F.sum(c("existing_capacity") / c("efficiency")).alias("power"),
        F.sum(F.when(~central, c("existing_energy_output") / c("efficiency"))).alias("energy"),
        F.count_if(central & (c("existing_capacity") > 0)).cast("double").alias("central"))
    rows = imports.select("commodity", earliest_value(c("max_cap")).alias("cap"),
                          earliest_value(c("max_energy")).alias("lim")).join(sums, "commodity")
    finding = lambda severity, rule, limit, needed, when: F.when(when, F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), limit.alias("limit"), needed.alias("needed")))
    findings = F.array(
        finding("error", "capacity", c("cap"), c("power"), c("power") > c("cap")),
        finding("error", "energy", c("lim"), c("energy"), c("energy") > c("lim")),
        finding("warning", "central", c("lim"), c("central"), c("lim").isNotNull() & (c("central") > 0)))
    return rows.select("commodity", F.inline(F.filter(findings, lambda f: f.isNotNull())))


def verify_config(spark, *, demand_types: DataFrame, defaults: DataFrame, types: DataFrame, trade: DataFrame,
                  regions: DataFrame, keys: DataFrame, wanted_keys: DataFrame, minimum: DataFrame,
                  factors: DataFrame, locations: DataFrame, capacities: DataFrame, forced: DataFrame,
                  with_shares: DataFrame) -> DataFrame:
    """Broken references and sums of a system configuration: ``rule, key, message``.

    Tables: ``minimum(technology)``, ``factors(grid, factor)``, ``locations(commodity, region_id)``,
    ``capacities(commodity, region_id or NULL, technology, share)``, ``forced(region_id,
    technology, share)``, ``keys(key)`` registered, ``wanted_keys(demand, key)`` needed,
    ``with_shares(demand)`` demands that have a share source.
    """
    decentral = of_kind(types, "decentral").select(c("name").alias("technology"), "commodity_out")
    central = of_kind(types, "central").select(c("name").alias("technology"), "commodity_out")
    grids = of_kind(types, "grid").select(c("name").alias("grid"))
    known_regions = regions.select("region_id").distinct()
    made = decentral.select(c("commodity_out").alias("commodity")).distinct()
    bought = trade.filter("kind = 'Import'").select("commodity").distinct()

    def broken(rule: str, rows: DataFrame, key: Column, message: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(message).alias("message"))

    out_of = lambda rows, on, other: rows.join(other, on, "left_anti")
    own = lambda rows, types_: rows.join(types_, "technology")
    sums = capacities.groupBy("commodity", "region_id").agg(F.sum("share").alias("total"))
    forced_known = own(forced, decentral).join(
        demand_types.select(c("commodity").alias("commodity_out")).distinct(), "commodity_out", "left_semi")
    findings = [
        broken("demand supply", out_of(out_of(demand_types, "commodity", made), "commodity", bought), c("demand"),
               "commodity is neither made by a decentral technology nor imported"),
        broken("default needed", out_of(out_of(demand_types.join(made, "commodity", "left_semi"), "demand", with_shares),
                                        "demand", defaults.select("demand").distinct()), c("demand"),
               "a default technology is required without a share source"),
        broken("default type", out_of(defaults, "technology", decentral), c("technology"),
               "default technology is not a decentral technology"),
        broken("default commodity", own(defaults, decentral).join(demand_types.select("demand", "commodity"), "demand")
               .filter(c("commodity_out") != c("commodity")), c("technology"),
               "default technology makes another commodity"),
        broken("dataset", out_of(wanted_keys, "key", keys), c("key"), "no dataset is registered for the key"),
        broken("minimum type", out_of(minimum, "technology", decentral), c("technology"),
               "minimum share of an unknown decentral technology"),
        broken("factor grid", out_of(factors, "grid", grids), c("grid"), "capacity factor of an unknown grid"),
        broken("factor value", factors.filter(~(c("factor") > 1)), c("grid"), "capacity factor must exceed 1"),
        broken("location commodity", out_of(locations, "commodity", central.select(
            c("commodity_out").alias("commodity"))), c("commodity"), "no central technology makes the commodity"),
        broken("location region", out_of(locations, "region_id", known_regions), c("region_id"),
               "location is not a region"),
        broken("capacity region", out_of(capacities.filter(c("region_id").isNotNull()),
                                         ["commodity", "region_id"], locations), c("region_id"),
               "capacity region is not a location"),
        broken("capacity sum", sums.filter(~is_close(c("total"), 1.0)), c("commodity"), "capacity shares must sum to 1"),
        broken("capacity type", out_of(capacities, "technology", central), c("technology"),
               "capacity of an unknown central technology"),
        broken("capacity commodity", own(capacities, central).filter(c("commodity_out") != c("commodity")),
               c("technology"), "central technology makes another commodity"),
        broken("forced region", out_of(forced, "region_id", known_regions), c("region_id"), "forced share of an unknown region"),
        broken("forced type", out_of(forced, "technology", decentral), c("technology"),
               "forced share of an unknown decentral technology"),
        broken("forced commodity", own(forced, decentral).join(
            demand_types.select(c("commodity").alias("commodity_out")).distinct(), "commodity_out", "left_anti"),
            c("technology"), "no demand uses the forced technology's commodity"),
        broken("forced sum", forced_known.groupBy("region_id", "commodity_out").agg(F.sum("share").alias("total"))
               .filter(c("total") > 1.0 + 1e-9), c("region_id"), "forced shares exceed 1"),
        broken("share range", reduce(DataFrame.unionByName, [
            minimum.select("technology", "share"), forced.select("technology", "share"),
            capacities.select("technology", "share")]).filter(~c("share").between(0, 1)), c("technology"),
            "share is outside 0..1"),
    ]
    return reduce(DataFrame.unionByName, findings).distinct()


def asset_table(*tables: DataFrame) -> DataFrame:
    """All assets in one table, missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def region_summary(lengths: DataFrame, demands: DataFrame, names: list[str]) -> DataFrame:
    """Per region the grid length (km) and one column per demand name."""
    wide = demands.groupBy("region_id").pivot("demand", names).agg(F.sum("value"))
    return lengths.select("region_id", (c("length") / 1000.0).alias("length_km")).join(wide, "region_id", "left")


def pipe_summary(pipes: DataFrame) -> DataFrame:
    """Each pair of regions once per pipe type: ``name, lo, hi, length_km``."""
    return (pipes.groupBy("name", F.least("region_in", "region_out").alias("lo"),
                          F.greatest("region_in", "region_out").alias("hi"))
            .agg(F.min_by("length_km", F.struct("region_in", "region_out")).alias("length_km"))
            .orderBy("name", "lo", "hi"))
