"""The compositions: prepared streets, network, energy system, model tables."""
from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.config import config_frame
from regionflow.functions.projection import transform_parts
from regionflow.operators import catalog, energy, graph, network, streets, techmap
from regionflow.operators.registry import Located, Regions, Registry, route
from regionflow.scale import cut_lineage

c = F.col
log = logging.getLogger(__name__)


def prepare_streets(rows: DataFrame, id_column: str, source_epsg: int | None, project_epsg: int, *,
                    divide: bool = False, tol: float = 1e-6, gap: float | None = None,
                    drop_isolated: list[str] | None = None) -> DataFrame:
    """Validated streets in the project's coordinates with lineage, optionally cleaned: split at
    junctions, gaps closed, isolated streets without data dropped."""
    streets.validate_streets(rows, id_column, source_epsg)
    rows = rows.withColumn("parts", transform_parts(c("parts"), source_epsg, project_epsg))
    rows = streets.add_lineage(rows, id_column)
    if divide:
        rows = cut_lineage(streets.divide_at_junctions(rows, id_column, [streets.SOURCE_SHARE], tol))
    if gap is not None:
        rows = cut_lineage(streets.close_gaps(rows, gap, id_column))
    if drop_isolated:
        rows = streets.drop_isolated_nulls(rows, drop_isolated, id_column)
    return rows


@dataclass
class Topology:
    streets: DataFrame
    edges: DataFrame

    @property
    def region_edges(self) -> DataFrame:
        return network.region_edges(self.edges)

    @property
    def regions(self) -> Regions:
        return Regions(self.edges)


def build_topology(registry: Registry, area: DataFrame, id_column: str, *,
                   polygon_id: str | None = None, grouping: dict | None = None,
                   check_connected: bool = True) -> Topology:
    """Streets covering ``area`` (polygons, ``rings``), their regions and their edge network.

    Regions come from the polygons of ``area`` (``polygon_id``) or from a ``grouping``
    ``{region: {column: [values]}}``.
    """
    rows = registry.streets(area)
    if "region_id" in rows.columns:
        log.warning("column 'region_id' of the streets is overwritten")
    if polygon_id is not None:
        placed = network.assign_by_polygon(rows, area, id_column, polygon_id)
    elif grouping is not None:
        mapping = network.mapping_rows(registry.spark, grouping)
        named = sorted({name for selectors in grouping.values() for name in selectors})
        placed = network.assign_by_mapping(rows, mapping, named)
    else:
        raise DataError("regions need polygons or a grouping")
    placed = cut_lineage(placed)
    edges = cut_lineage(network.build_edges(placed, id_column, [streets.SOURCE_SHARE]))
    if check_connected:
        network.require_connected(edges)
    return Topology(placed, edges)


@dataclass
class SystemConfig:
    """Settings of the system build; see :func:`regionflow.operators.energy.verify_config`."""
    minimum_share: dict[str, float] = field(default_factory=dict)
    connected_distance: float | None = None
    locations: dict[str, list[int]] = field(default_factory=dict)
    capacities: dict[str, dict[int | None, list[tuple[str, float]]]] = field(default_factory=dict)
    grid_factor: dict[str, float] = field(default_factory=dict)
    forced: dict[int, dict[str, float]] = field(default_factory=dict)


@dataclass
class EnergySystem:
    name: str
    unit: str
    demands: DataFrame
    profiles: DataFrame
    assets: DataFrame
    pipes: DataFrame
    trade: DataFrame
    connections: DataFrame
    paths: DataFrame
    type_records: list[dict]
    findings: DataFrame


def config_tables(spark, config: SystemConfig) -> dict[str, DataFrame]:
    frame = lambda rows, schema: config_frame(spark, rows, schema)
    return {
        "minimum": frame([(t, float(s)) for t, s in config.minimum_share.items()], "technology string, share double"),
        "factors": frame([(g, float(v)) for g, v in config.grid_factor.items()], "grid string, factor double"),
        "locations": frame([(k, r) for k, rs in config.locations.items() for r in rs], "commodity string, region_id long"),
        "capacities": frame([(k, r, t, float(s)) for k, by in config.capacities.items() for r, ts in by.items()
                             for t, s in ts], "commodity string, region_id long, technology string, share double"),
        "forced": frame([(r, t, float(s)) for r, ts in config.forced.items() for t, s in ts.items()],
                        "region_id long, technology string, share double"),
    }


def verify_system(registry: Registry, edges: DataFrame, demand_types: list[catalog.DemandType],
                  type_records: list[dict], trade: DataFrame, config: SystemConfig) -> None:
    spark = registry.spark
    frame = lambda rows, schema: config_frame(spark, rows, schema)
    wanted = [(d.name, k) for d in demand_types for k in (d.value_key, d.profile_key, d.shares_key) if k]
    broken = energy.verify_config(
        spark, demand_types=catalog.demand_type_frame(spark, demand_types),
        defaults=catalog.default_mix(spark, demand_types), types=catalog.type_frame(spark, type_records),
        trade=trade, regions=network.region_edges(edges).select(c("region_id").cast("long").alias("region_id")),
        keys=frame([(k,) for k in sorted({k for d in registry.datasets for k in d.keys})], "key string"),
        wanted_keys=frame(wanted, "demand string, key string"),
        with_shares=frame([(d.name,) for d in demand_types if d.shares_key], "demand string"),
        **config_tables(spark, config))
    energy.require_empty(broken, "configuration")


def build_system(name: str, registry: Registry, topology: Topology, demand_types: list[catalog.DemandType],
                 type_records: list[dict], trade_records: list[dict], config: SystemConfig,
                 unit: str = "kW") -> EnergySystem:
    """Demands, decentral assets and grids per region; connections, groups and trees between them;
    capacities of pipes, grids and central technologies."""
    spark = registry.spark
    types = catalog.check_catalog(catalog.type_frame(spark, type_records))
    trade = catalog.trade_frame(spark, trade_records)
    verify_system(registry, topology.edges, demand_types, type_records, trade, config)
    tables = config_tables(spark, config)
    demand_frame = catalog.demand_type_frame(spark, demand_types)
    energy_unit = {"kW": "MWh", "MW": "GWh", "GW": "TWh"}[unit]
    regions = registry.located(topology.regions)
    inside = topology.region_edges

    # per region
    values = reduce(DataFrame.unionByName, [
        registry.query_all(regions, d.value_key, d.value_params, energy_unit)
        .select("region_id", F.lit(d.name).alias("demand"), c("value").cast("double").alias("value"))
        for d in demand_types])
    profiles, series = _profiles(registry, regions, demand_types)
    demands = cut_lineage(energy.build_demands(values, series, demand_frame))
    energy.check_demands(demands, profiles)
    profiles = cut_lineage(profiles.join(demands.select("series").distinct(), "series", "left_semi"))
    demands = cut_lineage(energy.peak(demands, profiles))

    serving = energy.serving_types(types, demand_frame)
    share_rows = [registry.query_all(regions, d.shares_key, d.shares_params)
                  .select("region_id", F.lit(d.name).alias("demand"), "technology", c("share").cast("double").alias("share"))
                  for d in demand_types if d.shares_key]
    empty = spark.createDataFrame([], values.select("region_id", "demand").schema.add("technology", "string").add("share", "double"))
    shares = reduce(DataFrame.unionByName, share_rows, empty)
    served = demands.join(serving.select("demand").distinct(), "demand", "left_semi")
    shares = shares.join(served.select("region_id", "demand"), ["region_id", "demand"], "left_semi")
    defaults = catalog.default_mix(spark, demand_types)
    energy.require_empty(energy.missing_defaults(shares, served, defaults), "no default technology for demand")
    mix = cut_lineage(energy.technology_mix(
        shares, served, defaults, serving, config.minimum_share,
        tables["forced"].select("region_id", "technology", c("share").alias("forced"))))
    decentral = cut_lineage(energy.decentral_assets(demands, mix, types, unit))
    grid_records = [r for r in type_records if r["kind"] == "grid"]
    pipe_records = [r for r in type_records if r["kind"] == "pipe"]
    lengths = network.total_edge_length(inside)
    grids = cut_lineage(energy.grid_assets(lengths, decentral, grid_records, energy.of_kind(types, "grid")))

    # between regions
    connections, paths = network.region_connections(topology.edges)
    connections = cut_lineage(connections)
    pipes = energy.pipe_assets(connections, pipe_records, energy.of_kind(types, "pipe")) if pipe_records else None
    locations = tables["locations"]
    sources, pipe_capacity, grid_capacity = [], [], []
    fits = {r["pipe"]: r["grid"] for r in energy.pipe_to_grid(types).collect()}  # one row per configured pipe type
    if len(set(fits.values())) < len(fits):
        raise DataError("several pipe types feed one grid type")
    by_name = {r["name"]: r for r in type_records}
    for pipe, grid in fits.items():
        commodity = by_name[pipe]["commodity_out"]
        own = grids.filter(c("name") == grid).select("region_id", c("existing_capacity").alias("capacity"))
        groups = cut_lineage(network.region_groups(own, connections, config.connected_distance))
        chosen = cut_lineage(network.pick_source(groups, own, locations.filter(c("commodity") == commodity)))
        locations = locations.unionByName(chosen.filter("added").select(
            F.lit(commodity).alias("commodity"), c("region_id").cast("long").alias("region_id")))
        near = connections if config.connected_distance is None else connections.filter(
            c("length") <= config.connected_distance)
        active = groups.select("region_id")
        inner = (near.join(active.withColumnRenamed("region_id", "a"), "a", "left_semi")
                 .join(active.withColumnRenamed("region_id", "b"), "b", "left_semi"))
        rooted = cut_lineage(graph.root_tree(graph.spanning_tree(inner), chosen.select(c("region_id").alias("node"))))
        flow = cut_lineage(graph.propagate_capacity(
            rooted, own.withColumnRenamed("region_id", "node"), by_name[grid]["efficiency"],
            by_name[pipe]["efficiency"], config.grid_factor.get(grid, 1.0)))
        sources.append(flow.filter(c("parent").isNull()).select(
            F.lit(commodity).alias("commodity"), c("node").alias("region_id"), c("inflow").alias("total")))
        pipe_capacity.append(flow.filter(c("parent").isNotNull()).select(
            F.lit(pipe).alias("name"), c("parent").alias("region_in"), c("node").alias("region_out"),
            c("inflow").alias("_capacity")))
        grid_capacity.append(flow.select(F.lit(grid).alias("name"), c("node").alias("region_id"),
                                         c("grid").alias("_capacity")))

    def with_capacity(rows: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
        if not parts:
            return rows
        found = reduce(DataFrame.unionByName, parts)
        return (rows.join(found, keys, "left")
                .withColumn("existing_capacity", F.coalesce("_capacity", "existing_capacity")).drop("_capacity"))

    grids = with_capacity(grids, grid_capacity, ["name", "region_id"])
    allowed = energy.street_constraint(energy.of_kind(types, "central"), topology.edges)
    placed = energy.place_central(locations, types, allowed)
    if sources:
        central = energy.distribute_capacity(placed, reduce(DataFrame.unionByName, sources), tables["capacities"])
    else:
        central = placed.withColumn("existing_capacity", F.lit(0.0))
    energy.require_empty(energy.existing_within_max(central).select("name", "region_id"),
                         "existing capacity exceeds the maximum")
    assets = cut_lineage(energy.asset_table(decentral, grids, central))
    if pipes is not None:
        pipes = cut_lineage(with_capacity(pipes, pipe_capacity, ["name", "region_in", "region_out"]))
    findings = energy.validate_supply(trade.filter("kind = 'Import'"), assets)
    energy.require_empty(findings.filter("severity = 'error'"), "the system cannot be supplied")
    return EnergySystem(name, unit, demands, profiles, assets, pipes, trade, connections, paths, type_records, findings)


def _profiles(registry: Registry, regions: Regions | Located, demand_types: list[catalog.DemandType]
              ) -> tuple[DataFrame, DataFrame]:
    """All profiles as ``series, hour, value`` and the series of every region and demand.

    A dataset without a query function has one profile, its payload, stored once for all regions and demands that
    are routed to it. One with a query function is asked with the demand's parameters for just those regions; if its
    answer has a ``region_id``, every region has a series of its own.
    """
    scopes, catalog_ = registry.scopes(), registry.catalog()
    located = registry.located(regions)
    regions = located.regions
    series, profiles = [], {}
    columns = ["series", "hour", c("value").cast("double").alias("value")]
    for demand in demand_types:
        routed = cut_lineage(route(located.ids, located.coverage, catalog_, scopes, demand.profile_key))
        # one row per registered dataset at most
        for number in sorted(r.dataset_id for r in routed.select("dataset_id").distinct().collect()):
            dataset, asked = registry.datasets[number], routed.filter(c("dataset_id") == number)
            name, label = f"dataset {number}", None
            if dataset.query_function is None:
                if dataset.payload is None:
                    raise DataError(f"the profile of demand {demand.name} has neither rows nor a query function")
                answer = dataset.payload
            else:
                name = f"{name} for {demand.name}"
                answer = dataset.answer(regions.only(asked), dict(demand.profile_params))
                if "region_id" in answer.columns:
                    label = F.concat(F.lit(f"{name} in "), c("region_id").cast("string"))
            label = F.lit(name) if label is None else label
            profiles[name] = answer.withColumn("series", label).select(*columns)
            series.append(asked.select("region_id", F.lit(demand.name).alias("demand"), label.alias("series")))
    return reduce(DataFrame.unionByName, profiles.values()), reduce(DataFrame.unionByName, series)


def system_tables(system: EnergySystem, scenario: catalog.Scenario) -> dict[str, DataFrame]:
    """The six model-input tables of a system and scenario."""
    scoped = techmap.region_scoped(system.type_records)
    hashes = cut_lineage(techmap.profile_hashes(energy.normalise_profile(system.profiles)))
    names = techmap.series_names(hashes, techmap.profile_names(system.demands, hashes))
    names = cut_lineage(names)
    pick = lambda kind: system.assets.filter(c("kind") == kind)
    blocks = [techmap.trade_rows(system.trade, scenario)]
    if system.pipes is not None:
        blocks.append(techmap.pipe_rows(system.pipes, scoped, scenario))
    blocks += [
        techmap.demand_rows(system.demands, names, scoped, scenario),
        techmap.decentral_rows(pick("decentral"), names, scoped, scenario),
        techmap.grid_rows(pick("grid"), scoped, scenario),
        techmap.central_rows(pick("central"), scoped, scenario),
        techmap.chp_rows(pick("chp"), scoped, scenario)]
    rows = cut_lineage(techmap.subprocess_table(*blocks))
    return techmap.create_techmap(system.demands.sparkSession, scenario, system.unit, rows)
