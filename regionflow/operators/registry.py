"""Datasets, their coverage of regions, routing, and the answers per region.

A dataset is configuration (keys, priority, unit, scope) plus a payload DataFrame. Everything is
answered for all regions at once.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.errors import DataError, NoDatasetError
from regionflow.functions import geometry as geo
from regionflow.functions.projection import transform_parts
from regionflow.functions.units import conversion_factor, convert_unit
from regionflow.operators.coverage import covered_points, identified, polygons_meeting, ring_edges
from regionflow.operators.network import edge_nodes, region_edges
from regionflow.operators.spatial import box_join, with_box
from regionflow.operators.streets import SOURCE_ID, SOURCE_SHARE, convex_hull, dissolved_rings
from regionflow.scale import cut_lineage, spread

c = F.col

# The built-in data keys.
RESIDENTIAL_HEAT_DEMAND_PROFILE = "residential_heat_demand_profile"
RESIDENTIAL_ELECTRICITY_DEMAND_PROFILE = "residential_electricity_demand_profile"
RESIDENTIAL_ELECTRICITY_DEMAND = "residential_electricity_demand"
RESIDENTIAL_HEAT_DEMAND = "residential_heat_demand"
HEATING_SHARES = "heating_shares"
STREET_NETWORK = "street_network"
LINEAR_HEAT_DENSITY = "linear_heat_density"
EXISTING_HEAT_GRID = "existing_heat_grid"

DEFAULT_PRIORITY = 10
DATABASE_PRIORITY = 2


# --- catalogue ---------------------------------------------------------------------------------

def datasets_for(catalog: DataFrame, key: str | None = None) -> DataFrame:
    """Datasets answering ``key`` (all, once each, without one), best first.

    ``catalog``: ``dataset_id, keys, priority, reg_order, ...``.
    """
    rows = catalog if key is None else catalog.filter(F.array_contains("keys", key))
    return rows.orderBy(F.desc("priority"), "reg_order")


# --- coverage and routing -----------------------------------------------------------------------

def scope_covers(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """Points (``x, y`` + any columns) with every scoped ``dataset_id`` covering them, border included.

    ``scopes``: one dissolved polygon per dataset, ``dataset_id, rings``. Datasets without a
    scope are valid everywhere and have no row here. The
    scopes' edges are rows of a grid (see :mod:`regionflow.operators.coverage`); no scope is held as one value.
    """
    numbered = identified(points)
    edges = cut_lineage(ring_edges(scopes, "dataset_id"))
    return covered_points(numbered, edges, "dataset_id").join(numbered, "_pid").select(*points.columns, "dataset_id")


def region_coverage(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """``region_id, dataset_id`` for scoped datasets that cover every node of the region."""
    sizes = nodes.groupBy("region_id").agg(F.count(F.lit(1)).alias("_nodes"))
    covered = scope_covers(nodes, scopes).groupBy("region_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("_covered"))
    return covered.join(sizes, "region_id").filter(c("_covered") == c("_nodes")).select("region_id", "dataset_id")


def _best_global(candidates: DataFrame, scopes: DataFrame):
    """The single best dataset without scope, as a Row or None."""
    everywhere = candidates.join(scopes.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return everywhere.orderBy(F.desc("priority"), "reg_order").select(
        "dataset_id", "priority", "reg_order").first()


def route(regions: DataFrame, coverage: DataFrame, catalog: DataFrame, scopes: DataFrame, key: str,
          strict: bool = True) -> DataFrame:
    """Best covering dataset per region for ``key``: ``region_id, dataset_id``.

    Only the best unscoped dataset can ever win over the scoped ones, so it is a constant here
    rather than a product of regions and datasets.
    """
    candidates = catalog.filter(F.array_contains("keys", key)).select("dataset_id", "priority", "reg_order")
    rank = F.struct(c("priority"), (-c("reg_order")).alias("r"), c("dataset_id"))
    scoped = coverage.join(candidates, "dataset_id").groupBy("region_id").agg(F.max(rank).alias("_s"))
    fallback = _best_global(candidates, scopes)
    rows = regions.select("region_id").distinct().join(scoped, "region_id", "left")
    if fallback is not None:
        types = {f.name: f.dataType for f in candidates.schema}
        constant = F.struct(F.lit(fallback["priority"]).cast(types["priority"]).alias("priority"),
                            F.lit(-fallback["reg_order"]).cast(types["reg_order"]).alias("r"),
                            F.lit(fallback["dataset_id"]).cast(types["dataset_id"]).alias("dataset_id"))
        rows = rows.withColumn("_s", F.greatest("_s", constant))
    routed = rows.select("region_id", c("_s.dataset_id").alias("dataset_id"))
    if strict:
        lost = routed.filter(c("dataset_id").isNull()).limit(20).collect()
        if lost:
            raise NoDatasetError(f"no dataset for '{key}' covers region(s) {[r.region_id for r in lost]}")
    return routed


def covering_area(area: DataFrame, scopes: DataFrame) -> DataFrame:
    """``dataset_id`` of the scopes that cover a whole polygon layer (``area_id, rings``).

    Every border piece must be covered and no scope vertex may lie inside the area (a hole).
    """
    # a polygon costs far more to test than to move
    scopes = spread(scopes, "dataset_id")
    sides = (area.select("area_id", F.posexplode(geo.flat_segments(c("rings"))).alias("_n", "_s"))
             .select("area_id", "_n", c("_s.a.x").alias("ax"), c("_s.a.y").alias("ay"),
                     c("_s.b.x").alias("bx"), c("_s.b.y").alias("by")))
    total = sides.agg(F.count(F.lit(1)).alias("_sides"))
    left = with_box(sides, "_l", F.least("ax", "bx"), F.least("ay", "by"),
                    F.greatest("ax", "bx"), F.greatest("ay", "by"))
    right = with_box(scopes.select("dataset_id", c("rings").alias("_rings"), geo.bounds(c("rings")).alias("_b")),
                     "_r", c("_b.x0"), c("_b.y0"), c("_b.x1"), c("_b.y1")).drop("_b")
    covered = (box_join(left, right, geo.covers_segment(c("_rings"), c("ax"), c("ay"), c("bx"), c("by")))
               .groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_covered")))
    corners = scopes.select("dataset_id", F.explode(F.flatten("rings")).alias("_p")).select(
        "dataset_id", c("_p.x").alias("x"), c("_p.y").alias("y")).distinct()
    inner = with_box(corners, "_l", c("x"), c("y"), c("x"), c("y"))
    areas = with_box(area.select(c("rings").alias("_rings"), geo.bounds(c("rings")).alias("_b")),
                     "_r", c("_b.x0"), c("_b.y0"), c("_b.x1"), c("_b.y1")).drop("_b")
    holes = box_join(inner, areas, geo.strictly_inside(c("_rings"), c("x"), c("y"))).select("dataset_id").distinct()
    full = total.first()["_sides"]
    return covered.filter(c("_covered") == full).select("dataset_id").join(holes, "dataset_id", "left_anti")


def route_streets(area: DataFrame, catalog: DataFrame, scopes: DataFrame):
    """Id of the best street dataset that covers the whole area."""
    streets = catalog.filter(F.array_contains("keys", STREET_NETWORK))
    scoped = streets.join(covering_area(area, scopes), "dataset_id", "left_semi")
    everywhere = streets.join(scopes.select("dataset_id").distinct(), "dataset_id", "left_anti")
    best = scoped.unionByName(everywhere).orderBy(F.desc("priority"), "reg_order").select("dataset_id").first()
    if best is None:
        raise NoDatasetError("no street dataset covers the area")
    return best["dataset_id"]


# --- answers --------------------------------------------------------------------------------------

def constant_answer(regions: DataFrame, value) -> DataFrame:
    return regions.select("region_id").distinct().withColumn("value", F.lit(value))


def street_values(streets: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``street_id, value``: the columns' sum per street, NULL parts skipped, all-NULL streets left out."""
    missing = [name for name in columns if name not in streets.columns]
    if missing:
        raise DataError(f"street value columns {missing} do not exist")
    repeated = streets.groupBy(id_column).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise DataError(f"street ids in '{id_column}' are not unique: {[r[0] for r in repeated]}")
    some = reduce(lambda a, b: a | b, [c(n).isNotNull() for n in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in columns])
    return streets.filter(some).select(c(id_column).alias("street_id"), total.alias("value"))


def street_value_by_region(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``region_id, value``: sum over the region's edges of street value times share; no value = 0.

    Shares are first summed per (region, street), so the join carries one row per street.
    """
    for name in (SOURCE_ID, SOURCE_SHARE):
        if name not in edges.columns:
            raise DataError(f"edges carry no '{name}'; build the network first")
    return _priced(region_edges(edges), values, ["region_id"]).select("region_id", "value")


def _priced(edges: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """``by, value`` of edges with a region, by what ``values`` says of a street (and of the dataset, if in ``by``)."""
    shares = edges.groupBy(*by, c(SOURCE_ID).alias("street_id")).agg(F.sum(SOURCE_SHARE).alias("_share"))
    priced = shares.join(values, ["street_id", *[n for n in by if n in values.columns]], "left")
    return priced.groupBy(*by).agg(F.coalesce(F.sum(c("value") * c("_share")), F.lit(0.0)).alias("value"))


def street_values_routed(edges: DataFrame, routed: DataFrame, values: DataFrame) -> DataFrame:
    """``region_id, dataset_id, value``: each region's edges priced by its own dataset, all datasets in one scan.

    ``routed``: ``region_id, dataset_id``; ``values``: ``dataset_id, street_id, value``.
    """
    asked = region_edges(edges).join(routed.select("region_id", "dataset_id"), "region_id")
    return _priced(asked, values, ["region_id", "dataset_id"])


def fetch_in_region(features: DataFrame, hulls: DataFrame) -> DataFrame:
    """Features whose polygon meets the region's area, with ``region_id``; a feature may serve several.

    Payload without a ``rings`` column is not spatial: regions do not narrow it, see :class:`TableDataset`.
    """
    numbered = identified(features, "_fid")
    pairs = polygons_meeting(numbered, hulls, "_fid", "region_id")
    return numbered.join(pairs, "_fid").drop("_fid")


def category_shares(cells: DataFrame, categories: list[str], mapping: dict[str, str | None] | None = None
                    ) -> DataFrame:
    """``region_id, technology, share`` from count columns given as text.

    Bad text counts 0. Shares are per region over all categories (0 without any count); with a
    mapping, categories without a technology are dropped and the rest is renormalised.
    """
    counts = [F.sum(F.coalesce(c(n).cast("string").try_cast("double"), F.lit(0.0))).alias(n) for n in categories]
    wide = cells.groupBy("region_id").agg(*counts)
    total = reduce(lambda a, b: a + b, [c(n) for n in categories])
    targets: dict[str, list[str]] = {}
    for name in categories:
        technology = name if mapping is None else mapping.get(name)
        if technology is not None:
            targets.setdefault(technology, []).append(name)
    summed = {t: reduce(lambda a, b: a + b, [c(n) for n in names]) for t, names in targets.items()}
    kept = reduce(lambda a, b: a + b, summed.values()) if mapping is not None else total
    share = lambda amount: F.when(kept > 0, amount / kept).otherwise(F.lit(0.0))
    return wide.select("region_id", F.inline(F.array(*[
        F.struct(F.lit(t).alias("technology"), share(amount).alias("share")) for t, amount in summed.items()])))


def reproject(rows: DataFrame, column: str, source: int, target: int) -> DataFrame:
    return rows.withColumn(column, transform_parts(c(column), source, target))


# --- datasets ---------------------------------------------------------------------------------------

@dataclass
class Regions:
    """The regions a question is asked for: their edges, and what can be derived from them."""
    edges: DataFrame
    _hulls: DataFrame | None = field(default=None, repr=False)

    @property
    def ids(self) -> DataFrame:
        return region_edges(self.edges).select("region_id").distinct()

    @property
    def nodes(self) -> DataFrame:
        return edge_nodes(region_edges(self.edges), "region_id")

    @property
    def hulls(self) -> DataFrame:
        if self._hulls is None:
            self._hulls = convex_hull(self.nodes, "region_id")
        return self._hulls

    def only(self, ids: DataFrame) -> "Regions":
        return Regions(self.edges.join(ids.select("region_id"), "region_id", "left_semi"))


@dataclass
class Located:
    """Regions with stored edges and ``region_id, dataset_id`` of the scoped datasets covering them, of ``datasets`` in all."""
    regions: Regions
    ids: DataFrame
    coverage: DataFrame
    datasets: int


QueryFunction = Callable[[DataFrame | None, Regions, dict], DataFrame]


@dataclass
class Dataset:
    """Keys, priority, unit and scope polygons of a payload; answers through ``query_function``.

    ``query_function(payload, regions, params)`` returns rows keyed by ``region_id`` (numeric
    answers in a ``value`` column) for all the given regions.
    """
    keys: list[str]
    payload: DataFrame | None = None
    query_function: QueryFunction | None = None
    unit: str | None = None
    priority: int = DEFAULT_PRIORITY
    scope: DataFrame | None = None  # rings

    def __post_init__(self):
        if not isinstance(self.keys, list):
            raise TypeError("keys must be a list of strings")
        if not self.keys:
            raise DataError("a dataset needs at least one key")

    def answer(self, regions: Regions, params: dict) -> DataFrame:
        if self.query_function is None:
            raise NotImplementedError("the dataset has neither a query function nor a default answer")
        return self.query_function(self.payload, regions, params)


@dataclass
class ConstantDataset(Dataset):
    value: object = None

    def answer(self, regions: Regions, params: dict) -> DataFrame:
        return constant_answer(regions.ids, self.value)


@dataclass
class StreetValueDataset(Dataset):
    """Values per raw street; payload ``street_id, value``."""

    @classmethod
    def from_columns(cls, streets: DataFrame, id_column: str, columns: str | list[str], **options):
        names = [columns] if isinstance(columns, str) else list(columns)
        return cls(payload=street_values(streets, id_column, names), **options)

    def answer(self, regions: Regions, params: dict) -> DataFrame:
        return street_value_by_region(regions.edges, self.payload)


@dataclass
class TableDataset(Dataset):
    """A read table: with a query function that answers; otherwise features meeting the region, or,
    for a table without geometry, the whole table for every region."""

    def answer(self, regions: Regions, params: dict) -> DataFrame:
        if self.query_function is not None:
            return self.query_function(self.payload, regions, params)
        if "rings" in self.payload.columns:
            return fetch_in_region(self.payload, regions.hulls)
        raise DataError("a table without geometry is the same for every region: use whole()")

    def whole(self) -> DataFrame:
        return self.payload


class Registry:
    """Registered datasets in the project's coordinate system."""

    def __init__(self, spark: SparkSession, epsg: int):
        self.spark, self.epsg = spark, epsg
        self.datasets: list[Dataset] = []
        self._scopes: DataFrame | None = None

    def register(self, dataset: Dataset, scope_epsg: int | None = None, _streets: bool = False) -> int:
        if not isinstance(dataset, Dataset):
            raise TypeError("only datasets can be registered")
        if STREET_NETWORK in dataset.keys and not _streets:
            raise DataError("streets are registered with register_streets()")
        if dataset.scope is not None:
            dataset.scope = reproject(dataset.scope, "rings", scope_epsg or self.epsg, self.epsg)
        self.datasets.append(dataset)
        self._scopes = None
        return len(self.datasets) - 1

    def register_streets(self, prepared: DataFrame, scope: DataFrame | None = None,
                         priority: int = DEFAULT_PRIORITY) -> int:
        """``prepared`` streets come from :func:`regionflow.plans.build.prepare_streets`."""
        missing = {SOURCE_ID, SOURCE_SHARE} - set(prepared.columns)
        if missing:
            raise DataError(f"streets are not prepared: {sorted(missing)} missing")
        return self.register(Dataset(keys=[STREET_NETWORK], payload=prepared, priority=priority, scope=scope),
                             _streets=True)

    def catalog(self) -> DataFrame:
        rows = [(i, d.keys, d.priority, i, d.unit) for i, d in enumerate(self.datasets)]
        return self.spark.createDataFrame(
            rows, "dataset_id int, keys array<string>, priority int, reg_order int, unit string")

    def scopes(self) -> DataFrame:
        """Dissolved scope per scoped dataset; dissolved once for all questions until another dataset is registered."""
        if self._scopes is None:
            self._scopes = self._dissolved()
        return self._scopes

    def _dissolved(self) -> DataFrame:
        layers = [d.scope.select(F.lit(i).alias("dataset_id"), "rings", F.xxhash64("rings").alias("_piece"))
                  for i, d in enumerate(self.datasets) if d.scope is not None]
        if not layers:
            return self.spark.createDataFrame([], f"dataset_id int, rings {geo.PARTS}")
        return cut_lineage(dissolved_rings(reduce(DataFrame.unionByName, layers), "dataset_id", "_piece"))

    def streets(self, area: DataFrame) -> DataFrame:
        """All streets (also outside the area) of the best street dataset covering ``area``."""
        area = area.select(F.xxhash64("rings").alias("area_id"), "rings")
        return self.datasets[route_streets(area, self.catalog(), self.scopes())].payload

    def located(self, regions: "Regions | Located") -> "Located":
        """``regions`` stored with the scoped datasets covering each: what every key's routing and answers read.

        Made anew only if a dataset was registered since.
        """
        if isinstance(regions, Located):
            if regions.datasets == len(self.datasets):
                return regions
            regions = regions.regions
        scopes = self.scopes()
        stored = Regions(cut_lineage(region_edges(regions.edges)))
        nodes = cut_lineage(stored.nodes)
        return Located(stored, cut_lineage(nodes.select("region_id").distinct()),
                       cut_lineage(region_coverage(nodes, scopes)), len(self.datasets))

    def query_all(self, regions: "Regions | Located", key: str, params: dict | None = None,
                  unit: str | None = None) -> DataFrame:
        """The answers of the best covering datasets for all regions, in ``unit`` if one is given.

        Who asks for several keys gives the regions as :meth:`located` made them, once.
        """
        located = self.located(regions)
        regions = located.regions
        routed = cut_lineage(route(located.ids, located.coverage, self.catalog(), self.scopes(), key))
        used = sorted(r.dataset_id for r in routed.select("dataset_id").distinct().collect())
        # Street values of any number of datasets are summed in one scan of the edges.
        shared = [n for n in used if type(self.datasets[n]).answer is StreetValueDataset.answer]
        answers = []
        if len(shared) > 1:
            values = reduce(DataFrame.unionByName, [self.datasets[n].payload.select(
                F.lit(n).alias("dataset_id"), "street_id", "value") for n in shared])
            rows = street_values_routed(regions.edges, routed.filter(c("dataset_id").isin(shared)), values)
            if unit is not None:
                factors = [F.lit(v) for n in shared for v in (n, self._factor(n, unit))]
                rows = rows.withColumn("value", c("value") * F.element_at(F.create_map(*factors), c("dataset_id")))
            answers.append(rows.select("region_id", "value"))
        for number in used if len(shared) < 2 else [n for n in used if n not in shared]:
            dataset = self.datasets[number]
            rows = dataset.answer(regions.only(routed.filter(c("dataset_id") == number)), dict(params or {}))
            if unit is not None:
                rows = convert_unit(rows, "value", dataset.unit, unit)
            answers.append(rows)
        return reduce(lambda a, b: a.unionByName(b), answers)

    def _factor(self, number: int, unit: str) -> float:
        if self.datasets[number].unit is None:
            raise DataError(f"value has no unit, but {unit} is requested")
        return conversion_factor(self.datasets[number].unit, unit)


# --- checks -------------------------------------------------------------------------------------------

# Columns (and their type family) each key's answer must have.
EXPECTED = {
    RESIDENTIAL_HEAT_DEMAND_PROFILE: {"hour": "number", "value": "number"},
    RESIDENTIAL_ELECTRICITY_DEMAND_PROFILE: {"hour": "number", "value": "number"},
    RESIDENTIAL_ELECTRICITY_DEMAND: {"region_id": "any", "value": "number"},
    RESIDENTIAL_HEAT_DEMAND: {"region_id": "any", "value": "number"},
    HEATING_SHARES: {"region_id": "any", "technology": "string", "share": "number"},
    STREET_NETWORK: {"parts": "line"},
    LINEAR_HEAT_DENSITY: {"parts": "line", "heat_density_mwh_per_km": "number"},
}
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def check_answers(answers: dict[str, DataFrame]) -> list[tuple[str, str, bool]]:
    """``(key, check, passed)`` for each expected column, from the answers' schemas."""
    def fits(kind: str, name: str, frame: DataFrame) -> bool:
        if name not in frame.columns:
            return False
        found = frame.schema[name].dataType.simpleString()
        return (kind == "any" or (kind == "number" and found in _NUMBERS)
                or (kind == "string" and found == "string") or (kind == "line" and found == geo.PARTS))
    return [(key, f"{name} is {kind}", key in answers and fits(kind, name, answers[key]))
            for key, columns in EXPECTED.items() for name, kind in columns.items()]


def check_registry(registry: Registry, regions: Regions, area: DataFrame) -> DataFrame:
    """Ask every built-in key for the sample regions and check the answers' shape and contents.

    ``key, check, passed, rows, missing``: whether the column is there and of its kind, how many rows the answer has
    and in how many of them the column is NULL. A key without an answer passes nothing and has no rows.
    """
    answers = {}
    located = registry.located(regions)
    for key in EXPECTED:
        try:
            answers[key] = registry.streets(area) if key == STREET_NETWORK else registry.query_all(located, key)
        except (NoDatasetError, DataError, NotImplementedError):
            continue
    shapes = registry.spark.createDataFrame(check_answers(answers), "key string, check string, passed boolean")
    counted = [registry.spark.createDataFrame([], "key string, check string, rows bigint, missing bigint")]
    for key, frame in answers.items():
        found = {name: f"{name} is {kind}" for name, kind in EXPECTED[key].items() if name in frame.columns}
        sums = frame.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c(n).isNull()).alias(f"_{n}") for n in found])
        if found:
            counted.append(sums.select(F.lit(key).alias("key"), "rows", F.explode(F.array(*[
                F.struct(F.lit(check).alias("check"), c(f"_{n}").alias("missing")) for n, check in found.items()])).alias("x"))
                .select("key", "x.check", "rows", "x.missing"))
    return (shapes.join(reduce(DataFrame.unionByName, counted), ["key", "check"], "left")
            .fillna(0, ["rows", "missing"]))
