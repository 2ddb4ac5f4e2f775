"""Street networks: regions of streets, edges, regional sub-networks and their connections."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions import geometry as geo
from regionflow.operators import graph
from regionflow.operators.coverage import polygons_containing, ring_edges
from regionflow.operators.streets import SOURCE_ID, segments
from regionflow.scale import attach, cut_lineage, running, with_totals

c = F.col


# --- which region does a street belong to ----------------------------------------------------

def polygon_matches(streets: DataFrame, polygons: DataFrame, street_id: str, region_id: str) -> DataFrame:
    """Pairs ``street_id, region_id`` where the polygon contains the whole street.

    Streets and polygon borders are cut where they meet; a street is contained by the polygons that cover all its
    pieces (see :mod:`regionflow.operators.coverage`), not by one on whose border it merely lies.
    """
    lines = cut_lineage(streets.select(c(street_id).alias("_street"), F.posexplode(geo.flat_segments(c("parts"))).alias("n", "_s"))
                        .select("_street", "n", "_s.a.x", "_s.a.y", "_s.b").toDF("_street", "n", "ax", "ay", "_b")
                        .select("_street", "n", "ax", "ay", c("_b.x").alias("bx"), c("_b.y").alias("by")))
    edges = cut_lineage(ring_edges(polygons.select(c(region_id).alias("_region"), "rings"), "_region"))
    pairs = polygons_containing(lines, edges, "_street", "_region")
    return pairs.select(c("_street").alias(street_id), c("_region").alias("region_id"))


def overlap_violations(matches: DataFrame, street_id: str) -> DataFrame:
    """Streets that lie in more than one polygon: ``street_id, polygons`` (how many)."""
    return (matches.distinct().groupBy(street_id).agg(F.count(F.lit(1)).alias("polygons"))
            .filter("polygons > 1"))


def assign_by_polygon(streets: DataFrame, polygons: DataFrame, street_id: str, region_id: str,
                      strict: bool = True) -> DataFrame:
    """Add ``region_id``: the polygon containing the whole street, NULL if none does."""
    matches = polygon_matches(streets, polygons, street_id, region_id)
    if strict:
        matches = cut_lineage(matches)
        bad = overlap_violations(matches, street_id)
        shown = bad.limit(20).collect()
        if shown:
            raise DataError(f"{bad.count()} street(s) lie within multiple polygons, e.g. "
                            f"{[r[street_id] for r in shown]}")
    return streets.drop("region_id").join(matches, street_id, "left")


def assign_by_mapping(streets: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Region from listed column values: ``mapping`` rows ``ord, region_id, column, value``.

    ``columns`` are the street columns the mapping may name. If several entries match, the one
    with the largest ``ord`` wins. The last word of each (column, value) is decided first, so the
    street side meets at most one row per column.
    """
    last = mapping.groupBy("column", "value").agg(F.max_by("region_id", "ord").alias("region_id"),
                                                   F.max("ord").alias("ord"))
    rows = streets.drop("region_id")
    hits = []
    for name in columns:
        lookup = last.filter(c("column") == name).select(
            c("value").cast(streets.schema[name].dataType).alias(name),
            F.struct("ord", "region_id").alias(f"_hit_{name}"))
        rows = attach(rows, lookup, [name])
        hits.append(c(f"_hit_{name}"))
    winner = F.array_max(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return rows.withColumn("region_id", winner["region_id"]).drop(*[f"_hit_{n}" for n in columns])


def check_grouping(grouping: dict) -> None:
    """``{region: {column: [values]}}`` with int regions, str columns and list values."""
    if not isinstance(grouping, dict):
        raise TypeError("grouping must be a dict")
    for region, selectors in grouping.items():
        if not isinstance(region, int):
            raise TypeError(f"region {region!r} must be an integer")
        if not isinstance(selectors, dict):
            raise TypeError(f"region {region}: selectors must be a dict")
        for column, values in selectors.items():
            if not isinstance(column, str):
                raise TypeError(f"region {region}: column {column!r} must be a string")
            if not isinstance(values, list):
                raise TypeError(f"region {region}: values of {column} must be a list")


def mapping_rows(spark, grouping: dict) -> DataFrame:
    """The configured grouping as rows for :func:`assign_by_mapping`."""
    check_grouping(grouping)
    rows, order = [], 0
    for region, selectors in grouping.items():
        for column, values in selectors.items():
            order += 1
            rows += [(order, region, column, str(v)) for v in values]
    return spark.createDataFrame(rows, "ord int, region_id long, column string, value string")


# --- edges -----------------------------------------------------------------------------------

def edges_of_segments(segs: DataFrame, street: str, extensive: list[str], position: str,
                      keep_parallel: bool = False) -> DataFrame:
    """Undirected edges from segment rows (``ax..by``, ``length``, street columns).

    Extensive columns are multiplied by the segment's share of its street's length. Of parallel
    edges the last one, by (``position``, part, seq), stays; this loses the share of the others,
    which ``keep_parallel`` avoids.
    """
    a, b = geo.point(c("ax"), c("ay")), geo.point(c("bx"), c("by"))
    rows = segs
    if extensive:
        rows = with_totals(rows, [street], _total=F.sum("length"))
        share = F.when(c("_total") > 0, c("length") / c("_total")).otherwise(F.lit(1.0))
        rows = rows.withColumns({name: c(name) * share for name in extensive}).drop("_total")
    rows = (rows.withColumns({"u": F.least(a, b), "v": F.greatest(a, b)})
            .drop("ax", "ay", "bx", "by", "start", "part_length"))
    if keep_parallel:
        return rows
    others = [n for n in rows.columns if n not in ("u", "v")]
    last = rows.groupBy("u", "v").agg(F.max_by(F.struct(*others), F.struct(position, "part", "seq")).alias("_e"))
    return last.select("u", "v", *[c(f"_e.{n}").alias(n) for n in others])


def build_edges(streets: DataFrame, street: str, extensive: list[str], position: str | None = None,
                keep_parallel: bool = False) -> DataFrame:
    """Edges of a street table; all street attributes are copied to its edges."""
    attributes = [n for n in streets.columns if n not in ("parts", "multi")]
    segs = segments(streets.filter(c("parts").isNotNull()), *attributes)
    return edges_of_segments(segs, street, extensive, position or street, keep_parallel)


def region_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(c("region_id").isNotNull())


def edge_nodes(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct end nodes with the given keys: ``keys..., node, x, y``."""
    ends = (edges.select(*keys, c("u").alias("node"))
            .unionByName(edges.select(*keys, c("v").alias("node"))).distinct())
    return ends.withColumns({"x": c("node.x"), "y": c("node.y")})


def connectivity_report(edges: DataFrame) -> DataFrame:
    """Per region: ``components``, ``largest`` (nodes) and ``isolated`` (streets outside it)."""
    inside = region_edges(edges)
    labels = cut_lineage(graph.components_by(inside, "region_id"))
    sizes = labels.groupBy("region_id", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"),
        F.max_by("component", F.struct("n", (-c("component.x")).alias("x"), (-c("component.y")).alias("y"))
                 ).alias("main"))
    outside = isolated_streets(inside, labels, main)
    counts = outside.groupBy("region_id").agg(F.count(F.lit(1)).alias("isolated"))
    return main.join(counts, "region_id", "left").select(
        "region_id", "components", "largest", F.coalesce("isolated", F.lit(0)).alias("isolated"))


def isolated_streets(edges: DataFrame, labels: DataFrame, main: DataFrame) -> DataFrame:
    """``region_id``, street id of streets outside their region's main component."""
    loose = attach(labels, main.select("region_id", "main"), ["region_id"], "inner").filter(
        c("component") != c("main")).select("region_id", c("node").alias("u"))
    return (edges.join(loose, ["region_id", "u"], "left_semi")
            .filter(c(SOURCE_ID).isNotNull()).select("region_id", SOURCE_ID).distinct())


def require_connected(edges: DataFrame) -> None:
    broken = connectivity_report(edges).filter("components > 1").limit(20).collect()
    if broken:
        raise DataError("regions not connected: " + ", ".join(
            f"{r.region_id} ({r.components} parts, largest {r.largest} nodes, "
            f"{r.isolated} streets outside)" for r in broken))


def total_edge_length(edges: DataFrame, by: str = "region_id") -> DataFrame:
    return edges.groupBy(by).agg(F.sum("length").alias("length"))


def edge_property(edges: DataFrame, name: str) -> DataFrame:
    return edges.select("u", "v", name)


def node_property(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select("node", name)


def subgraph_by_edge(edges: DataFrame, column: str, value=None) -> DataFrame:
    """Edges with a value in ``column`` (all values, keyed by the column) or with one value."""
    return edges.filter(c(column).isNotNull() if value is None else c(column) == F.lit(value))


def subgraph_by_node(edges: DataFrame, nodes: DataFrame, column: str, value=None) -> DataFrame:
    """Edges whose both ends carry the same value; the value is added to the edge."""
    tagged = nodes.filter(c(column).isNotNull() if value is None else c(column) == F.lit(value))
    rows = edges.drop(column)
    rows = attach(rows, tagged.select(c("node").alias("u"), c(column)), ["u"], "inner")
    return rows.join(tagged.select(c("node").alias("v"), c(column)), ["v", column], "left_semi")


# --- connections between regions ---------------------------------------------------------------

def touching_regions(nodes: DataFrame) -> DataFrame:
    """Region pairs ``a < b`` sharing nodes: ``a, b, length`` 0 and the number of shared nodes.

    ``nodes``: distinct ``region_id, node``. A node belongs to few regions, so the self join on
    the node stays small.
    """
    left = nodes.select("node", c("region_id").alias("a"))
    right = nodes.select("node", c("region_id").alias("b"))
    pairs = left.join(right, "node").filter(c("a") < c("b"))
    return pairs.groupBy("a", "b").agg(F.lit(0.0).alias("length"), F.count(F.lit(1)).alias("shared"))


@dataclass(frozen=True)
class Search:
    """Labels of a search over contracted edges, and the edges of the chains that were contracted."""

    best: DataFrame
    inside: DataFrame


def region_distances(edges: DataFrame, nodes: DataFrame, max_length: float | None = None,
                     over_third_regions: bool = True) -> tuple[DataFrame, Search]:
    """Shortest connections between regions that do not touch.

    Returns ``(a, b, length, node)`` with ``a < b`` and the end node in ``b`` (ties: smallest
    node), and the search they were read from. Without ``over_third_regions`` only pairs whose shortest way uses no
    edge of a third region are searched for and returned. Chains of nodes that lie in no region and have two
    neighbours are one step of the search, so its rounds follow the junctions.
    """
    links, inside = graph.contract(edges.select("u", "v", "length", c("region_id").alias("owner")), nodes)
    sources = nodes.select(c("region_id").alias("source"), "node")
    best = cut_lineage(graph.shortest_from_groups(links, sources, max_length, own_ways=not over_third_regions))
    touching = touching_regions(nodes).select("a", "b")
    reached = (best.join(nodes.select("node", c("region_id").alias("b")), "node")
               .filter(c("source") < c("b")))
    pairs = reached.groupBy(c("source").alias("a"), "b").agg(F.min(F.struct("dist", "node", "third", "owner")).alias("_m"))
    if not over_third_regions:
        pairs = pairs.filter(~c("_m.third") & (c("_m.owner").isNull() | (c("_m.owner") == c("b"))))
    pairs = pairs.select("a", "b", c("_m.dist").alias("length"), "_m.node")
    return pairs.join(touching, ["a", "b"], "left_anti"), Search(best, inside)


def connection_paths(pairs: DataFrame, search: Search) -> DataFrame:
    """Path vertices of each connection from ``a`` to ``b``: ``a, b, seq, node``.

    The ways over contracted links are unrolled first; then the nodes of the chains that they use take their places.
    """
    rows = graph.walk_back(pairs.select(c("a").alias("source"), c("b").alias("target"), "node"), search.best)
    steps = search.best.filter(c("chain").isNotNull()).select("source", "node", "pred", "chain")
    hops = cut_lineage(with_totals(rows, ["source", "target"], _hops=F.max("back")).join(steps, ["source", "node"], "left")
                       .select("source", "target", (c("_hops") - c("back")).alias("_hop"), "node", "pred", "chain"))
    used = hops.filter(c("chain").isNotNull()).select("chain").distinct()
    places = graph.chain_places(cut_lineage(search.inside.join(used, "chain", "left_semi")))
    sizes = places.filter("place = 0").select("chain", "size")
    hops = cut_lineage(hops.join(sizes, "chain", "left").withColumn("_size", F.coalesce("size", F.lit(0))))
    hops = cut_lineage(running(hops, ["source", "target"], ["_hop"], sums={"_before": "_size"})
                       .withColumn("seq", c("_hop") + c("_before")))
    between = hops.filter(c("chain").isNotNull()).select(
        "source", "target", "chain", "seq", "_size", (c("pred") < c("node")).alias("_up")).join(
        places.select("chain", "node", "place"), "chain").select(
        "source", "target", F.when(c("_up"), c("seq") - c("_size") + c("place")).otherwise(c("seq") - 1 - c("place")).alias("seq"),
        "node")
    return hops.select("source", "target", "seq", "node").unionByName(between).select(
        c("source").alias("a"), c("target").alias("b"), c("seq").cast("int").alias("seq"), "node")


def path_edges(paths: DataFrame) -> DataFrame:
    """Consecutive path nodes as canonical edges ``a, b, u, v`` (matched on the position)."""
    heads = paths.select("a", "b", "seq", c("node").alias("p"))
    tails = paths.select("a", "b", (c("seq") - 1).alias("seq"), c("node").alias("q"))
    return heads.join(tails, ["a", "b", "seq"]).select(
        "a", "b", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))


def foreign_connections(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose path uses an edge owned by a third region."""
    owners = edges.filter(c("region_id").isNotNull()).select("u", "v", c("region_id").alias("owner"))
    return (path_edges(paths).join(owners, ["u", "v"])
            .filter((c("owner") != c("a")) & (c("owner") != c("b"))).select("a", "b").distinct())


def region_connections(edges: DataFrame, over_third_regions: bool = False,
                       max_length: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All connections ``a, b, length`` (a < b) and the paths of the non-touching ones.

    A connection whose shortest path runs through a third region is dropped, not rerouted.
    """
    nodes = cut_lineage(edge_nodes(region_edges(edges), "region_id").select("region_id", "node"))
    touching = touching_regions(nodes).select("a", "b", "length")
    pairs, search = region_distances(edges, nodes, max_length, over_third_regions)
    pairs = cut_lineage(pairs)
    paths = cut_lineage(connection_paths(pairs, search))
    return touching.unionByName(pairs.select("a", "b", "length")), paths


def connection_between(connections: DataFrame, first: int, second: int) -> DataFrame:
    if first == second:
        raise DataError("a connection needs two different regions")
    low, high = sorted((first, second))
    return connections.filter((c("a") == low) & (c("b") == high))


def order_path(paths: DataFrame, flows: DataFrame) -> DataFrame:
    """Path vertices ordered from the feeding region: ``flows`` rows ``region_in, region_out``."""
    directed = flows.select("region_in", "region_out", F.least("region_in", "region_out").alias("a"),
                            F.greatest("region_in", "region_out").alias("b"))
    rows = with_totals(paths, ["a", "b"], _last=F.max("seq")).join(directed, ["a", "b"])
    seq = F.when(c("region_in") == c("a"), c("seq")).otherwise(c("_last") - c("seq"))
    return rows.select("region_in", "region_out", seq.alias("seq"), "node")


def region_groups(regions: DataFrame, connections: DataFrame, max_length: float | None = None) -> DataFrame:
    """``region_id, group`` (smallest region) among regions with positive grid ``capacity``."""
    active = regions.filter("capacity > 0").select(c("region_id").alias("node"))
    near = connections if max_length is None else connections.filter(c("length") <= max_length)
    links = (near.select(c("a").alias("u"), c("b").alias("v"))
             .join(active.withColumnRenamed("node", "u"), "u", "left_semi")
             .join(active.withColumnRenamed("node", "v"), "v", "left_semi"))
    return graph.connected_components(links, active).select(
        c("node").alias("region_id"), c("component").alias("group"))


def pick_source(groups: DataFrame, regions: DataFrame, locations: DataFrame) -> DataFrame:
    """Source region per group: the listed region with the largest grid capacity, or, if none is
    listed, the largest of all (``added`` = it becomes a new location). Ties: smallest region."""
    listed = locations.select("region_id").distinct().withColumn("_listed", F.lit(True))
    rows = (groups.join(regions.select("region_id", "capacity"), "region_id")
            .join(listed, "region_id", "left")
            .withColumn("_listed", F.coalesce("_listed", F.lit(False))))
    best = rows.groupBy("group").agg(
        F.max(F.struct("_listed", "capacity", (-c("region_id")).alias("r"))).alias("_m"))
    return best.select("group", (-c("_m.r")).alias("region_id"), c("_m.capacity").alias("capacity"),
                       (~c("_m._listed")).alias("added"))
