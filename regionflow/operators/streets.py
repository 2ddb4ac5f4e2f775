"""Street geometry and cleaning.

A street is one row: its id column, ``multi`` (was it a multi-part geometry), ``parts`` and any
attributes. Derived tables (segments, vertices, junction points) have one row per element, so a
street with very many of them is spread over tasks; geometry is gathered again only per piece.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions import geometry as geo
from regionflow.operators import graph
from regionflow.operators.spatial import grid_join, grid_size, radius_cover, segment_cover
from regionflow.scale import attach, cut_lineage, deal, group_limit, group_sizes, has_hot_group, running, with_totals

SOURCE_ID = "source_street_id"
SOURCE_SHARE = "source_share"
#: Column names the network adds; input attributes may not use them.
RESERVED = {"length", "part", "seq", "ax", "ay", "bx", "by"}


def street_violations(streets: DataFrame, id_column: str) -> DataFrame:
    """One row per broken rule: ``rule``, ``offenders`` (a count)."""
    one_row = F.lit(1)
    counts = streets.agg(
        F.count_if(F.col(id_column).isNull()).alias("empty_id"),
        F.count_if(F.col("parts").isNotNull() & (
            (F.size("parts") == 0) | F.exists("parts", lambda p: F.size(p) < 2))).alias("not_a_line"))
    repeated = (streets.filter(F.col(id_column).isNotNull()).groupBy(id_column).count()
                .filter("count > 1").agg(F.count(one_row).alias("repeated_id")))
    rules = [F.struct(F.lit(name).alias("rule"), F.col(name).cast("long").alias("offenders"))
             for name in ("empty_id", "not_a_line")]
    again = F.struct(F.lit("repeated_id").alias("rule"), F.col("repeated_id").cast("long").alias("offenders"))
    return (counts.select(F.inline(F.array(*rules)))
            .unionByName(repeated.select(F.inline(F.array(again)))))


def validate_streets(streets: DataFrame, id_column: str, crs: str | None = "") -> DataFrame:
    """Raise unless there is a CRS and every street has a unique id and line geometry."""
    if crs is None:
        raise DataError("street data has no CRS")
    if id_column not in streets.columns:
        raise DataError(f"street id column '{id_column}' does not exist")
    clash = RESERVED & set(streets.columns)
    if clash:
        raise DataError(f"street columns with reserved names: {sorted(clash)}")
    broken = street_violations(streets, id_column).filter("offenders > 0").collect()
    if broken:
        raise DataError("streets: " + ", ".join(f"{r.rule} ({r.offenders})" for r in broken))
    return streets


def add_lineage(streets: DataFrame, id_column: str) -> DataFrame:
    return streets.withColumns({SOURCE_ID: F.col(id_column), SOURCE_SHARE: F.lit(1.0)})


def explode_vertices(streets: DataFrame, *keep: str) -> DataFrame:
    """One row per vertex: kept columns, ``part``, ``seq`` (0-based), ``x``, ``y``."""
    return (streets.select(*keep, F.posexplode("parts").alias("part", "_line"))
            .select(*keep, "part", F.posexplode("_line").alias("seq", "_p"))
            .select(*keep, "part", "seq", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))


def segments_of_vertices(vertices: DataFrame, street: str = "street_id") -> DataFrame:
    """Segments from vertex rows: each vertex with its successor, in one ordered pass over a street's part."""
    ordered = running(vertices.select(street, "part", "seq", F.col("x").alias("ax"), F.col("y").alias("ay")),
                      [street, "part"], ["seq"], following={"_next": "seq", "bx": "ax", "by": "ay"})
    return (ordered.filter(F.col("_next") == F.col("seq") + 1)
            .select(street, "part", "seq", "ax", "ay", "bx", "by", geo.distance(
                F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("length")))


_BLOCK = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _measured(vertices: Column) -> Column:
    """Segments of one vertex array with their start, and the array's length: ``at, rows``.

    Starts are summed in order, block by block, so the arrays that grow inside the folds stay short and a line of
    very many vertices costs little more than its length.
    """
    def length(s: Column) -> Column:
        return geo.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])

    def of(pairs: Column) -> Column:
        blocks = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.ceil(F.size(pairs) / _BLOCK).cast("int") - 1)
                        ).otherwise(F.array().cast("array<int>"))

        def cut(block: Column) -> Column:
            return F.slice(pairs, block * _BLOCK + 1, F.lit(_BLOCK))

        def next_block(acc: Column, block: Column) -> Column:
            end = F.aggregate(cut(block), acc["at"], lambda at, s: at + length(s))
            return F.struct(end.alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

        def add(acc: Column, s: Column) -> Column:
            own = length(s)
            row = F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"),
                           s["b"]["y"].alias("by"), own.alias("length"), acc["at"].alias("start"))
            return F.struct((acc["at"] + own).alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        def filled(ends: Column) -> Column:
            rows = F.transform(blocks, lambda block: F.aggregate(cut(block), F.struct(
                F.element_at(ends["starts"], block + 1).alias("at"), F.array().cast(_SEGMENTS).alias("rows")), add)["rows"])
            return F.struct(ends["at"].alias("at"), F.flatten(rows).alias("rows"))

        return _bound(F.aggregate(blocks, F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias(
            "starts")), next_block), filled)

    return _bound(geo.ring_segments(vertices), of)


_SEGMENTS = "array<struct<ax:double,ay:double,bx:double,by:double,length:double,start:double>>"


def segments(streets: DataFrame, *keep: str) -> DataFrame:
    """One row per segment: kept columns, ``part``, ``seq``, ends, ``length``, ``start`` and
    ``part_length`` (length before the segment, and of its part). Row-local: no shuffle."""
    return (streets.select(*keep, F.posexplode("parts").alias("part", "_line"))
            .withColumn("_m", _measured(F.col("_line")))
            .select(*keep, "part", F.col("_m.at").alias("part_length"),
                    F.posexplode("_m.rows").alias("seq", "_s"))
            .select(*keep, "part", "seq", "_s.ax", "_s.ay", "_s.bx", "_s.by",
                    "_s.length", "_s.start", "part_length"))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select([F.col(c).alias(prefix + c) for c in rows.columns])


def segment_intersections(a: DataFrame, b: DataFrame, condition: Column | None = None) -> DataFrame:
    """Point intersections of the segments of two tables with columns ``id, ax, ay, bx, by``.

    Returns ``a_*``, ``b_*`` columns plus ``x``, ``y``; collinear overlaps give nothing. A point
    shared by consecutive segments of one street appears once per pair of streets.
    """
    left, right = _prefixed(a, "a_"), _prefixed(b, "b_")
    size = grid_size(a, F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))
    c = F.col
    at = geo.crossing(c("a_ax"), c("a_ay"), c("a_bx"), c("a_by"),
                      c("b_ax"), c("b_ay"), c("b_bx"), c("b_by"))
    near = ((F.least("a_ax", "a_bx") <= F.greatest("b_ax", "b_bx"))
            & (F.least("b_ax", "b_bx") <= F.greatest("a_ax", "a_bx"))
            & (F.least("a_ay", "a_by") <= F.greatest("b_ay", "b_by"))
            & (F.least("b_ay", "b_by") <= F.greatest("a_ay", "a_by")))
    if condition is not None:
        near = condition & near
    pairs = grid_join(left, right,
                      segment_cover("a_ax", "a_ay", "a_bx", "a_by"),
                      segment_cover("b_ax", "b_ay", "b_bx", "b_by"), size, near)
    return (pairs.withColumn("_at", at).filter(F.col("_at").isNotNull())
            .withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")
            .dropDuplicates(["a_id", "b_id", "x", "y"]))


def locate_on_line(points: DataFrame, streets: DataFrame, id_column: str, tol: float) -> DataFrame:
    """Position of points (``x, y`` + the street's id) on their street. Adds ``part``, ``at``
    (length to the foot), ``dist``, ``foot_x/y`` and ``interior`` (within ``tol`` of the line and
    farther than ``tol`` from both its ends).

    The nearest part wins; of equally near segments the first. The street's geometry travels as
    one value, so rows are not multiplied by its segments, and a street with very many points is
    spread over tasks.
    """
    c = F.col
    # measured once per street, before its points multiply it
    lines = streets.select(id_column, F.transform("parts", _measured).alias("_parts"))
    rows = attach(points, lines, [id_column], "inner")

    def candidates(part: Column, number: Column) -> Column:
        def nearest(m: Column) -> Column:
            def on(s: Column, k: Column) -> Column:
                foot = geo.projection(s["ax"], s["ay"], s["bx"], s["by"], c("x"), c("y"))
                return F.element_at(F.transform(F.array(foot), lambda f: F.struct(
                    f["dist"].alias("dist"), number.alias("part"), k.alias("seq"),
                    (s["start"] + f["t"] * s["length"]).alias("at"), f["x"].alias("foot_x"), f["y"].alias("foot_y"),
                    m["at"].alias("part_length"))), 1)
            return F.array_min(F.transform(m["rows"], on))
        return nearest(part)

    found = rows.withColumn("_n", F.array_min(F.transform("_parts", candidates)))
    inside = (c("dist") <= tol) & (c("at") > tol) & (c("at") < c("part_length") - tol)
    return found.select(*points.columns, "_n.*").drop("seq").withColumn("interior", inside)


def near_touch_vertices(vertices: DataFrame, lines: DataFrame, tol: float) -> DataFrame:
    """Vertices (``x, y``) within ``tol`` of the interior of a line (``id`` + segment columns) that
    has no vertex there. Returns ``id, x, y, part, at, dist``."""
    nodes = vertices.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    size = grid_size(lines, F.greatest(F.abs(F.col("bx") - F.col("ax")),
                                       F.abs(F.col("by") - F.col("ay"))), tol)
    c = F.col
    foot = geo.projection(c("ax"), c("ay"), c("bx"), c("by"), c("px"), c("py"))
    near = (c("px").between(F.least("ax", "bx") - tol, F.greatest("ax", "bx") + tol)
            & c("py").between(F.least("ay", "by") - tol, F.greatest("ay", "by") + tol))
    pairs = (grid_join(nodes, lines, radius_cover("px", "py", tol),
                       segment_cover("ax", "ay", "bx", "by"), size, near, radius=tol)
             .withColumn("_f", foot).filter(F.col("_f.dist") <= tol)
             .withColumns({"at": c("start") + c("_f.t") * c("length"), "dist": c("_f.dist")}))
    nearest = pairs.groupBy("id", "px", "py").agg(F.min_by(
        F.struct("part", "at", "dist", "part_length"), F.struct("dist", "part", "seq")).alias("_n"))
    own = (lines.select("id", F.col("ax").alias("px"), F.col("ay").alias("py"))
           .union(lines.select("id", "bx", "by")).distinct())
    return (nearest.select("id", "px", "py", "_n.*")
            .filter((F.col("at") > tol) & (F.col("at") < F.col("part_length") - tol))
            .join(own, ["id", "px", "py"], "left_anti")
            .select("id", F.col("px").alias("x"), F.col("py").alias("y"), "part", "at", "dist"))


def dedupe_points(points: DataFrame, tol: float, street: str = "id") -> DataFrame:
    """Along a street part (``street, part, at``) keep the first point, and each that is farther than ``tol`` from
    the last one *kept*.

    Streets of ordinary size are dealt over tasks by their number, sorted and scanned from end to end. If one is
    larger than the limit, points are told apart into runs without a gap above ``tol`` first: the first of a run is
    always kept, and a choice can only arise in runs longer than ``tol``, each of which is scanned by one task.
    """
    keys, order, columns = [street, "part"], ["at", "x", "y"], points.columns
    total, largest = group_sizes(points, keys)
    if largest <= group_limit(points.sparkSession):
        dealt = deal(points, total, *keys).sortWithinPartitions(*keys, *order)
        return dealt.mapInPandas(_spaced(keys, tol, columns), points.schema)
    ordered = running(points, keys, order, previous={"_before": "at"}, hot=True)
    begins = F.col("_before").isNull() | (F.col("at") > F.col("_before") + tol)
    marked = ordered.withColumn("_begins", F.when(begins, 1).otherwise(0)).withColumn("_tie", 1 - F.col("_begins"))
    # of equal points the one that begins a run comes first in this order too
    runs = running(marked, keys, ["at", "x", "y", "_tie"], sums={"_run": "_begins"}, hot=True)
    runs = with_totals(runs, [*keys, "_run"], _low=F.min("at"), _high=F.max("at"))
    long = F.col("_high") > F.col("_low") + tol
    searched = (deal(runs.filter(long).select(*columns, "_run"), total, *keys, "_run")
                .sortWithinPartitions(*keys, "_run", *order)
                .mapInPandas(_spaced([*keys, "_run"], tol, columns), points.schema))
    return runs.filter(~long & (F.col("_begins") == 1)).select(columns).unionByName(searched)


def _spaced(keys: list[str], tol: float, columns: list[str]):
    """Scan of rows sorted by ``keys`` and ``at`` that yields the kept ones and holds no more than a batch of them."""
    def scan(batches):
        import numpy as np

        now, before, last = None, 0.0, 0.0
        for frame in batches:
            if not len(frame):
                continue
            at = frame["at"].to_numpy()
            group = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            first, final = frame[keys].iloc[[0, -1]].itertuples(index=False, name=None)
            same = np.append(first == now, group[1:] == group[:-1])
            previous = np.append(before, at[:-1])
            # a gap begins a run, whose first point is always kept; NULL positions stand alone
            near = same & ~(at > previous + tol) & ~np.isnan(at) & ~np.isnan(previous)
            begins = np.flatnonzero(~near)
            kept = begins.tolist()
            begin, end = np.append(0, begins), np.append(begins, len(at))
            # the rows before the first gap go on with the last kept point of the batch before
            lasts = np.append(last, at[begins])
            more = np.flatnonzero((end > begin) & (at[end - 1] > lasts + tol))
            for run in more.tolist():
                low, high, kept_at = begin[run], end[run], lasts[run]
                k = low + at[low:high].searchsorted(kept_at + tol, "right")
                while k < high:
                    kept.append(k)
                    kept_at = at[k]
                    k += at[k:high].searchsorted(kept_at + tol, "right")
                lasts[run] = kept_at
            now, before, last = final, at[-1], lasts[-1]
            yield frame.iloc[kept][columns]

    return scan


def vertices_along(streets: DataFrame, id_column: str) -> DataFrame:
    """Vertex rows with their length from the start of the part: ``id, part, seq, at, x, y,
    begins, ends`` (first and last vertex of the part). Row-local."""
    def measured(vertices: Column) -> Column:
        def all_of(m: Column) -> Column:
            last = F.try_element_at(vertices, F.lit(-1))
            return F.when(last.isNotNull(), F.concat(
                F.transform(m["rows"], lambda s: F.struct(s["ax"].alias("x"), s["ay"].alias("y"), s["start"].alias("at"))),
                F.array(F.struct(last["x"].alias("x"), last["y"].alias("y"), m["at"].alias("at")))))
        return _bound(_measured(vertices), all_of)

    return (streets.select(F.col(id_column).alias("id"), F.posexplode("parts").alias("part", "_line"))
            .select("id", "part", F.size("_line").alias("_n"), F.posexplode(measured(F.col("_line"))).alias("seq", "_v"))
            .select("id", "part", "seq", "_v.at", "_v.x", "_v.y", (F.col("seq") == 0).alias("begins"),
                    (F.col("seq") == F.col("_n") - 1).alias("ends")))


def _with_points(streets: DataFrame, points: DataFrame, tol: float, id_column: str) -> tuple[DataFrame, bool]:
    """Vertex rows of the streets named in ``points`` with the points merged in, and whether some
    street has very many rows.

    Columns: id, ``part``, ``seq`` (vertex number, or NULL), ``at``, ``x``, ``y``, ``cut``,
    ``begins``, ``ends``. A point within ``tol`` of a vertex marks that vertex as a cut and is
    not inserted; points are farther than ``tol`` from each other, so one look to either side in
    the order along the part decides.
    """
    touched = streets.join(points.select(F.col("id").alias(id_column)).distinct(), id_column, "left_semi")
    vertices = vertices_along(touched, id_column).withColumn("point", F.lit(False))
    marks = points.select("id", F.col("part").cast("int").alias("part"), F.lit(None).cast("int").alias("seq"), "at", "x", "y",
                          F.lit(False).alias("begins"), F.lit(False).alias("ends"), F.lit(True).alias("point"))
    rows = vertices.unionByName(marks)
    hot = has_hot_group(rows, ["id"])
    near = running(rows, ["id", "part"], _ALONG, hot=hot,
                   previous={"_p": "point", "_pat": "at"}, following={"_n": "point", "_nat": "at"})
    at, point = F.col("at"), F.col("point")

    def beside(other: str, other_at: str) -> Column:
        gap = F.abs(at - F.col(other_at)) <= tol
        return F.coalesce((F.col(other) != point) & gap, F.lit(False))

    meets = beside("_p", "_pat") | beside("_n", "_nat")
    kept = near.filter(~(point & meets))
    return kept.select("id", "part", "seq", "at", "x", "y", "begins", "ends",
                       (point | (meets & ~F.col("begins") & ~F.col("ends"))).alias("cut")), hot


_ALONG = ["at", "seq", "x", "y"]


def _gathered(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Vertex rows (``ord``, ``x``, ``y``) of one line back into one vertex array."""
    return rows.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "x", "y"))),
        lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"), *more)


def insert_vertex(streets: DataFrame, points: DataFrame, id_column: str, tol: float) -> DataFrame:
    """Insert points (``id, part, at, x, y``) as vertices; ends and existing vertices are left."""
    merged, _ = _with_points(streets, points, tol, id_column)
    lines = _gathered(merged.withColumn("ord", F.struct(*_ALONG)), ["id", "part"])
    parts = lines.groupBy("id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "line"))), lambda s: s["line"]).alias("_new"))
    return (streets.join(parts.withColumnRenamed("id", id_column), id_column, "left")
            .withColumn("parts", F.coalesce("_new", "parts")).drop("_new"))


def split_at_points(streets: DataFrame, points: DataFrame, id_column: str, tol: float) -> DataFrame:
    """Cut single-part streets at interior points: ``id``, ``piece`` (1-based), ``line``, ``length``
    and ``whole`` (the street was not cut at all).

    The running number of cuts before a vertex is its piece; a cut vertex ends one piece and
    starts the next.
    """
    merged, hot = _with_points(streets, points, tol, id_column)
    counted = running(merged.withColumn("_cut", F.col("cut").cast("long")),
                      ["id", "part"], _ALONG, sums={"_cuts": "_cut"}, hot=hot)
    piece = F.when(F.col("cut"), F.array(F.col("_cuts"), F.col("_cuts") + 1)).otherwise(
        F.array(F.col("_cuts") + 1))
    rows = counted.withColumn("piece", F.explode(piece)).withColumn("ord", F.struct(*_ALONG))
    lines = _gathered(rows, ["id", "piece"], (F.max("begins") & F.max("ends")).alias("whole"))
    return lines.withColumn("length", geo.line_length(F.array("line")))


_MARKS = "array<struct<side:string,at:double,x:double,y:double,dist:double>>"


def junction_points(streets: DataFrame, id_column: str, tol: float = 1e-6) -> DataFrame:
    """Where streets must be split: ``id, part, at, x, y`` in the interior of street ``id``.

    One grid join finds all pairs of segments of different streets that come within ``tol``. A
    pair gives its crossing to both streets, and the end of one segment that lies on the other
    to that other street. Such an end is used itself as the split point, so that both streets
    share one node bit by bit.
    """
    segs = segments(streets.filter(F.col("parts").isNotNull()), id_column).withColumnRenamed(id_column, "id").drop("seq")
    left, right = _prefixed(segs, "a_"), _prefixed(segs, "b_")
    c = F.col
    near = ((c("a_id") < c("b_id"))
            & (F.least("a_ax", "a_bx") - tol <= F.greatest("b_ax", "b_bx"))
            & (F.least("b_ax", "b_bx") - tol <= F.greatest("a_ax", "a_bx"))
            & (F.least("a_ay", "a_by") - tol <= F.greatest("b_ay", "b_by"))
            & (F.least("b_ay", "b_by") - tol <= F.greatest("a_ay", "a_by")))
    size = grid_size(segs, F.greatest(F.abs(c("bx") - c("ax")), F.abs(c("by") - c("ay"))), tol)
    pairs = grid_join(left, right, segment_cover("a_ax", "a_ay", "a_bx", "a_by", tol),
                      segment_cover("b_ax", "b_ay", "b_bx", "b_by", tol), size, near, radius=tol)
    # few pairs pass; stored here, the wide expressions below stay out of the candidate loop, which
    # would otherwise grow too large to be compiled
    pairs = cut_lineage(pairs)
    ends = lambda s: [(c(f"{s}_ax"), c(f"{s}_ay")), (c(f"{s}_bx"), c(f"{s}_by"))]
    (a1, a2), (b1, b2) = ends("a"), ends("b")

    def touched(s: str, other: str) -> Column:
        """Ends of the other segment that lie within ``tol`` of side ``s`` but are not its ends."""
        p, q = ends(s)

        def on(e: Column) -> Column:
            foot = geo.projection(*p, *q, e["x"], e["y"])
            return F.transform(F.array(foot), lambda f: F.struct(
                F.lit(s).alias("side"), (c(f"{s}_start") + f["t"] * c(f"{s}_length")).alias("at"),
                e["x"].alias("x"), e["y"].alias("y"), f["dist"].alias("dist")))
        loose = F.filter(F.array(*[geo.point(x, y) for x, y in ends(other)]), lambda e: ~(
            ((e["x"] == p[0]) & (e["y"] == p[1])) | ((e["x"] == q[0]) & (e["y"] == q[1]))))
        return F.flatten(F.transform(loose, on))

    def crossed(s: str) -> Column:
        x, y = c("_at.x"), c("_at.y")
        return F.struct(F.lit(s).alias("side"), (c(f"{s}_start") + geo.distance(*ends(s)[0], x, y)).alias("at"),
                        x.alias("x"), y.alias("y"), F.lit(0.0).alias("dist"))

    crossings = F.when(c("_at").isNotNull(), F.array(crossed("a"), crossed("b")))
    found = (pairs.withColumn("_at", geo.crossing(*a1, *a2, *b1, *b2))
             .withColumn("_marks", F.concat(F.coalesce(crossings, F.array().cast(_MARKS)),
                                            touched("b", "a"), touched("a", "b"))))
    marks = found.select("a_id", "a_part", "a_part_length", "b_id", "b_part", "b_part_length", F.inline("_marks"))
    of = lambda n: F.when(c("side") == "a", c(f"a_{n}")).otherwise(c(f"b_{n}"))
    points = marks.filter((c("dist") <= tol) & (c("at") > tol) & (c("at") < of("part_length") - tol)).select(
        of("id").alias("id"), of("part").alias("part"), "at", "x", "y")
    # cells and shared ends repeat points; copies are closer than tol and fall out here
    return cut_lineage(dedupe_points(cut_lineage(points), tol))


def divide_at_junctions(streets: DataFrame, id_column: str, extensive: list[str] | None = None,
                        tol: float = 1e-6) -> DataFrame:
    """Split streets where another street meets their interior.

    Piece ids are ``<100 k><id>``; extensive columns are divided by length share, others copied.
    Streets with several true parts only get the junctions as vertices.
    """
    extensive = [c for c in extensive or [] if c in streets.columns]
    points = junction_points(streets, id_column, tol)
    single = F.coalesce(F.size("parts") == 1, F.lit(False))
    singles, others = streets.filter(single), streets.filter(~single)
    pieces = cut_lineage(split_at_points(singles, points, id_column, tol)
                         .filter(~F.col("whole")).withColumnRenamed("id", id_column))
    whole = singles.join(pieces.filter("piece = 1").select(id_column), id_column, "left_anti")
    # a street may have very many pieces, so its attributes are attached like any hot key
    street = singles.withColumn("_total", geo.line_length(F.col("parts"))).drop("parts")
    cut = attach(pieces, street, [id_column], "inner")
    share = F.when(F.col("_total") > 0, F.col("length") / F.col("_total")).otherwise(F.lit(1.0))
    cut = cut.withColumns({
        **{c: F.col(c) * share for c in extensive},
        "parts": F.array("line"),
        id_column: F.concat((F.col("piece") * 100).cast("string"), F.col(id_column).cast("string"))})
    if not others.filter(F.col("parts").isNotNull()).isEmpty():
        others = insert_vertex(others, points, id_column, tol)
    columns = [F.col(c).cast("string").alias(c) if c == id_column else F.col(c) for c in streets.columns]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in (whole, cut, others)])


def street_edges(streets: DataFrame, id_column: str) -> DataFrame:
    """Distinct undirected vertex pairs ``u, v`` with the streets' ids (one row per segment)."""
    segs = segments(streets.filter(F.col("parts").isNotNull()), id_column)
    a, b = geo.point(F.col("ax"), F.col("ay")), geo.point(F.col("bx"), F.col("by"))
    return segs.select(F.col(id_column).alias("id"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes of degree one with their only neighbour; a self loop counts twice."""
    unique = edges.select("u", "v").distinct()
    ends = (unique.select(F.col("u").alias("node"), F.col("v").alias("neighbour"))
            .unionByName(unique.select(F.col("v").alias("node"), F.col("u").alias("neighbour"))))
    return (ends.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.first("neighbour").alias("neighbour"))
            .filter("_n = 1").drop("_n"))


def nearest_street(points: DataFrame, lines: DataFrame, radius: float,
                   excluded: DataFrame | None = None) -> DataFrame:
    """Nearest line strictly within ``radius`` of each point.

    ``points``: ``node`` (struct), ``px``, ``py``; ``lines``: ``id`` + segment columns;
    ``excluded``: pairs ``node, id``. Equally near lines: smallest id. Returns ``node, id,
    dist, part, at, x, y``.
    """
    c = F.col
    size = grid_size(lines, F.greatest(F.abs(c("bx") - c("ax")), F.abs(c("by") - c("ay"))), radius)
    near = (c("px").between(F.least("ax", "bx") - radius, F.greatest("ax", "bx") + radius)
            & c("py").between(F.least("ay", "by") - radius, F.greatest("ay", "by") + radius))
    foot = geo.projection(c("ax"), c("ay"), c("bx"), c("by"), c("px"), c("py"))
    pairs = (grid_join(points, lines, radius_cover("px", "py", radius),
                       segment_cover("ax", "ay", "bx", "by"), size, near, radius=radius)
             .withColumn("_f", foot).filter(c("_f.dist") < radius)
             .withColumns({"at": c("start") + c("_f.t") * c("length"), "dist": c("_f.dist"),
                           "x": c("_f.x"), "y": c("_f.y")}))
    if excluded is not None:
        pairs = pairs.join(excluded, ["node", "id"], "left_anti")
    best = pairs.groupBy("node").agg(F.min_by(
        F.struct("id", "dist", "part", "at", "x", "y"), F.struct("dist", "id", "part", "seq")).alias("_b"))
    return best.select("node", "_b.*")


def dedupe_facing(bridges: DataFrame, owners: DataFrame) -> DataFrame:
    """One bridge per unordered set of streets: those at the dead end plus the target.

    ``bridges``: ``node, id, ...``; ``owners``: ``node, owner`` (a dead end has few). The bridge
    of the smallest node stays.
    """
    sets = (bridges.select("node", "id").join(owners, "node")
            .groupBy("node").agg(F.array_sort(F.array_distinct(F.concat(
                F.collect_set("owner"), F.array(F.first("id"))))).alias("streets")))
    first = sets.groupBy("streets").agg(F.min("node").alias("node")).select("node")
    return bridges.join(first, "node", "left_semi")


def close_gaps(streets: DataFrame, radius: float, id_column: str, tol: float = 1e-6) -> DataFrame:
    """Bridge dead ends to the nearest street within ``radius``.

    The foot point becomes a vertex of the target; a connector street ``000<target>`` is added
    whose other attributes are NULL.
    """
    # stored, so that its size is known: nodes and owners made of guessed rows would be broadcast
    streets = cut_lineage(streets.withColumn(id_column, F.col(id_column).cast("string")))
    segs = segments(streets.filter(F.col("parts").isNotNull()), id_column).withColumnRenamed(id_column, "id")
    ends = cut_lineage(dead_ends(street_edges(streets, id_column)))
    at_node = street_edges(streets, id_column)
    owners = (at_node.select("id", F.col("u").alias("node"))
              .unionByName(at_node.select("id", F.col("v").alias("node"))).distinct())
    own = ends.select("node").join(owners, "node").select("node", "id")
    beyond = (ends.join(owners.withColumnRenamed("node", "neighbour"), "neighbour").select("node", "id"))
    points = ends.select("node", F.col("node.x").alias("px"), F.col("node.y").alias("py"))
    bridges = nearest_street(points, segs, radius, own.unionByName(beyond).distinct())
    bridges = cut_lineage(dedupe_facing(bridges, own.withColumnRenamed("id", "owner")))
    spaced = cut_lineage(dedupe_points(cut_lineage(bridges.select("id", "part", "at", "x", "y").distinct()), tol))
    joined = insert_vertex(streets, spaced, id_column, tol)
    connector = {c: F.lit(None).cast(streets.schema[c].dataType) for c in streets.columns}
    connector[id_column] = F.concat(F.lit("000"), F.col("id"))
    connector["parts"] = F.array(F.array(F.col("node"), geo.point(F.col("x"), F.col("y"))))
    if "multi" in connector:
        connector["multi"] = F.lit(False)
    connectors = bridges.select(*[expr.alias(c) for c, expr in connector.items()])
    return joined.unionByName(connectors)


def drop_isolated_nulls(streets: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Drop streets outside the largest component (by nodes) whose ``columns`` are all NULL.

    Components of equal size: the one with the smallest node counts as the largest.
    """
    edges = street_edges(streets, id_column)
    labels = cut_lineage(graph.connected_components(edges))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    main = sizes.agg(F.max_by("component", F.struct(
        "nodes", (-F.col("component.x")).alias("nx"), (-F.col("component.y")).alias("ny"))).alias("component"))
    outside = labels.join(main, "component", "left_anti").select("node")
    no_data = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    candidates = streets.filter(no_data & F.col("parts").isNotNull()).select(
        id_column, F.element_at(F.element_at("parts", 1), 1).alias("node"))
    dropped = candidates.join(outside, "node", "left_semi").select(id_column)
    return streets.join(dropped, id_column, "left_anti")


# --- patches -------------------------------------------------------------------------------

def patch_table(rows: DataFrame, patches: list[dict], order: str = "row_index") -> DataFrame:
    """Apply small configured changes in order.

    Each patch is ``{"column", "where", "equals", "add" | "replace"}``; ``where`` is a column of
    ``rows`` or ``"index"`` (the ``order`` column). ``add`` takes the first matching row's value
    plus the amount for every match.
    """
    for number, patch in enumerate(patches):
        if len(patch) != 4 or ("add" in patch) == ("replace" in patch):
            raise DataError(f"patch {number}: one selector and exactly one of add / replace")
        column = patch["column"]
        selector = order if patch["where"] == "index" else patch["where"]
        matches = F.col(selector) == F.lit(patch["equals"])
        found = rows.filter(matches).agg(
            F.count(F.lit(1)).alias("n"), F.min_by(F.struct(column), F.col(order)).alias("first")).first()
        if found["n"] == 0:
            raise DataError(f"patch {number}: no row with {patch['where']} = {patch['equals']!r}")
        value = (F.lit(patch["replace"]) if "replace" in patch
                 else F.lit(found["first"][column]) + F.lit(patch["add"]))
        rows = rows.withColumn(column, F.when(matches, value).otherwise(F.col(column)))
    return rows


# --- hulls, anchors, extents ----------------------------------------------------------------

_HULL_CHUNK = 256


def convex_hull(nodes: DataFrame, by: str) -> DataFrame:
    """Hull ring per group from ``x, y`` rows.

    Hulls of small chunks are merged until one chunk per group is left, so no task sorts a whole
    group; only hull vertices travel on.
    """
    points = (nodes.groupBy(by, "x").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
              .select(by, "x", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("y")))

    def hulls(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(geo.hull_chain(F.array_sort(F.collect_set(
            geo.point(F.col("x"), F.col("y"))))).alias("ring"))

    largest = points.groupBy(by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    while largest > _HULL_CHUNK:
        chunks = -(-largest // _HULL_CHUNK)
        chunk = F.pmod(F.xxhash64("x", "y"), F.lit(chunks))
        points = cut_lineage(
            hulls(points.withColumn("_chunk", chunk), [by, "_chunk"])
            .select(by, F.explode("ring").alias("_p")).select(by, "_p.x", "_p.y").distinct())
        smaller = points.groupBy(by).count().agg(F.max("count").alias("n")).first()["n"]
        if smaller >= largest:  # every point is a hull vertex: the result row itself is this long
            break
        largest = smaller
    return hulls(points, [by]).select(by, F.array("ring").alias("rings"))


def anchor_point(nodes: DataFrame, by: str) -> DataFrame:
    """The node nearest to the mean of the group's nodes (ties: smallest node)."""
    mean = with_totals(nodes.select(by, "x", "y").distinct(), [by], _mx=F.avg("x"), _my=F.avg("y"))
    gap = geo.distance(F.col("x"), F.col("y"), F.col("_mx"), F.col("_my"))
    best = mean.groupBy(by).agg(F.min_by(F.struct("x", "y"), F.struct(gap, "x", "y")).alias("_p"))
    return best.select(by, "_p.x", "_p.y")


def hull_centroid(hulls: DataFrame, by: str) -> DataFrame:
    """Area centroid of the first ring; a degenerate hull gives the mean of its vertices."""
    ring = F.element_at("rings", 1)
    shape = hulls.select(by, geo.ring_moment(ring).alias("_m"), ring.alias("_r"))

    def mean(axis: str) -> Column:
        ends = F.array_distinct("_r")
        return F.aggregate(ends, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ends)
    area = F.col("_m.area")
    return shape.select(by, F.when(area != 0, F.try_divide(F.col("_m.mx"), area)).otherwise(mean("x")).alias("x"),
                        F.when(area != 0, F.try_divide(F.col("_m.my"), area)).otherwise(mean("y")).alias("y"),
                        F.abs(area).alias("area"))


def extent(nodes: DataFrame, by: list[str], margin: float = 0.05) -> DataFrame:
    """Bounding box per group, widened by a share of its larger span (at least 1)."""
    box = nodes.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"),
                                 F.max("x").alias("x1"), F.max("y").alias("y1"))
    pad = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)) * margin
    return box.select(*by, (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"),
                      (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))


def dissolve(polygons: DataFrame, by: list[str]) -> DataFrame:
    """Outer borders of polygons merged per group as undirected edges.

    Borders shared by two polygons cancel; they must use the same vertices. Rows: group, ``ax,
    ay, bx, by``. The even-odd rule works on these edges directly.
    """
    edges = (polygons.select(*by, F.explode(geo.flat_segments(F.col("rings"))).alias("s"))
             .select(*by, F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"))
             .filter(F.col("p") != F.col("q")))
    odd = edges.groupBy(*by, "p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return odd.select(*by, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"),
                      F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def overlapping_polygons(polygons: DataFrame, key: str, by: str) -> DataFrame:
    """Pairs of polygons of one group whose borders properly cross: dissolving them is refused."""
    edges = (polygons.select(F.col(key).alias("k"), F.col(by).alias("g"),
                             F.explode(geo.flat_segments(F.col("rings"))).alias("s"))
             .select(F.struct("g", "k").alias("id"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
                     F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")))
    crossings = segment_intersections(
        edges, edges, (F.col("a_id.g") == F.col("b_id.g")) & (F.col("a_id.k") < F.col("b_id.k")))
    def interior(p):
        c = lambda n: F.col(f"{p}_{n}")
        return ~(((F.col("x") == c("ax")) & (F.col("y") == c("ay")))
                 | ((F.col("x") == c("bx")) & (F.col("y") == c("by"))))
    return (crossings.filter(interior("a") & interior("b"))
            .select(F.col("a_id.g").alias(by), F.col("a_id.k").alias("first"),
                    F.col("b_id.k").alias("second")).distinct())


def dissolved_rings(polygons: DataFrame, by: str, key: str) -> DataFrame:
    """Merged polygons as one ``rings`` value per group (each border edge a two-point ring).

    The even-odd and border tests only look at edges, so edges need not be chained into rings.
    """
    clash = overlapping_polygons(polygons, key, by).limit(5).collect()
    if clash:
        raise DataError("polygons overlap: " + ", ".join(f"{r[by]}: {r['first']}/{r['second']}" for r in clash))
    return dissolve(polygons, [by]).groupBy(by).agg(F.collect_list(F.array(
        geo.point(F.col("ax"), F.col("ay")), geo.point(F.col("bx"), F.col("by")))).alias("rings"))


def path_midpoint(path: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Point at half the length of each polyline given as vertex rows ``key, seq, x, y``.

    A path without length gives its first vertex.
    """
    c = F.col
    steps = running(path, [key], [order], previous={"_px": "x", "_py": "y"})
    steps = steps.withColumn("_len", F.coalesce(geo.distance(c("_px"), c("_py"), c("x"), c("y")), F.lit(0.0)))
    steps = running(steps, [key], [order], sums={"_cum": "_len"})
    steps = with_totals(steps, [key], _total=F.sum("_len"))
    half = c("_total") / 2
    reached = steps.filter((c("_total") <= 0) | ((c("_cum") >= half) & (c("_len") > 0)))
    hit = reached.groupBy(key).agg(F.min_by(
        F.struct("x", "y", "_px", "_py", "_cum", "_len", "_total"), c(order)).alias("_h"))
    h = lambda n: c(f"_h.{n}")
    t = F.try_divide(h("_total") / 2 - (h("_cum") - h("_len")), h("_len"))
    return hit.select(key, F.when(h("_total") <= 0, h("x")).otherwise(h("_px") + t * (h("x") - h("_px"))).alias("x"),
                      F.when(h("_total") <= 0, h("y")).otherwise(h("_py") + t * (h("y") - h("_py"))).alias("y"))


#: Nodes per cell below which the nearest-node search stops subdividing.
_LEAF_NODES = 64


def nearest_region(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Region of the nearest network node for every point (``point_id, px, py``).

    ``nodes``: ``region_id, x, y``; coinciding nodes and equal distances: smallest region first.
    All points descend together through ever finer cells. A cell is left out for a point if some
    other cell surely holds a nearer node (its known node is nearer than this cell's border), so
    a point keeps a few cells per level however dense the nodes are, and only cells with few
    nodes are searched node by node.
    """
    seeds = cut_lineage(nodes.groupBy("x", "y").agg(F.min("region_id").alias("region_id")))
    box = seeds.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if box["x0"] is None:
        raise DataError("no network nodes")
    size = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-9) * (1 + 1e-9)
    c = F.col
    cell = lambda v, low, width: F.floor((c(v) - low) / width).cast("long")
    placed = lambda width: seeds.withColumns({"_cx": cell("x", box["x0"], width), "_cy": cell("y", box["y0"], width)})
    identity = points.columns
    front = points.withColumns({"_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    hits = []
    for depth in range(26):
        cells = placed(size).groupBy("_cx", "_cy").agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.struct("x", "y")).alias("_one"))
        # many points may look at one cell; a cell has one row
        seen = attach(front, cells, ["_cx", "_cy"], "inner")
        low = lambda p, axis, k: F.greatest(box[axis] + c(k) * size - c(p), c(p) - box[axis] - (c(k) + 1) * size, F.lit(0.0))
        bounded = seen.withColumns({
            "_near": F.sqrt(F.pow(low("px", "x0", "_cx"), 2) + F.pow(low("py", "y0", "_cy"), 2)) * (1 - 1e-9) - size * 1e-9,
            "_far": geo.distance(c("px"), c("py"), c("_one.x"), c("_one.y"))})
        # a point keeps a few dozen cells at most, so this window is small
        best = F.min("_far").over(Window.partitionBy(*identity))
        kept = cut_lineage(bounded.withColumn("_best", best).filter(c("_near") <= c("_best"))
                           .select(*identity, "_cx", "_cy", "_n"))
        small = c("_n") <= (_LEAF_NODES if depth < 25 else 2 ** 62)
        gap = geo.distance(c("px"), c("py"), c("x"), c("y"))
        hits.append(kept.filter(small).drop("_n").join(placed(size), ["_cx", "_cy"])
                    .withColumn("dist", gap).groupBy(*identity).agg(
                        F.min(F.struct("dist", "region_id")).alias("_b")))
        front = kept.filter(~small)
        if front.isEmpty():
            break
        inner = F.lit([0, 1, 2, 3])
        front = (front.withColumn("_cx", F.explode(F.transform(inner, lambda k: c("_cx") * 4 + k)))
                 .withColumn("_cy", F.explode(F.transform(inner, lambda k: c("_cy") * 4 + k))).drop("_n"))
        size /= 4
    found = reduce(DataFrame.unionByName, hits).groupBy(*identity).agg(F.min("_b").alias("_b"))
    return found.select(*identity, "_b.region_id", "_b.dist")
