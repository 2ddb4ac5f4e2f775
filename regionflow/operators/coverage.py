"""Which polygons cover which points: polygon edges as rows on a grid, sides by parity.

No polygon is held as one value. Edges are filed in the grid cells that they touch. For every row of corners of the
grid, the edges that cross it say between which corners a polygon's inside lies; such runs are filed as blocks of
powers of two, so a corner finds them by a few equi-joins, however wide the polygon. A point takes the side of its
cell's lower left corner and changes it with every edge crossed on the way, first up, then right; those edges lie in
its cell. Points on an edge are told apart by an exact test against the edges of the cell.

All tests are signs of the same expression; a point on an edge's carrier counts as above it, and grid lines lie at odd
places, so ways through vertices and along horizontal edges need no special case.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.operators.spatial import grid_join, segment_cover
from regionflow.scale import cut_lineage

c = F.col

#: Share of a cell by which the grid is shifted, so that its lines seldom meet coordinates of the data.
_SHIFT_X, _SHIFT_Y = 0.3819660112501051, 0.2763932022500210


def ring_edges(polygons: DataFrame, *keys: str, rings: str = "rings") -> DataFrame:
    """Edges ``ax, ay, bx, by`` of all rings, the lower end first; edges without length are left out."""
    ends = polygons.select(*keys, F.explode(geo.flat_segments(c(rings))).alias("_s")).select(
        *keys, F.struct(c("_s.a.y").alias("y"), c("_s.a.x").alias("x")).alias("p"),
        F.struct(c("_s.b.y").alias("y"), c("_s.b.x").alias("x")).alias("q"))
    return _upward(ends.filter(c("p") != c("q")), keys)


def _upward(ends: DataFrame, keys) -> DataFrame:
    low, high = F.least("p", "q"), F.greatest("p", "q")
    return ends.select(*keys, low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"))


def clipped(rows: DataFrame, box) -> DataFrame:
    """Segments that may meet ``box`` (``x0, y0, x1, y1``), with their part in it as ``sax, say, sbx, sby``."""
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")

    def span(at: Column, along: Column, low: float, high: float):
        """Positions (0..1) where the segment enters and leaves ``low..high``; NULL ends if it lies apart."""
        one, two = F.try_divide(F.lit(low) - at, along), F.try_divide(F.lit(high) - at, along)
        apart = (along == 0) & ~at.between(low, high)
        return (F.when(~apart, F.coalesce(F.least(one, two), F.lit(0.0))),
                F.when(~apart, F.coalesce(F.greatest(one, two), F.lit(1.0))))

    (x_in, x_out), (y_in, y_out) = span(c("ax"), dx, box[0], box[2]), span(c("ay"), dy, box[1], box[3])
    begin, end = F.greatest(F.lit(0.0), x_in, y_in), F.least(F.lit(1.0), x_out, y_out)
    cut = rows.withColumns({"_t0": F.when(x_in.isNotNull() & y_in.isNotNull(), begin), "_t1": end}).filter("_t0 <= _t1")

    def at(t: str, start: str, along: Column) -> Column:
        return F.when(c(t) == 0, c(start)).otherwise(c(start) + along * c(t))

    return cut.withColumns({"sax": at("_t0", "ax", dx), "say": at("_t0", "ay", dy), "sbx": at("_t1", "ax", dx),
                            "sby": at("_t1", "ay", dy)}).drop("_t0", "_t1")


def _left(x: Column, y: Column) -> Column:
    """Whether a point lies left of the (upward) edge; on its carrier, whether the place just above does."""
    s = geo.side(c("ax"), c("ay"), c("bx"), c("by"), x, y)
    return (s > 0) | ((s == 0) & (c("bx") > c("ax")))


def _above(x: Column, y: Column) -> Column:
    """Whether a point lies above an edge that is not upright."""
    return _left(x, y) == (c("bx") > c("ax"))


def _spans_row(y: Column) -> Column:
    return (c("ay") <= y) & (y < c("by"))


def covered_points(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``_pid, key, inside`` for points that lie in or on the polygon of a key; ``inside`` is false on its border.

    ``points``: ``_pid`` (one row each), ``x, y``; ``edges`` as made by :func:`ring_edges`, closed for each key by the
    even-odd rule. Points with a NULL coordinate lie nowhere.
    """
    points = points.select("_pid", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL")
    box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    empty = points.join(edges.select(key).limit(0), F.lit(True)).select("_pid", key, F.lit(True).alias("inside")).limit(0)
    if box[0] is None:
        return empty
    x0, y0, x1, y1 = map(float, box)
    size = clipped(edges, (x0, y0, x1, y1)).agg(
        F.avg(F.greatest(F.abs(c("sbx") - c("sax")), F.abs(c("sby") - c("say"))))).first()[0]
    # without an edge in the box all points lie alike, so one cell will do
    size = max(float(size or 0.0), (x1 - x0) * 1e-6, (y1 - y0) * 1e-6, 1e-9) if size is not None else max(x1 - x0, y1 - y0, 1.0)
    # corners of the points' cells may lie outside the points' box
    near = edges.filter((c("by") >= y0 - 2 * size) & (c("ay") <= y1 + 2 * size))
    here = clipped(near, (x0 - 2 * size, y0 - 2 * size, x1 + 2 * size, y1 + 2 * size))
    ox, oy = size * _SHIFT_X, size * _SHIFT_Y
    column = lambda x: F.floor((x + ox) / size).cast("long")
    row = lambda y: F.floor((y + oy) / size).cast("long")
    line_x, line_y = (lambda i: i * size - ox), (lambda j: j * size - oy)
    first_row, last_row = int((y0 + oy) // size) - 1, int((y1 + oy) // size) + 1
    first, last = int((x0 + ox) // size) - 1, int((x1 + ox) // size) + 1

    # The last corner left of each crossing of an edge with a row of corners; those outside the points' box are alike.
    crossed = near.withColumn("_j", F.explode(F.sequence(
        F.greatest(F.lit(first_row), row(c("ay"))), F.greatest(F.greatest(F.lit(first_row), row(c("ay"))),
                                                               F.least(F.lit(last_row), row(c("by")) + 1)))))
    crossed = crossed.filter(_spans_row(line_y(c("_j"))) & c("_j").between(first_row, last_row))
    guess = column(c("ax") + (c("bx") - c("ax")) * F.try_divide(line_y(c("_j")) - c("ay"), c("by") - c("ay")))
    crossed = crossed.withColumn("_i", F.greatest(F.lit(first - 2), F.least(F.lit(last + 2), guess)))
    left_at = lambda i: _left(line_x(i), line_y(c("_j")))
    # the estimate may be rounded over a line; the corners' own signs decide
    crossed = crossed.withColumn("_i", F.when(~left_at(c("_i")) & (c("_i") > first - 2), c("_i") - 1)
                                 .when(left_at(c("_i") + 1) & (c("_i") < last + 2), c("_i") + 1).otherwise(c("_i")))
    order = Window.partitionBy(key, "_j").orderBy("_i")
    runs = (crossed.select(key, "_j", "_i", F.lead("_i").over(order).alias("_to"), F.row_number().over(order).alias("_n"))
            .filter("_n % 2 = 1 AND _to > _i").select(key, "_j", (c("_i") + 1 - first + 2).alias("lo"),
                                                      (c("_to") + 1 - first + 2).alias("hi")))
    # Blocks of 2^k corners that make up each run, the usual two at most per size.
    levels = max(1, (last - first + 6).bit_length())
    power = lambda k: F.pow(F.lit(2.0), k).cast("long")
    by_level = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    by_level = by_level.withColumns({"_l": F.ceil(c("lo") / power(c("_k"))).cast("long"),
                                     "_r": F.floor(c("hi") / power(c("_k"))).cast("long")}).filter("_l < _r")
    blocks = by_level.select(key, "_j", "_k", F.explode(F.array_compact(F.array(
        F.when(c("_l") % 2 == 1, c("_l")), F.when(c("_r") % 2 == 1, c("_r") - 1)))).alias("_b"))
    placed = points.withColumns({"_cx": column(c("x")), "_cy": row(c("y"))})
    asked = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        "_pid", c("_cy").alias("_j"), "_k",
        F.floor((c("_cx") - first + 2) / power(c("_k"))).cast("long").alias("_b"))
    corners = asked.join(blocks, ["_j", "_k", "_b"]).select("_pid", key, F.lit(1).alias("flips"), F.lit(False).alias("border"))

    # Edges met on the way from the corner to the point.
    shifted = here.withColumns({"sax": c("sax") + ox, "say": c("say") + oy, "sbx": c("sbx") + ox, "sby": c("sby") + oy})
    reach = max(map(abs, (x0, y0, x1, y1))) * 1e-12
    filed = segment_cover("sax", "say", "sbx", "sby", halo=reach)(shifted, size).select(
        key, "ax", "ay", "bx", "by", "_cx", "_cy")
    qx, qy = line_x(c("_cx")), line_y(c("_cy"))
    up = ((c("ax") <= qx) != (c("bx") <= qx)) & (_above(qx, qy) != _above(qx, c("y")))
    right = _spans_row(c("y")) & (_left(qx, c("y")) != _left(c("x"), c("y")))
    met = placed.join(filed, ["_cx", "_cy"]).select(
        "_pid", key, (up.cast("int") + right.cast("int")).alias("flips"),
        geo.on_segment(c("ax"), c("ay"), c("bx"), c("by"), c("x"), c("y")).alias("border"))
    sides = (corners.unionByName(met.filter("flips > 0 OR border")).groupBy("_pid", key)
             .agg(F.sum("flips").alias("flips"), F.max("border").alias("border")))
    return sides.filter("border OR flips % 2 = 1").select("_pid", key, (~c("border")).alias("inside"))


def identified(rows: DataFrame, name: str = "_pid") -> DataFrame:
    """``rows`` with a number of their own that stays the same when they are read again."""
    return cut_lineage(rows.withColumn(name, F.monotonically_increasing_id()))


def _box_of(segments: DataFrame):
    box = segments.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")),
                       F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).first()
    return None if box[0] is None else tuple(map(float, box))


def meeting(segments: DataFrame, edges: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Pairs of segments (``ids``, ends) and edges (``key``, ends) that share a point; a pair may appear twice.

    Columns: ``ids``, ends, ``key`` and the edge's ends as ``cx, cy, ex, ey``.
    """
    box = _box_of(segments)
    other = edges.select(key, *[c(a).alias(b) for a, b in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "ex", "ey"))])
    if box is None:
        return segments.join(other.limit(0), F.lit(True))
    mine = clipped(segments, box)
    theirs = clipped(edges, box).select(
        key, *[c(a).alias(b) for a, b in zip(("ax", "ay", "bx", "by", "sax", "say", "sbx", "sby"),
                                             ("cx", "cy", "ex", "ey", "tax", "tay", "tbx", "tby"))])
    size = mine.agg(F.avg(F.greatest(F.abs(c("sbx") - c("sax")), F.abs(c("sby") - c("say"))))).first()[0]
    reach = max(map(abs, box)) * 1e-12
    condition = geo.segments_meet(*map(c, ("ax", "ay", "bx", "by", "cx", "cy", "ex", "ey")))
    return grid_join(mine, theirs, segment_cover("sax", "say", "sbx", "sby", halo=reach),
                     segment_cover("tax", "tay", "tbx", "tby", halo=reach), max(float(size or 0.0), 1e-6), condition
                     ).select(*ids, "ax", "ay", "bx", "by", key, "cx", "cy", "ex", "ey")


def piece_middles(segments: DataFrame, edges: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Middles ``ids, x, y`` of the pieces into which ``edges`` cut the segments; one without length is its own middle."""
    cuts = meeting(segments, edges, ids, key).select(*ids, "ax", "ay", "bx", "by", F.explode(geo.cut_positions(
        *map(c, ("ax", "ay", "bx", "by", "cx", "cy", "ex", "ey")))).alias("t")).filter("t > 0 AND t < 1")
    begins = segments.select(*ids, "ax", "ay", "bx", "by", F.lit(0.0).alias("t"))
    order = Window.partitionBy(*ids).orderBy("t")
    middle = (c("t") + F.coalesce(F.lead("t").over(order), F.lit(1.0))) / 2
    return begins.unionByName(cuts).distinct().withColumn("_m", middle).select(
        *ids, (c("ax") + (c("bx") - c("ax")) * c("_m")).alias("x"), (c("ay") + (c("by") - c("ay")) * c("_m")).alias("y"))


def polygons_containing(lines: DataFrame, edges: DataFrame, line: str, key: str) -> DataFrame:
    """``line, key``: the whole line lies in the closed polygon, and some of it inside, not just on the border.

    ``lines``: ``line, n`` (a segment's number) and ends. Every piece between two cuts lies on one side, so its middle
    decides; a line is contained by the polygons that cover all its middles.
    """
    middles = identified(piece_middles(lines, edges, [line, "n"], key))
    sides = covered_points(middles, edges, key).join(middles.select("_pid", line), "_pid")
    covered = sides.groupBy(line, key).agg(F.count(F.lit(1)).alias("_covered"), F.max("inside").alias("_inside"))
    whole = middles.groupBy(line).agg(F.count(F.lit(1)).alias("_pieces"))
    return covered.join(whole, line).filter("_inside AND _covered = _pieces").select(line, key)


def polygons_meeting(first: DataFrame, second: DataFrame, a: str, b: str, rings_a: str = "rings",
                     rings_b: str = "rings") -> DataFrame:
    """Distinct pairs ``a, b`` of closed polygons (or lines, in ``first``) that share a point.

    Two that share no border point do so only if one lies in the other, and then a ring's first vertex does.
    """
    edges_a, edges_b = cut_lineage(ring_edges(first, a, rings=rings_a)), cut_lineage(ring_edges(second, b, rings=rings_b))

    def starts(polygons, key, rings):
        return identified(polygons.select(key, F.explode(rings).alias("_r")).select(
            key, F.element_at("_r", 1)["x"].alias("x"), F.element_at("_r", 1)["y"].alias("y")))

    starts_a, starts_b = starts(first, a, rings_a), starts(second, b, rings_b)
    return (meeting(edges_a, edges_b, [a], b).select(a, b)
            .unionByName(covered_points(starts_a, edges_b, b).join(starts_a, "_pid").select(a, b))
            .unionByName(covered_points(starts_b, edges_a, a).join(starts_b, "_pid").select(a, b)).distinct())
