"""Geometry as plain column expressions.

A line is ``parts ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>``; a polygon is ``rings`` of the same
type, shells and holes alike (a point is inside if a ray from it meets the rings an odd number of
times). Everything here works inside one row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
PARTS = f"array<{LINE}>"


def point(x, y) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def line(*coordinates) -> Column:
    """A one-part line from ``(x, y)`` pairs of columns or numbers."""
    return F.array(F.array(*[point(x, y) for x, y in coordinates]))


def box(x0, y0, x1, y1) -> Column:
    """Closed ring of an axis-aligned box."""
    return line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def ring_segments(vertices: Column) -> Column:
    """Consecutive vertex pairs of one vertex array, as ``ARRAY<STRUCT<a, b>>``."""
    count = F.size(vertices)
    heads = F.slice(vertices, F.lit(1), F.greatest(count - 1, F.lit(0)))
    tails = F.slice(vertices, F.lit(2), F.greatest(count - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def flat_segments(parts: Column) -> Column:
    """All segments of all parts in one array."""
    return F.flatten(F.transform(parts, ring_segments))


def line_length(parts: Column) -> Column:
    return F.aggregate(
        flat_segments(parts), F.lit(0.0),
        lambda acc, s: acc + distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def bounds(parts: Column) -> Column:
    """Bounding box struct ``x0, y0, x1, y1``."""
    xs = F.transform(F.flatten(parts), lambda p: p["x"])
    ys = F.transform(F.flatten(parts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the signed area of (a, b, p): positive left of a->b, zero on its carrier."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def on_segment(ax, ay, bx, by, px, py) -> Column:
    return ((side(ax, ay, bx, by, px, py) == 0)
            & px.between(F.least(ax, bx), F.greatest(ax, bx))
            & py.between(F.least(ay, by), F.greatest(ay, by)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _on_edges(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda s: on_segment(
        s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], x, y))


def _odd_edges(edges: Column, x: Column, y: Column) -> Column:
    def hit(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        spans = (ay > y) != (by > y)
        # dividing by the height only where the edge spans the ray keeps the division defined
        at = ax + (bx - ax) * F.try_divide(y - ay, by - ay)
        return spans & (x < at)
    hits = F.aggregate(edges, F.lit(0),
                       lambda acc, s: acc + F.when(hit(s), 1).otherwise(0))
    return hits % 2 == 1


def on_border(rings: Column, x: Column, y: Column) -> Column:
    return _on_edges(flat_segments(rings), x, y)


def crosses_odd(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does a ray towards +x meet the rings an odd number of times?"""
    return _odd_edges(flat_segments(rings), x, y)


def covers_point(rings: Column, x: Column, y: Column) -> Column:
    """Inside or on the border."""
    return bound(flat_segments(rings), lambda edges: _on_edges(edges, x, y) | _odd_edges(edges, x, y))


def strictly_inside(rings: Column, x: Column, y: Column) -> Column:
    return bound(flat_segments(rings), lambda edges: ~_on_edges(edges, x, y) & _odd_edges(edges, x, y))


def cut_positions(ax, ay, bx, by, cx, cy, ex, ey) -> Column:
    """Positions (0..1) on a->b where it meets c-e: one, or the ends of a common piece on one carrier."""
    dx, dy = bx - ax, by - ay

    def position(px, py):
        # the longer axis gives the position with the smaller rounding error
        return F.when(F.abs(dx) >= F.abs(dy), F.try_divide(px - ax, dx)).otherwise(
            F.try_divide(py - ay, dy))

    cross = dx * (ey - cy) - dy * (ex - cx)
    t = F.try_divide((cx - ax) * (ey - cy) - (cy - ay) * (ex - cx), cross)
    u = F.try_divide((cx - ax) * dy - (cy - ay) * dx, cross)
    single = F.when(t.between(0, 1) & u.between(0, 1), F.array(t))
    parallel = F.filter(
        F.array(F.when(on_segment(ax, ay, bx, by, cx, cy), position(cx, cy)),
                F.when(on_segment(ax, ay, bx, by, ex, ey), position(ex, ey))),
        lambda v: v.isNotNull())
    return F.coalesce(F.when(cross == 0, parallel).otherwise(single), F.array().cast("array<double>"))


def _edge_cuts(edges: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    inner = F.flatten(F.transform(edges, lambda s: cut_positions(
        ax, ay, bx, by, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
    return F.array_sort(F.array_distinct(
        F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))


def segment_cuts(rings: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Sorted positions (0..1) at which segment a->b meets the edges of ``rings``, with 0 and 1."""
    return _edge_cuts(flat_segments(rings), ax, ay, bx, by)


def _pieces_all(edges: Column, ax, ay, bx, by, test) -> Column:
    """Does ``test`` hold at the middle of every piece of a->b between its cuts with the edges?"""
    def middles(cuts: Column) -> Column:
        count = F.size(cuts)
        return F.zip_with(F.slice(cuts, F.lit(1), count - 1), F.slice(cuts, F.lit(2), count - 1),
                          lambda s, e: (s + e) / 2)
    places = F.transform(bound(_edge_cuts(edges, ax, ay, bx, by), middles), lambda t: F.struct(
        (ax + (bx - ax) * t).alias("x"), (ay + (by - ay) * t).alias("y")))
    return F.forall(places, lambda p: test(p["x"], p["y"]))


def covers_segment(rings: Column, ax, ay, bx, by) -> Column:
    """The whole segment lies in the closed polygon."""
    def covered(edges: Column) -> Column:
        inside = lambda x, y: _on_edges(edges, x, y) | _odd_edges(edges, x, y)
        return inside(ax, ay) & inside(bx, by) & _pieces_all(edges, ax, ay, bx, by, inside)
    return bound(flat_segments(rings), covered)


def contains_line(rings: Column, parts: Column) -> Column:
    """The line lies in the closed polygon and some of it lies inside, not just on the border."""
    segments = flat_segments(parts)

    def covered(s):
        return covers_segment(rings, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])

    def on_edge(s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        return bound(flat_segments(rings), lambda edges: _pieces_all(
            edges, ax, ay, bx, by, lambda x, y: _on_edges(edges, x, y)))

    return F.forall(segments, covered) & F.exists(segments, lambda s: ~on_edge(s))


def segments_meet(ax, ay, bx, by, cx, cy, ex, ey) -> Column:
    """Closed segments a-b and c-e share a point."""
    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, ex, ey)
    s3, s4 = side(cx, cy, ex, ey, ax, ay), side(cx, cy, ex, ey, bx, by)
    proper = (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0)
    touch = (on_segment(ax, ay, bx, by, cx, cy) | on_segment(ax, ay, bx, by, ex, ey)
             | on_segment(cx, cy, ex, ey, ax, ay) | on_segment(cx, cy, ex, ey, bx, by))
    return proper | touch


def polygons_meet(rings: Column, other: Column) -> Column:
    """Two closed polygons (or a polygon and a line) share a point."""
    def first(r):
        return F.element_at(F.element_at(r, 1), 1)
    edges = F.exists(flat_segments(rings), lambda s: F.exists(
        flat_segments(other), lambda t: segments_meet(
            s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"],
            t["a"]["x"], t["a"]["y"], t["b"]["x"], t["b"]["y"])))
    return (edges | covers_point(rings, first(other)["x"], first(other)["y"])
            | covers_point(other, first(rings)["x"], first(rings)["y"]))


def projection(ax, ay, bx, by, px, py) -> Column:
    """Foot of p on segment a-b: struct ``t`` (0..1), ``x``, ``y``, ``dist``."""
    dx, dy = bx - ax, by - ay
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
        F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))

    def foot(t: Column) -> Column:
        # the ends are returned bit by bit, not interpolated
        x = F.when(t == 0, ax).when(t == 1, bx).otherwise(ax + dx * t)
        y = F.when(t == 0, ay).when(t == 1, by).otherwise(ay + dy * t)
        return F.struct(t.alias("t"), x.alias("x"), y.alias("y"))

    def measured(f: Column) -> Column:
        return F.struct(f["t"].alias("t"), f["x"].alias("x"), f["y"].alias("y"),
                        distance(f["x"], f["y"], px, py).alias("dist"))
    # bound step by step, so that the expression does not multiply
    return F.element_at(F.transform(F.transform(F.array(along), foot), measured), 1)


def crossing(ax, ay, bx, by, cx, cy, ex, ey) -> Column:
    """The single common point of two segments that are not parallel, else NULL.

    A common point that is an end of either segment is returned with exactly that end's
    coordinates, so both streets get the same node.
    """
    def solved(k: Column) -> Column:
        p, q, r, w = ((k[f"{n}x"], k[f"{n}y"]) for n in "abce")
        cross = (q[0] - p[0]) * (w[1] - r[1]) - (q[1] - p[1]) * (w[0] - r[0])
        t = F.try_divide((r[0] - p[0]) * (w[1] - r[1]) - (r[1] - p[1]) * (w[0] - r[0]), cross)
        u = F.try_divide((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0]), cross)
        return F.when(cross != 0, F.coalesce(
            F.when(on_segment(*r, *w, *p), point(*p)), F.when(on_segment(*r, *w, *q), point(*q)),
            F.when(on_segment(*p, *q, *r), point(*r)), F.when(on_segment(*p, *q, *w), point(*w)),
            F.when(t.between(0, 1) & u.between(0, 1),
                   point(p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))))

    # evaluated as one unit outside the generated loop over candidate pairs, which stays small
    # enough to be compiled
    corners = F.struct(*[v.alias(n) for n, v in zip(
        ("ax", "ay", "bx", "by", "cx", "cy", "ex", "ey"), (ax, ay, bx, by, cx, cy, ex, ey))])
    return F.element_at(F.transform(F.array(corners), solved), 1)


def ring_moment(ring: Column) -> Column:
    """Signed area and first moments of one ring by the shoelace sum."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        w = ax * by - bx * ay
        return F.struct((acc["area"] + w / 2).alias("area"),
                        (acc["mx"] + (ax + bx) * w / 6).alias("mx"),
                        (acc["my"] + (ay + by) * w / 6).alias("my"))
    return F.aggregate(ring_segments(ring), zero, add)


def hull_chain(points: Column) -> Column:
    """Convex hull of a sorted (x, y) array as a closed counter-clockwise ring (monotone chain)."""
    def half(ordered: Column) -> Column:
        def push(stack: Column, p: Column) -> Column:
            # drop from the end every vertex that the new point makes a right turn or straight
            keep = F.aggregate(
                F.sequence(F.size(stack), F.lit(1), F.lit(-1)),
                F.size(stack),
                lambda n, i: F.when(
                    (n == i) & (n >= 2)
                    & (side(F.get(stack, n - 2)["x"], F.get(stack, n - 2)["y"],
                            F.get(stack, n - 1)["x"], F.get(stack, n - 1)["y"],
                            p["x"], p["y"]) <= 0), n - 1).otherwise(n))
            kept = F.when(F.size(stack) < 2, stack).otherwise(F.slice(stack, F.lit(1), keep))
            return F.concat(kept, F.array(p))
        return F.aggregate(ordered, F.array().cast(LINE), push)

    lower, upper = half(points), half(F.reverse(points))
    ring = F.concat(F.slice(lower, F.lit(1), F.size(lower) - 1), upper)
    return F.when(F.size(points) < 2, points).otherwise(ring)
