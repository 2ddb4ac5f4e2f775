"""Spatial joins as equi-joins on grid cells.

* :func:`grid_join` pairs short things (street segments, points with a radius) on one uniform
  grid. Cells whose candidate count is too large are subdivided; those that stay crowded are spread
  over tasks, so no cell lands in one task.
* :func:`box_join` pairs bounding boxes of any size (points, polygons). Every box is filed on a
  grid of its own size class, at most four cells each, so one huge polygon does not explode into
  millions of cells; each pair is found in exactly one cell.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.scale import cut_lineage

#: Candidate pairs of a cell in one task, about; more are subdivided or spread.
CELL_PAIRS = 4_000_000
#: Subdivisions after which things count as lying at one point.
_MAX_DEPTH = 12

Cover = Callable[[DataFrame, float], DataFrame]


def _cell(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def segment_cover(ax: str, ay: str, bx: str, by: str, halo: float = 0.0) -> Cover:
    """Cells within ``halo`` of a segment: per grid column, the rows its part of the segment reaches.

    The total number of cells is linear in the total length over the cell size.
    """
    def cover(rows: DataFrame, size: float) -> DataFrame:
        x0, x1 = F.least(ax, bx), F.greatest(ax, bx)
        slack = 1e-9 * size + halo
        columns = rows.withColumn("_cx", F.explode(F.sequence(
            _cell(x0 - slack, size), _cell(x1 + slack, size))))
        # the part of the segment over this column, kept inside the segment itself
        left = F.least(x1, F.greatest(x0, F.col("_cx") * size - slack))
        right = F.greatest(x0, F.least(x1, (F.col("_cx") + 1) * size + slack))
        dx = F.col(bx) - F.col(ax)

        def height(x: Column) -> Column:
            return F.col(ay) + (F.col(by) - F.col(ay)) * (x - F.col(ax)) / dx

        low = F.when(dx == 0, F.least(ay, by)).otherwise(F.least(height(left), height(right)))
        high = F.when(dx == 0, F.greatest(ay, by)).otherwise(F.greatest(height(left), height(right)))
        # rounding of the interpolation grows with the coordinates, so widen by a relative slack
        fuzz = F.lit(slack) + F.greatest(F.abs(ay), F.abs(by)) * 1e-12
        return columns.withColumn("_cy", F.explode(F.sequence(
            _cell(low - fuzz, size), _cell(high + fuzz, size))))
    return cover


def radius_cover(x: str, y: str, radius: float) -> Cover:
    """Cells within ``radius`` of a point along both axes."""
    def cover(rows: DataFrame, size: float) -> DataFrame:
        reach = radius + 1e-9 * size
        return (rows.withColumn("_cx", F.explode(F.sequence(
                    _cell(F.col(x) - reach, size), _cell(F.col(x) + reach, size))))
                .withColumn("_cy", F.explode(F.sequence(
                    _cell(F.col(y) - reach, size), _cell(F.col(y) + reach, size)))))
    return cover


def grid_size(rows: DataFrame, span: Column, radius: float = 0.0) -> float:
    """Cell size from the mean span, never below four search radii."""
    mean = rows.agg(F.avg(span).alias("m")).first()["m"]
    return max(float(mean or 0.0), 4.0 * radius, 1e-6)


def grid_join(left: DataFrame, right: DataFrame, cover_left: Cover, cover_right: Cover,
              size: float, condition: Column, radius: float = 0.0,
              cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """All pairs that satisfy ``condition`` and share a cell; a pair may appear once per cell.

    A crowded cell is subdivided while that can help. One that stays crowded (many things at one point, or within the
    radius) is spread: its left rows are dealt into parts by their hash, each of which meets all its right rows.
    """
    cell = ["_cx", "_cy"]
    found = []
    lefts, rights = cover_left(left, size), cover_right(right, size)
    depth = 0
    while True:
        counts = (lefts.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nl"))
                  .join(rights.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nr")), cell))
        parts = F.least(F.ceil(F.col("_nl") * F.col("_nr") / cell_pairs), F.col("_nl")).cast("int")
        crowded = cut_lineage(counts.filter(F.col("_nl") * F.col("_nr") > cell_pairs).select(*cell, parts.alias("_parts")))
        if crowded.isEmpty():
            found.append(lefts.join(rights, cell).filter(condition).drop(*cell))
            break
        cells = crowded.select(*cell)
        found.append(lefts.join(cells, cell, "left_anti").join(rights.join(cells, cell, "left_anti"), cell)
                     .filter(condition).drop(*cell))
        if depth == _MAX_DEPTH or size < 8 * radius:
            dealt = lefts.join(crowded, cell).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int"))
            every = rights.join(crowded, cell).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            found.append(dealt.drop("_parts").join(every.drop("_parts"), [*cell, "_part"]).filter(condition).drop(*cell, "_part"))
            break
        finer = size / 4

        def descend(rows: DataFrame, cover: Cover) -> DataFrame:
            kept = (rows.join(cells, cell, "left_semi")
                    .withColumnsRenamed({"_cx": "_px", "_cy": "_py"}))
            return (cover(kept, finer)
                    .filter((F.floor(F.col("_cx") / 4) == F.col("_px"))
                            & (F.floor(F.col("_cy") / 4) == F.col("_py")))
                    .drop("_px", "_py"))

        lefts, rights = descend(lefts, cover_left), descend(rights, cover_right)
        size, depth = finer, depth + 1
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def with_box(rows: DataFrame, prefix: str, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Attach a bounding box (and its size classes) for :func:`box_join`."""
    def size_class(extent: Column) -> Column:
        # smallest power of four that is at least the extent; zero extents share one fine class
        return F.when(extent <= 0, F.lit(-20)).otherwise(
            F.greatest(F.lit(-20), F.ceil(F.log(4.0, extent)).cast("int")))
    return rows.withColumns({
        f"{prefix}x0": x0, f"{prefix}y0": y0, f"{prefix}x1": x1, f"{prefix}y1": y1,
        f"{prefix}lx": size_class(x1 - x0), f"{prefix}ly": size_class(y1 - y0)})


def box_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs whose boxes (``_l*`` on the left, ``_r*`` on the right) meet and satisfy ``condition``.

    The number of size classes is at most the logarithm of the largest box over the smallest, so
    the class list on the driver is tiny whatever the data.
    """
    def classes(rows: DataFrame, prefix: str) -> list[tuple[int, int]]:
        found = rows.select(f"{prefix}lx", f"{prefix}ly").distinct().collect()
        return sorted((int(r[0]), int(r[1])) for r in found)

    def filed(rows: DataFrame, own: str, other: str, others: list[tuple[int, int]]) -> DataFrame:
        options = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in others])
        rows = rows.withColumn("_other", F.explode(options))
        lx = F.greatest(F.col(f"{own}lx"), F.col("_other.x"))
        ly = F.greatest(F.col(f"{own}ly"), F.col("_other.y"))
        wx, wy = F.pow(F.lit(4.0), lx), F.pow(F.lit(4.0), ly)
        return (rows.withColumns({
            f"_{other}x": F.col("_other.x"), f"_{other}y": F.col("_other.y"),
            f"_{own}x": F.col(f"{own}lx"), f"_{own}y": F.col(f"{own}ly"),
            "_cx": F.explode(F.sequence(_cell(F.col(f"{own}x0"), wx), _cell(F.col(f"{own}x1"), wx))),
        }).withColumn("_cy", F.explode(F.sequence(
            _cell(F.col(f"{own}y0"), wy), _cell(F.col(f"{own}y1"), wy)))).drop("_other"))

    left_classes, right_classes = classes(left, "_l"), classes(right, "_r")
    if not left_classes or not right_classes:
        left_classes, right_classes = left_classes or [(0, 0)], right_classes or [(0, 0)]
    key = ["__lx", "__ly", "__rx", "__ry", "_cx", "_cy"]
    pairs = filed(left, "_l", "_r", right_classes).join(
        filed(right, "_r", "_l", left_classes), key)
    wx = F.pow(F.lit(4.0), F.greatest("_llx", "_rlx"))
    wy = F.pow(F.lit(4.0), F.greatest("_lly", "_rly"))
    corner_x, corner_y = F.greatest("_lx0", "_rx0"), F.greatest("_ly0", "_ry0")
    met = ((corner_x <= F.least("_lx1", "_rx1")) & (corner_y <= F.least("_ly1", "_ry1"))
           & (_cell(corner_x, wx) == F.col("_cx")) & (_cell(corner_y, wy) == F.col("_cy")))
    extra = [f"_{s}{c}" for s in "lr" for c in ("x0", "y0", "x1", "y1", "lx", "ly")]
    return pairs.filter(met & condition).drop(*key, *extra)


