"""Street cleaning on hand-made lines, each as single-part and as multi-part geometry."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from regionflow import scale
from regionflow.errors import DataError
from regionflow.functions import geometry as geo
from regionflow.operators import graph, network, streets
from regionflow.operators.spatial import box_join, grid_join, radius_cover, segment_cover, with_box
from regionflow.plans.build import prepare_streets

SCHEMA = f"fid string, value double, multi boolean, parts {geo.PARTS}"


def lines(spark, rows, multi=False):
    return spark.createDataFrame([(i, v, multi, [[tuple(map(float, p)) for p in pts]]) for i, v, pts in rows], SCHEMA)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 1 else r[1] for r in df.select("fid", *columns).collect()}


CASES = {
    "t_junction": ([("A", 100.0, [(0, 0), (100, 0)]), ("B", 50.0, [(40, 10), (40, 0)])],
                   {"100A": 40.0, "200A": 60.0, "B": 50.0}),
    "mid_crossing": ([("A", 100.0, [(0, 0), (100, 0)]), ("B", 80.0, [(50, -50), (50, 50)])],
                     {"100A": 50.0, "200A": 50.0, "100B": 40.0, "200B": 40.0}),
    "existing_vertex": ([("A", 100.0, [(0, 0), (40, 0), (100, 0)]), ("B", 50.0, [(40, 10), (40, 0)])],
                        {"100A": 40.0, "200A": 60.0, "B": 50.0}),
    "shared_endpoint": ([("A", 100.0, [(0, 0), (50, 0)]), ("B", 50.0, [(50, 0), (50, 50)])], {"A": 100.0, "B": 50.0}),
    "bend_only": ([("A", 100.0, [(0, 0), (50, 0), (50, 50)]), ("B", 50.0, [(200, 200), (300, 200)])],
                  {"A": 100.0, "B": 50.0}),
}


@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("name", CASES)
def test_divide(spark, name, multi):
    rows, expected = CASES[name]
    found = streets.divide_at_junctions(lines(spark, rows, multi), "fid", ["value"])
    assert by_id(found, "value") == pytest.approx(expected)
    assert {r.multi for r in found.select("multi").collect()} == {multi}
    if name == "t_junction":
        edges = network.build_edges(found, "fid", [])
        assert graph.connected_components(edges).select("component").distinct().count() == 1


def test_divide_with_hot_streets(spark, small_groups):
    posts = [(f"P{k:02d}", 1.0, [(k, -1), (k, 1)]) for k in range(1, 40)]
    found = streets.divide_at_junctions(lines(spark, [("A", 40.0, [(0, 0), (20.5, 0), (40, 0)])] + posts), "fid", ["value"])
    values = by_id(found, "value")
    assert {k: v for k, v in values.items() if k.endswith("A")} == pytest.approx({f"{k * 100}A": 1.0 for k in range(1, 41)})
    assert values["100P07"] == pytest.approx(0.5)


def test_true_multipart_gets_vertices_only(spark):
    rows = spark.createDataFrame([("A", 1.0, True, [[(0.0, 0.0), (10.0, 0.0)], [(0.0, 5.0), (10.0, 5.0)]]),
                                  ("B", 2.0, False, [[(4.0, -1.0), (4.0, 6.0)]])], SCHEMA)
    found = by_id(streets.divide_at_junctions(rows, "fid", ["value"]), "value", "parts")
    assert found["A"][0] == 1.0
    assert [[tuple(p) for p in part] for part in found["A"][1]] == [[(0, 0), (4, 0), (10, 0)], [(0, 5), (4, 5), (10, 5)]]
    assert {"100B", "200B", "300B"} <= set(found)


def test_near_touch_shares_the_vertex(spark):
    rows = lines(spark, [("A", 1.0, [(0, 0), (10, 0)]), ("B", 1.0, [(4, 1), (4, 4e-7)])])
    found = by_id(streets.divide_at_junctions(rows, "fid", []), "parts")
    assert tuple(found["100A"][0][-1]) == (4.0, 4e-7) == tuple(found["B"][0][-1])


def test_validation(spark):
    twice = lines(spark, [("A", 1.0, [(0, 0), (1, 0)]), ("A", 1.0, [(0, 1), (1, 1)])])
    with pytest.raises(DataError, match="repeated_id"):
        streets.validate_streets(twice, "fid")
    with pytest.raises(DataError, match="CRS"):
        prepare_streets(twice, "fid", None, 25832)
    with pytest.raises(DataError, match="does not exist"):
        streets.validate_streets(twice, "id")


def test_lineage(spark):
    rows = prepare_streets(lines(spark, CASES["t_junction"][0]), "fid", 25832, 25832, divide=True)
    assert by_id(rows, "source_street_id", "source_share") == {
        "100A": ("A", 0.4), "200A": ("A", 0.6), "B": ("B", 1.0)}


def test_gap_of_facing_dead_ends_closes_once(spark):
    rows = lines(spark, [("A", 1.0, [(0, 0), (10, 0)]), ("B", 1.0, [(12, -5), (12, 5)]), ("C", 1.0, [(12.5, 20), (30, 20)])])
    found = by_id(streets.close_gaps(rows, 5.0, "fid"), "value", "parts")
    assert set(found) == {"A", "B", "C", "000B"}
    assert found["000B"][0] is None
    assert [tuple(p) for p in found["000B"][1][0]] == [(10, 0), (12, 0)]
    assert [tuple(p) for p in found["B"][1][0]] == [(12, -5), (12, 0), (12, 5)]


def test_patches(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "b", 5.0)], "row_index int, k string, v double")
    found = streets.patch_table(rows, [{"column": "v", "where": "k", "equals": "b", "add": 10.0}])
    assert [r.v for r in found.orderBy("row_index").collect()] == [1.0, 12.0, 12.0]
    with pytest.raises(DataError, match="no row"):
        streets.patch_table(rows, [{"column": "v", "where": "k", "equals": "z", "add": 1.0}])
    with pytest.raises(DataError, match="exactly one"):
        streets.patch_table(rows, [{"column": "v", "where": "k", "equals": "b"}])


def test_grid_join_subdivides_crowded_cells(spark):
    rng = random.Random(3)
    dense = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)]
    spread = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150, 200)]
    points = dense + spread
    segs = [(f"s{i}", x, y, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for i, x, y in points]
    p = spark.createDataFrame(points, "pid int, px double, py double")
    s = spark.createDataFrame(segs, "sid string, ax double, ay double, bx double, by double")
    c = F.col
    close = geo.projection(c("ax"), c("ay"), c("bx"), c("by"), c("px"), c("py"))["dist"] <= 0.2

    def pairs(cell_pairs):
        found = grid_join(p, s, radius_cover("px", "py", 0.2), segment_cover("ax", "ay", "bx", "by"), 20.0, close,
                          radius=0.2, cell_pairs=cell_pairs)
        return {(r.pid, r.sid) for r in found.collect()}

    def gap(px, py, ax, ay, bx, by):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d))
        return ((ax + t * (bx - ax) - px) ** 2 + (ay + t * (by - ay) - py) ** 2) ** 0.5
    truth = {(i, n) for i, x, y in points for n, *e in segs if gap(x, y, *e) <= 0.2}
    assert pairs(50) == truth == pairs(10 ** 9)


def test_grid_join_spreads_a_point_that_all_share(spark):
    """A cell that no subdivision thins out still gives each of its pairs."""
    p = spark.range(90).select(F.col("id").alias("pid"), F.lit(5.0).alias("px"), F.lit(5.0).alias("py"))
    s = spark.range(70).select(F.col("id").alias("sid"), F.lit(5.0).alias("ax"), F.lit(5.0).alias("ay"),
                               F.lit(5.0).alias("bx"), F.lit(5.0).alias("by"))
    found = grid_join(p, s, radius_cover("px", "py", 0.2), segment_cover("ax", "ay", "bx", "by"), 20.0,
                      F.col("pid") >= 0, radius=0.2, cell_pairs=50)
    assert found.select("pid", "sid").distinct().count() == 90 * 70


def test_box_join_finds_each_pair_once(spark):
    rng = random.Random(5)
    def boxes(n, first):
        rows = []
        for i in range(n):
            x, y, w, h = rng.uniform(-20, 20), rng.uniform(-20, 20), 10 ** rng.uniform(-2, 1.5), 10 ** rng.uniform(-2, 1.5)
            rows.append((first + i, x, y, x + (0 if i % 7 == 0 else w), y + (0 if i % 7 == 0 else h)))
        return rows
    left, right = boxes(120, 0), boxes(60, 1000) + [(2000, -1e6, -1e6, 1e6, 1e6)]
    c = F.col
    def frame(rows, key, side):
        df = spark.createDataFrame(rows, f"{key} int, x0 double, y0 double, x1 double, y1 double")
        return with_box(df, side, c("x0"), c("y0"), c("x1"), c("y1")).drop("x0", "y0", "x1", "y1")
    found = [tuple(r) for r in box_join(frame(left, "a", "_l"), frame(right, "b", "_r"), F.lit(True)).select("a", "b").collect()]
    truth = {(a[0], b[0]) for a, b in itertools.product(left, right)
             if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(found) == len(set(found)) and set(found) == truth


def test_hull_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(streets, "_HULL_CHUNK", 8)
    rng = random.Random(7)
    pts = [(k, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for k in (1, 2) for _ in range(150)]
    hulls = streets.convex_hull(spark.createDataFrame(pts, "k int, x double, y double"), "k")
    for row in hulls.collect():
        own = {(x, y) for k, x, y in pts if k == row.k}
        ring = [tuple(p) for p in row.rings[0]]
        assert ring[0] == ring[-1]
        for a, b in zip(ring, ring[1:]):
            sides = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in own]
            assert min(sides) >= 0
            assert all(s > 0 or q in (a, b) or (min(a[0], b[0]) <= q[0] <= max(a[0], b[0])) for s, q in zip(sides, own))


def test_nearest_region_far_and_near(spark, monkeypatch):
    monkeypatch.setattr(streets, "_LEAF_NODES", 4)
    rng = random.Random(11)
    nodes = [(rng.randint(0, 5), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(200)] + [(9, 500.0, 500.0)]
    pts = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(40)]
    found = streets.nearest_region(spark.createDataFrame(pts, "point_id int, px double, py double"),
                                   spark.createDataFrame(nodes, "region_id int, x double, y double"))
    truth = {i: min(((x - px) ** 2 + (y - py) ** 2, r) for r, x, y in nodes)[1] for i, px, py in pts}
    assert {r.point_id: r.region_id for r in found.collect()} == truth


@pytest.mark.parametrize("points", [[0.0, 0.9, 1.8], [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 9.0, 9.0, 9.5, 11.0]])
def test_dedupe_keeps_by_the_last_kept_point(spark, points):
    """A chain of near points must not collapse to its first."""
    rows = [(street, 0, at, at, 0.0) for street in ("A", "B") for at in points]
    found = streets.dedupe_points(spark.createDataFrame(rows, "id string, part int, at double, x double, y double"), 1.0)
    kept, last = [], -9.0
    for at in points:
        if at > last + 1.0:
            kept.append(at)
            last = at
    assert sorted(map(tuple, found.select("id", "at").collect())) == sorted((s, at) for s in ("A", "B") for at in kept)


def test_dedupe_sorts_as_many_rows_per_task_at_any_size(spark, monkeypatch):
    """More points mean more tasks, and streets of ordinary size are shuffled and sorted once; runs cross batches."""
    rng = random.Random(4)
    rows = [(f"S{n % 7}", n % 2, round(rng.uniform(0, 900), 1), float(n), 0.0) for n in range(6_000)]
    points = spark.createDataFrame(rows, "id string, part int, at double, x double, y double")
    monkeypatch.setattr(scale, "TASK_ROWS", 600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = streets.dedupe_points(points, 1.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan.count("Exchange") == 1 and "Window" not in plan and found.rdd.getNumPartitions() == 10
    want, last = [], {}
    for row in sorted(rows):
        if row[2] > last.get(row[:2], -9.0) + 1.0:
            last[row[:2]] = row[2]
            want.append(row)
    assert got == want


def test_dedupe_of_hot_streets(spark, small_groups):
    """Streets above the limit are scanned by runs, with the same rows."""
    rng = random.Random(5)
    rows = [(f"S{n % 3}", 0, round(rng.uniform(0, 90), 1), float(n), 0.0) for n in range(200)]
    found = streets.dedupe_points(spark.createDataFrame(rows, "id string, part int, at double, x double, y double"), 1.0)
    want, last = [], {}
    for row in sorted(rows):
        if row[2] > last.get(row[0], -9.0) + 1.0:
            last[row[0]] = row[2]
            want.append(row)
    assert sorted(map(tuple, found.collect())) == want


def test_dedupe_of_a_long_chain(spark):
    """One run over many batches of one task."""
    rows = spark.range(30_000).select(F.lit("A").alias("id"), F.lit(0).alias("part"), (F.col("id") * 0.25).alias("at"),
                                      F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    found = streets.dedupe_points(rows, 1.0)
    assert found.count() == 6_000 and found.agg(F.max("at")).first()[0] == 7498.75


def test_a_street_of_very_many_vertices(spark):
    """Segments and positions of one long line in seconds, with starts summed in order."""
    n = 100_000
    line = spark.range(1).select(F.lit("A").alias("fid"), F.array(F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct((k * 0.5).alias("x"), (k % 2).cast("double").alias("y")))).alias("parts"))
    found = streets.segments(line, "fid").agg(F.count(F.lit(1)), F.max("start"), F.max("part_length")).first()
    step = (0.25 + 1) ** 0.5
    assert found[0] == n and found[1] == pytest.approx((n - 1) * step) and found[2] == pytest.approx(n * step)
    ends = streets.vertices_along(line, "fid").agg(F.count(F.lit(1)), F.max("at")).first()
    assert ends[0] == n + 1 and ends[1] == found[2]
