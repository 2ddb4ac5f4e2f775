"""Registry, topology, system and model tables end to end on a small town; sources and sinks."""
import json
import random

import pytest
from pyspark.sql import functions as F

from regionflow.errors import DataError, NoDatasetError
from regionflow.functions import geometry as geo
from regionflow.functions.projection import transform
from regionflow.operators import catalog, energy, network, techmap
from regionflow.operators import registry as reg
from regionflow.operators.registry import Registry
from regionflow.plans.build import SystemConfig, _profiles, build_system, build_topology, prepare_streets, system_tables
from regionflow.queries.energy import TYPES
from regionflow.sources import readers, writers

SCHEMA = f"fid string, waerme double, parts {geo.PARTS}"


def lines(spark, rows):
    return spark.createDataFrame([(i, v, [[tuple(map(float, p)) for p in pts]]) for i, v, pts in rows], SCHEMA)


def boxes(spark, rows):
    ring = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    return spark.createDataFrame([(i, ring(*map(float, b))) for i, b in rows], f"id int, rings {geo.PARTS}")


def test_polygon_regions(spark):
    rows = lines(spark, [("a", 1.0, [(1, 1), (4, 1)]), ("b", 1.0, [(6, 1), (9, 1)]), ("c", 1.0, [(4, 1), (6, 1)]),
                         ("border", 1.0, [(0, 0), (5, 0)])])
    found = network.assign_by_polygon(rows, boxes(spark, [(1, (0, 0, 5, 2)), (2, (5, 0, 10, 2))]), "fid", "id")
    assert {r.fid: r.region_id for r in found.collect()} == {"a": 1, "b": 2, "c": None, "border": None}
    with pytest.raises(DataError, match="multiple polygons"):
        network.assign_by_polygon(rows, boxes(spark, [(1, (0, 0, 5, 2)), (2, (0, 0, 10, 2))]), "fid", "id")


def nodes_at(spark, x0):
    return spark.createDataFrame([(1, float(x0), 0.0), (1, x0 + 10.0, 0.0)], "region_id int, x double, y double")


@pytest.mark.parametrize("x0,expected", [(0, 0), (45, 1), (100, 1)])
def test_routing(spark, x0, expected):
    catalog_ = Registry(spark, 25832)
    catalog_.register(reg.ConstantDataset(keys=["heat"], value=1.0, priority=20,
                                          scope=boxes(spark, [(0, (-1, -1, 50, 1))]).select("rings")))
    catalog_.register(reg.ConstantDataset(keys=["heat"], value=2.0))
    scopes = catalog_.scopes()
    pick = lambda c: reg.route(nodes_at(spark, x0), reg.region_coverage(nodes_at(spark, x0), scopes), c, scopes, "heat").first().dataset_id
    assert pick(catalog_.catalog()) == expected
    if x0 == 100:
        with pytest.raises(NoDatasetError):
            pick(catalog_.catalog().filter("dataset_id = 0"))


def test_units_and_values(spark):
    edges = spark.createDataFrame([(1, "A", 0.4), (1, "B", 1.0), (2, "A", 0.6), (3, "Z", 1.0)],
                                  "region_id int, source_street_id string, source_share double")
    values = reg.street_values(lines(spark, [("A", 100.0, [(0, 0), (1, 0)]), ("B", 50.0, [(0, 0), (1, 0)]),
                                             ("Z", None, [(0, 0), (1, 0)])]), "fid", ["waerme"])
    found = reg.street_value_by_region(edges, values)
    assert {r.region_id: r.value for r in found.collect()} == pytest.approx({1: 90.0, 2: 60.0, 3: 0.0})
    with pytest.raises(DataError, match="no unit"):
        reg.convert_unit(found, "value", None, "MWh")
    with pytest.raises(DataError, match="cannot convert"):
        reg.convert_unit(found, "value", "kW", "MWh")


def test_projection_control_points(spark):
    def at(lon, lat, code):
        x, y = transform(F.lit(lon), F.lit(lat), 4326, code)
        return spark.range(1).select(x.alias("x"), y.alias("y")).first()
    centre = at(9.0, 0.0, 25832)
    assert (centre.x, centre.y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    laea = at(10.0, 52.0, 3035)
    assert (laea.x, laea.y) == pytest.approx((4321000.0, 3210000.0), abs=1e-6)
    paper = at(5.0, 50.0, 3035)  # the worked example of the published LAEA definition
    assert (paper.x, paper.y) == pytest.approx((3962799.45, 2999718.85), abs=0.01)


CASES = [(None, 0.0, [(2025, 0.0), (2026, None)]), (100.0, 0.0, [(2025, 0.0), (2026, 100.0)]),
         (100.0, 30.0, [(2025, 30.0), (2026, 100.0)]),
         ({0: 100.0, 5: 200.0}, 0.0, [(2025, 0.0), (2026, 100.0), (2030, 200.0)]),
         ({5: 200.0}, 0.0, [(2025, 0.0), (2030, 200.0)]), ({0: 100.0, 1: 150.0}, 0.0, [(2025, 0.0), (2026, 150.0)])]


@pytest.mark.parametrize("limit,existing,expected", CASES)
def test_max_capacity(spark, limit, existing, expected):
    record = dict(TYPES[4], max_capacity=limit)
    asset = catalog.type_frame(spark, [record]).withColumn("existing_capacity", F.lit(existing))
    found = energy.max_capacity_trajectory(asset, 2025).first().capacity_limit
    assert [tuple(e) for e in found] == expected


def profile_case(spark, demands):
    rows = [(f"{d}{r}", h, float(v)) for r, d, p in demands for h, v in enumerate(p)]
    used = [(r, d, [x for _, x, _ in demands].index(d), f"{d}{r}") for r, d, _ in demands]
    profiles = energy.normalise_profile(spark.createDataFrame(rows, "series string, hour int, value double"))
    hashes = techmap.profile_hashes(profiles)
    frame = spark.createDataFrame(used, "region_id int, demand string, demand_ord int, series string")
    return profiles, hashes, techmap.profile_names(frame, hashes)


@pytest.mark.parametrize("demands,names", [
    ([(1, "heat", [1, 2, 3]), (2, "heat", [2, 4, 6])], {"heat"}),
    ([(1, "heat", [1, 2, 3]), (2, "heat", [3, 2, 1])], {"heat_1", "heat_2"}),
    ([(1, "heat", [1, 2, 3]), (1, "pool", [1, 2, 3])], {"heat"})])
def test_profile_names(spark, tmp_path, demands, names):
    profiles, hashes, found = profile_case(spark, demands)
    assert {r.profile_name for r in found.collect()} == names
    writers.write_profiles(profiles, hashes, found, str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").glob("name=*")} == {f"name={n}" for n in names}


def test_profile_digests_tell_series_apart(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.uniform(0, 9) for _ in range(500)]
    series = {"a": base, "b": list(base), "twice": [2 * v for v in base], "late": [*base[1:], base[0]], "short": base[:-1],
              "other": [*base[:-1], base[-1] + 1e-9], "null": [None, *base[1:]], "none": [None, None]}
    rows = [(n, h, v) for n, values in series.items() for h, v in enumerate(values)]
    rng.shuffle(rows)
    profiles = spark.createDataFrame(rows, "series string, hour int, value double").repartition(7)
    found = {r.series: r.profile_hash for r in techmap.profile_hashes(profiles).collect()}
    assert found["a"] == found["b"] == found["twice"] and len(set(found.values())) == len(series) - 2
    # with a digest that tells nothing apart but lengths, the comparison row by row still does
    monkeypatch.setattr(techmap.F, "xxhash64", lambda *columns: F.lit(1))
    blind = {r.series: r.profile_hash for r in techmap.profile_hashes(profiles).collect()}
    assert blind["a"] == blind["b"] == blind["twice"] and len(set(blind.values())) == len(series) - 2


def test_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1 2\n3 x\n")
    assert [(r.series, r.hour, r.value) for r in readers.read_series(spark, str(tmp_path / "s.txt")).orderBy("hour").collect()] \
        == [("s", 0, 1.0), ("s", 1, 2.0), ("s", 2, 3.0), ("s", 3, None)]
    (tmp_path / "t.csv").write_text("a;b\n1;x\n")
    assert readers.read_table(spark, str(tmp_path / "t.csv"), "a int, b string", sep=";").first().b == "x"
    feature = lambda kind, coordinates, name: {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates},
                                               "properties": {"name": name}}
    features = [feature("LineString", [[0, 0], [1.5, 2]], "l"), feature("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]], "p"),
                feature("MultiLineString", [[[0, 0], [1, 0]], [[2, 0], [3, 0]]], "m"), feature("Point", [4, 5], "q")]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, features)))
    for path, by_line in (("g.geojson", False), ("g.jsonl", True)):
        rows = {r.name: r for r in readers.read_geojson(spark, str(tmp_path / path), "name string", by_line).collect()}
        assert [tuple(p) for p in rows["l"].parts[0]] == [(0, 0), (1.5, 2)] and rows["p"].parts is None
        assert len(rows["p"].rings[0]) == 4 and len(rows["m"].parts) == 2 and rows["m"].multi
        assert (rows["q"].x, rows["q"].y) == (4.0, 5.0)
    tables = readers.read_solver_output(spark, str(tmp_path / "none"))
    assert tables["output_cs_y"].count() == 0
    with pytest.raises(DataError, match="not found"):
        writers.resolve_static_series(spark.createDataFrame([("z",)], "name string"), spark.createDataFrame([], "name string"),
                                      spark.createDataFrame([("y", 0, 1.0)], "name string, hour int, value double"))


def test_town_to_model_tables(spark, tmp_path):
    """Three regions on one road; the second split street belongs to two of them."""
    town = lines(spark, [("A", 100.0, [(1, 1), (9, 1)]), ("B", 50.0, [(5, 4), (5, 1)]), ("C", 80.0, [(9, 1), (13, 1)]),
                         ("D", 60.0, [(13, 1), (19, 1)]), ("E", None, [(40, 40), (41, 40)])])
    area = boxes(spark, [(1, (0, 0, 10, 5)), (2, (12, 0, 20, 5))])
    registry = Registry(spark, 25832)
    registry.register_streets(prepare_streets(town, "fid", 25832, 25832, divide=True, drop_isolated=["waerme"]))
    registry.register(reg.StreetValueDataset.from_columns(town, "fid", "waerme", keys=["demand"], unit="kWh"))
    registry.register(reg.TableDataset(keys=["profile"], payload=spark.createDataFrame([(0, 1.0), (1, 3.0)], "hour int, value double")))

    def mix(payload, regions, params):
        return regions.ids.select("region_id", F.inline(F.array(
            F.struct(F.lit("boiler").alias("technology"), F.lit(0.5).alias("share")),
            F.struct(F.lit("exchanger").alias("technology"), F.lit(0.5).alias("share")))))
    registry.register(reg.Dataset(keys=["shares"], query_function=mix))
    topology = build_topology(registry, area, "fid", polygon_id="id")
    assert {r.fid: r.region_id for r in topology.streets.collect()} == {"100A": 1, "200A": 1, "B": 1, "C": None, "D": 2}
    heat = catalog.DemandType("heat", "warmth", False, 0.0, value_key="demand", profile_key="profile", shares_key="shares",
                              default_supply="boiler")
    trade = [dict(kind="Import", commodity="gas", price=60.0), dict(kind="Import", commodity="power", price=90.0)]
    config = SystemConfig(locations={"heat_in": [1]}, capacities={"heat_in": {None: [("plant", 1.0)]}},
                          grid_factor={"heat_grid": 1.3}, connected_distance=50.0)
    types = [t for t in TYPES if t["name"] != "sewage"]
    system = build_system("town", registry, topology, [heat], types, trade, config)
    demand = {r.region_id: (r.value, r.peak) for r in system.demands.collect()}
    assert demand == {1: pytest.approx((0.15, 0.1125)), 2: pytest.approx((0.06, 0.045))}
    assets = {(r.name, r.region_id): r.existing_capacity for r in system.assets.collect()}
    half = {1: 0.5 * 112.5, 2: 0.5 * 45.0}
    own = {k: v / 0.97 * 1.3 for k, v in half.items()}
    assert assets["boiler", 1] == pytest.approx(half[1]) and assets["pump", 2] == 0.0
    pipe = own[2] / 0.88
    grid_1 = own[1] + pipe / 0.95
    assert assets["heat_grid", 2] == pytest.approx(own[2]) and assets["heat_grid", 1] == pytest.approx(grid_1)
    assert assets["plant", 1] == pytest.approx(grid_1 / 0.88) and assets["cogen", 1] == 0.0
    pipes = {(r.region_in, r.region_out): (r.length_km, r.existing_capacity) for r in system.pipes.collect()}
    assert pipes == {(1, 2): pytest.approx((0.004, pipe)), (2, 1): pytest.approx((0.004, 0.0))}

    sheets = system_tables(system, catalog.Scenario("base", 2025, 2035, 5, 1, "weeks"))
    rows = {(r.conversion_process_name, r.commodity_out): r for r in sheets["ConversionSubProcess"].collect()}
    assert rows["heat_D1", "Dummy"].min_eout == "[2025 0.00015;2030 0.00015;2035 0.00015]"
    assert rows["heat_D1", "Dummy"].output_profile == "heat" == rows["boiler_D1", "warmth_D1"].output_profile
    assert rows["heat_pipe_D1_D2", "heat_in_D2"].capex_cost_base == "0.0"
    assert rows["cogen_D1", "heat_in_D1"].in_frac_min == 0.48 and rows["ImportGas", "gas"].opex_cost_energy == "60.0"
    orders = sorted((r.order, r.commodity_name) for r in sheets["Commodity"].collect())
    assert [n for _, n in orders] == sorted({r.commodity_in for r in rows.values()})
    writers.write_techmap(sheets, str(tmp_path / "techmap"))
    again = writers.read_techmap(spark, str(tmp_path / "techmap"), list(sheets))
    assert again["ConversionSubProcess"].count() == len(rows)
    path = writers.save_solution({"assets": system.assets}, str(tmp_path), "town", "base")
    assert path.endswith("town_base") and writers.load_solution(spark, path, ["assets"])["assets"].count() == len(assets)


def test_profiles_are_answered_per_region(spark):
    """A profile with a query function is asked with the demand's parameters; one with rows is stored once."""
    edges = spark.createDataFrame([((0.0, 0.0), (1.0, 0.0), 1), ((5.0, 0.0), (6.0, 0.0), 2)],
                                  "u struct<x:double,y:double>, v struct<x:double,y:double>, region_id int")
    registry = Registry(spark, 25832)
    registry.register(reg.TableDataset(keys=["shared"], payload=spark.createDataFrame([(0, 1.0), (1, 3.0)], "hour int, value double")))

    def own(payload, regions, params):
        return regions.ids.select("region_id", F.posexplode(F.array(F.lit(1.0), F.col("region_id") * params["factor"])).alias(
            "hour", "value"))
    registry.register(reg.Dataset(keys=["own"], query_function=own))
    registry.register(reg.Dataset(keys=["nothing"]))
    demand = lambda name, key, **more: catalog.DemandType(name, "c", False, 0.0, profile_key=key, **more)
    profiles, series = _profiles(registry, reg.Regions(edges), [
        demand("a", "shared"), demand("b", "own", profile_params={"factor": 2.0}), demand("c", "shared")])
    named = {(r.region_id, r.demand): r.series for r in series.collect()}
    found = {}
    for r in profiles.collect():
        found.setdefault(r.series, []).append((r.hour, r.value))
    assert len(found) == 3 and named[1, "a"] == named[2, "a"] == named[2, "c"]
    assert sorted(found[named[1, "a"]]) == [(0, 1.0), (1, 3.0)]
    assert sorted(found[named[1, "b"]]) == [(0, 1.0), (1, 2.0)] and sorted(found[named[2, "b"]]) == [(0, 1.0), (1, 4.0)]
    with pytest.raises(DataError, match="neither rows"):
        _profiles(registry, reg.Regions(edges), [demand("d", "nothing")])


def test_wrong_configuration_is_refused(spark):
    with pytest.raises(DataError, match="efficiency"):
        catalog.check_catalog(catalog.type_frame(spark, [dict(TYPES[0], efficiency=0.0)]))
    with pytest.raises(DataError, match="sum to"):
        catalog.DemandType("d", "c", True, 0.0, default_supply=[("a", 0.5)]).default_mix()
    with pytest.raises(DataError, match="year 2030"):
        catalog.trade_frame(spark, [dict(kind="Import", commodity="gas", price={2030: 1.0})])
    with pytest.raises(TypeError):
        network.check_grouping({"one": {}})
    with pytest.raises(DataError, match="kW"):
        techmap.create_techmap(spark, catalog.Scenario("s", 1, 2, 1, 1, "t"), "MW", None)
