"""Ordered computations must not depend on whether a key counts as hot; formats must be exact."""
import random

import pytest
from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.functions.text import colour_of, general_format, two_places
from regionflow.operators import energy, streets
from regionflow.scale import attach, cut_lineage, dense_index, running, with_totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, rng.randint(0, 30), rng.randint(0, 9)) for k in (1, 1, 1, 2) for _ in range(60)] + [(3, 1, 1)]
    return spark.createDataFrame(data, "k int, o int, v int").repartition(5)


def outcome(rows):
    found = running(rows, ["k"], ["o", "v"], number="n", sums={"s": "v"}, previous={"p": "o"}, following={"f": "o"})
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def test_hot_and_plain_agree(spark, rows):
    plain = outcome(rows)
    spark.conf.set("regionflow.group.limit", "5")
    try:
        assert outcome(rows) == plain
    finally:
        spark.conf.unset("regionflow.group.limit")
    assert len(plain) == rows.count()


def test_totals_and_attach_keep_every_row(spark, rows):
    found = with_totals(rows, ["k"], t=F.sum("v"))
    assert found.count() == rows.count()
    sums = {r.k: r.t for r in rows.groupBy("k").agg(F.sum("v").alias("t")).collect()}
    assert all(r.t == sums[r.k] for r in found.collect())
    lookup = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    assert attach(rows, lookup, ["k"]).filter("name is null").count() == 1
    assert attach(rows, lookup, ["k"], "inner").count() == rows.count() - 1


def test_dense_index(spark):
    names = spark.createDataFrame([(f"n{i * 37 % 101:03d}",) for i in range(101)], "name string").repartition(7)
    found = dense_index(names, "name", "i").collect()
    assert sorted((r.name, r.i) for r in found) == [(f"n{i:03d}", i) for i in range(101)]


def test_general_format(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 100.0, 1e5, 123456.0, 1e-5, 0.00012345, 99999.5, -2.5, 1 / 3, 1e22, 265645.0, 4217650.0, float("nan")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
    values += [(rng.randint(10 ** 5, 10 ** 6 - 1) * 10 + 5.0) * 10.0 ** rng.randint(-9, 3) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (5, 10):
        for r in frame.select("v", general_format(F.col("v"), digits).alias("t")).collect():
            expected = f"{r.v:.{digits}g}"
            assert r.t == ("0" if expected == "-0" else expected)
    for r in frame.filter("v < 1e9").select("v", two_places(F.col("v")).alias("t")).collect():
        assert r.v != r.v or r.t == round(r.v, 2)


def test_colour_is_the_digest_modulo_the_palette(spark):
    import hashlib
    from regionflow.functions.text import PALETTE
    names = ["gas", "heat_D1", "heat_D2_D3", "Help_chp_D4", ""]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", colour_of(F.col("n")).alias("c")).collect()
    for r in found:
        base = r.n.split("_D")[0]
        assert r.c == PALETTE[int(hashlib.md5(base.encode()).hexdigest(), 16) % 20]


def test_many_types_of_one_pair_of_commodities(spark):
    """Grids are reduced to one per pair of commodities before they meet the pipes: no product of both."""
    kinds = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "pipe").otherwise("grid").alias("kind"), F.col("id").alias("ord"),
        F.col("id").cast("string").alias("name"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("commodity_in"),
        F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("commodity_out"))
    found = energy.pipe_to_grid(kinds)
    assert {r.grid for r in found.collect()} == {"1"} and found.count() == 200
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan.split("Join", 1)[1]


def test_cut_lineage_forgets_guessed_sizes(spark):
    """Rows joined to themselves in rounds keep the size of their files, not a guess squared each round."""
    rows = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit("x").alias("a.b c"))
    for _ in range(8):
        ends = rows.select(F.col("a").alias("b"), F.col("b").alias("end"))
        rows = cut_lineage(rows.join(ends, "b").select("a", F.col("end").alias("b"), "`a.b c`"))
    assert rows.columns == ["a", "b", "a.b c"] and rows.count() == 10
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


def test_close_gaps_knows_the_size_of_its_streets(spark, monkeypatch):
    """Streets made by few source rows are not guessed to be few: what is guessed small is broadcast."""
    copies = spark.range(40).select(F.explode(F.sequence(F.col("id") * 50, F.col("id") * 50 + 49)).alias("k"))
    streets_of = copies.select(F.col("k").cast("string").alias("fid"), F.lit(1.0).alias("value"), geo.line(
        (F.lit(0.0), F.col("k") * 100.0), (F.lit(50.0), F.col("k") * 100.0)).alias("parts"))
    seen, edges = [], streets.street_edges

    def recorded(rows, id_column):
        seen.append(int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return edges(rows, id_column)

    monkeypatch.setattr(streets, "street_edges", recorded)
    assert streets.close_gaps(streets_of, 5.0, "fid").count() == 2000
    assert min(seen) >= 2000 * 32
