"""The solver's tables and the result queries read their base rows once."""
from pyspark.sql import functions as F

from regionflow.operators import results as op
from regionflow.queries import results as queries
from regionflow.scale import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def test_subprocess_ids(spark):
    """One id per subprocess, and names are joined to subprocesses, not to results."""
    tables = queries.solver_tables(spark, FOLDER)
    subs, found = tables["conversion_subprocess"], tables["output_cs_y"]
    n = queries.outputs(spark, FOLDER).select("cp", "cin", "cout").distinct().count()
    assert subs.count() == subs.select("id").distinct().count() == n == found.select("cs_id").distinct().count()
    rows = op.subprocess_outputs(tables)
    assert rows.count() == found.count() and rows.filter("cp is null or cin is null or cout is null").count() == 0
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    last = next(k for k, line in enumerate(lines) if "Join" in line)
    assert "cs_id" in lines[last]  # the results meet the named subprocesses last, in one join of large tables


def test_the_base_rows_are_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(queries, "cut_lineage", lambda rows, *more, **options: stored.append(rows.columns) or cut_lineage(rows, *more, **options))
    for query in (queries.grid_overview, queries.report_tables):
        stored.clear()
        query(spark, FOLDER)
        assert sum("l_partkey" in columns for columns in stored) == 1 and len(stored) == 3  # base, outputs, assets


def test_stored_assets_are_narrow(spark, monkeypatch):
    """Columns that follow from the brand are not written."""
    stored = []
    monkeypatch.setattr(queries, "cut_lineage", lambda rows, *more, **options: stored.append(rows.columns) or cut_lineage(rows, *more, **options))
    base = queries._base(spark, FOLDER)
    rows = queries.assets(spark, FOLDER, base)
    assert stored[1:] == [["brand", "region"]]
    assert rows.count() == rows.distinct().count() == base.select("brand", "region").distinct().count()


def test_a_report_makes_its_groups_once(spark):
    """Sorting and counting read stored rows; neither makes the joins of a group again."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "b")], "k int, technology string")
    group = rows.join(spark.createDataFrame([(1, 2020), (2, 2010)], "k int, year int"), "k")
    totals = spark.createDataFrame([(1.0, 2.0, 3.0)], "opex double, capex double, totex double")
    emissions = spark.createDataFrame([(2020, 5.0)], "year int, amount double")
    found = op.report_tables({"grids": group}, totals, emissions, "kW", {})
    assert [r["technology"] for r in found["grids"].collect()] == ["b", "a", "b"]
    assert found["counts"].collect() == [("grids", 3)]
    for name in ("grids", "counts"):
        assert "Join" not in found[name]._jdf.queryExecution().optimizedPlan().toString()


def test_compact_tables(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.lit("the same text in every row").alias("a.b"))
    assert sorted(cut_lineage(rows, compact=True).collect()) == sorted(rows.collect())
