"""Several keys asked of one registry."""
from pyspark.sql import functions as F

from regionflow.operators import registry as op
from regionflow.queries import QUERIES
from regionflow.queries import registry as queries

FOLDER = "/root/testdata/sf0.001"


def test_regions_are_located_once_for_all_keys(spark, monkeypatch):
    """The regions' edges are stored and their coverage found once, whatever number of keys is asked."""
    covered, edges = [], []
    monkeypatch.setattr(op, "region_coverage", lambda *given, made=op.region_coverage: covered.append(1) or made(*given))
    monkeypatch.setattr(op, "cut_lineage", lambda rows, made=op.cut_lineage: edges.append("source_share" in rows.columns) or made(rows))
    found = QUERIES["check_registry"](spark, FOLDER)
    assert len(covered) == 1 and sum(edges) == 1
    assert found.filter("passed").count() > 0


def test_located_regions_see_later_datasets(spark):
    """A dataset registered after the regions were located is routed to all the same."""
    catalog = queries._registry(spark, FOLDER)
    located = catalog.located(queries._strip_regions(spark, FOLDER))
    assert catalog.located(located) is located
    before = catalog.query_all(located, "other").agg(F.max("value")).first()[0]
    catalog.register(op.ConstantDataset(keys=["other"], value=7.0, unit="MWh", priority=50))
    assert before == 3.0 and catalog.query_all(located, "other").agg(F.min("value")).first()[0] == 7.0
