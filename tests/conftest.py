import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="regionflow-"))
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def small_groups(spark):
    """Treat every key with more than five rows as hot."""
    spark.conf.set("regionflow.group.limit", "5")
    yield
    spark.conf.unset("regionflow.group.limit")
