"""Readers: delimited tables, GeoJSON, number series, databases, solver output."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regionflow.errors import DataError
from regionflow.functions import geometry as geo


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A delimited file with a header row; lazy. Give a schema: inferring one reads the data twice."""
    settings = {"header": True, **options}
    reader = spark.read.options(**settings)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


_POSITIONS = "array<double>"


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """GeoJSON features as ``geometry_type``, ``parts`` (lines), ``rings`` (polygons), ``x, y``
    (points) and the given properties (``name type, ...``).

    ``lines=True`` reads one feature per line, which splits over tasks; a single feature
    collection is read whole by one task, so large data should come as one feature per line.
    """
    # coordinates nest to a depth that depends on the type, so they are kept as text first
    feature = f"struct<geometry:struct<type:string,coordinates:string>,properties:struct<{_fields(properties)}>>"
    if lines:
        rows = spark.read.schema(StructType.fromDDL(
            f"geometry struct<type:string,coordinates:string>, properties struct<{_fields(properties)}>")).json(path)
    else:
        rows = (spark.read.option("multiLine", True)
                .schema(StructType.fromDDL(f"features array<{feature}>")).json(path)
                .select(F.inline("features")))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")

    def parsed(depth: int):
        return F.from_json(text, "array<" * depth + _POSITIONS + ">" * depth)

    def vertices(line):
        return F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    def many(lines_):
        return F.transform(lines_, vertices)
    # even-odd rings: the polygons of a multi-polygon may share one ring list
    parts = (F.when(kind == "LineString", F.array(vertices(parsed(1))))
             .when(kind == "MultiLineString", many(parsed(2))))
    rings = (F.when(kind == "Polygon", many(parsed(2)))
             .when(kind == "MultiPolygon", many(F.flatten(parsed(3)))))
    at = F.when(kind == "Point", F.from_json(text, _POSITIONS))
    return rows.select(
        kind.alias("geometry_type"), parts.cast(geo.PARTS).alias("parts"),
        (kind == "MultiLineString").alias("multi"), rings.cast(geo.PARTS).alias("rings"),
        at[0].alias("x"), at[1].alias("y"), "properties.*")


def _fields(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def read_series(spark: SparkSession, path: str, sep: str = r"\s+", name: str | None = None) -> DataFrame:
    """Files of numbers, row by row, as ``series, hour, value``; the position is the hour.

    Each file is one series (named after the file unless ``name`` is given) and has at most the
    hours of a year, so a file is one row before it is exploded. Text that is no number is NULL.
    """
    files = spark.read.text(path, wholetext=True).select(
        (F.lit(name) if name else F.regexp_extract(
            F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)).alias("series"),
        F.regexp_replace("value", r"^[\s]+|[\s]+$", "").alias("text"))
    splitter = f"(?:{sep}|[\r\n]+)+"
    return files.filter("text <> ''").select(
        "series", F.posexplode(F.split("text", splitter)).alias("hour", "_v")).select(
        "series", "hour", F.col("_v").try_cast("double").alias("value"))


def read_time_steps(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Time-step sets: files of hour numbers as ``name, hour``."""
    rows = read_series(spark, path, name=name)
    return rows.select(F.col("series").alias("name"), F.col("value").cast("int").alias("hour"))


def jdbc_options(url: str, sql: str, **options: str) -> dict[str, str]:
    return {"url": url, "query": sql, **options}


def read_jdbc(spark: SparkSession, options: dict[str, str], bounds: dict[str, float] | None = None,
              columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """One query for all regions on an external database.

    ``bounds`` (``x0, y0, x1, y1`` of all regions) becomes a filter on the coordinate columns that
    Spark pushes into the database; the exact region test is a spatial join afterwards. Split
    large tables with ``partitionColumn`` / ``lowerBound`` / ``upperBound`` / ``numPartitions``
    and ``dbtable`` instead of ``query``.
    """
    if not (options.get("query") or options.get("dbtable")):
        raise DataError("no SQL query given")
    rows = spark.read.format("jdbc").options(**options).load()
    if bounds is not None:
        x, y = (F.col(n) for n in columns)
        rows = rows.filter(x.between(bounds["x0"], bounds["x1"]) & y.between(bounds["y0"], bounds["y1"]))
    return rows


# The solver's output tables.
SOLVER_TABLES = {
    "output_cs_y": "cs_id long, y_id long, cap_active double, cap_new double, eouttot double, newly_installed_units double",
    "conversion_subprocess": "id long, cp_id long, cin_id long, cout_id long",
    "conversion_process": "id long, name string",
    "commodity": "id long, name string",
    "year": "id long, value int",
    "output_global": "opex double, capex double, totex double",
    "output_y": "y_id long, total_annual_co2_emission double",
}


def read_solver_output(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The solver's tables from Parquet folders of the same names; missing ones are empty.

    If one of the tables behind the process outputs is missing, all of them count as empty.
    """
    tables = {}
    for name, schema in SOLVER_TABLES.items():
        try:
            tables[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            tables[name] = spark.createDataFrame([], schema)
    return tables
