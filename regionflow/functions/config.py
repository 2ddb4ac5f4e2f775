"""Small configured records as DataFrames or as an exploded product."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Configured record lists up to this length carry a broadcast hint; longer ones are planned freely.
BROADCAST_RECORDS = 10_000


def config_frame(spark: SparkSession, records: list, schema: str) -> DataFrame:
    """Records held in memory (so their number is known) as a DataFrame."""
    frame = spark.createDataFrame(records, schema)
    return F.broadcast(frame) if len(records) <= BROADCAST_RECORDS else frame


def record_literals(records: list[tuple], schema: str) -> Column:
    """The records as one array-of-struct literal."""
    fields = StructType.fromDDL(schema)
    return F.array(*[
        F.struct(*[F.lit(value).cast(field.dataType).alias(field.name)
                   for value, field in zip(record, fields)])
        for record in records])


def times(rows: DataFrame, records: list[tuple], schema: str) -> DataFrame:
    """Every row once per configured record, with the record's fields as columns."""
    names = StructType.fromDDL(schema).names
    return (rows.withColumn("_record", F.explode(record_literals(records, schema)))
            .select(*rows.columns, *[F.col(f"_record.{n}").alias(n) for n in names]))
