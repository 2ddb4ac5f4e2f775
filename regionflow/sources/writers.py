"""Writers: profiles, model-input tables, solutions; and the series a model refers to."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.text import general_format
from regionflow.scale import attach, cut_lineage

c = F.col


def profile_texts(profiles: DataFrame, hashes: DataFrame, names: DataFrame) -> DataFrame:
    """``name, text``: each distinct named profile once, 10 significant digits, space separated.

    One series per profile (the smallest) is written; a series has at most the hours of a year.
    """
    one = hashes.groupBy("profile_hash").agg(F.min("series").alias("series"))
    chosen = one.join(names, "profile_hash").select("series", c("profile_name").alias("name"))
    values = attach(profiles, chosen, ["series"], "inner")
    text = F.transform(F.array_sort(F.collect_list(F.struct("hour", "value"))),
                       lambda e: F.coalesce(general_format(e["value"], 10), F.lit("nan")))
    return values.groupBy("name").agg(F.array_join(text, " ").alias("text"))


def write_profiles(profiles: DataFrame, hashes: DataFrame, names: DataFrame, folder: str) -> None:
    """One folder ``name=<profile>`` of text per profile; what was in ``folder`` is replaced."""
    profile_texts(profiles, hashes, names).write.mode("overwrite").partitionBy("name").text(folder)


def resolve_static_series(referenced: DataFrame, generated: DataFrame, available: DataFrame) -> DataFrame:
    """Values of referenced series that are not generated; each must be available.

    ``referenced(name)``, ``generated(name)``, ``available(name, hour, value)``.
    """
    wanted = cut_lineage(referenced.select("name").filter(c("name").isNotNull()).distinct()
                         .join(generated.select("name"), "name", "left_anti"))
    missing = missing_series(wanted, available).limit(20).collect()
    if missing:
        raise DataError(f"timeseries not found: {[r.name for r in missing]}")
    return available.join(wanted, "name", "left_semi")


def missing_series(wanted: DataFrame, available: DataFrame) -> DataFrame:
    return wanted.join(available.select("name").distinct(), "name", "left_anti")


def select_time_steps(rows: DataFrame, steps: DataFrame, name: str) -> DataFrame:
    """Rows whose ``hour`` belongs to the named time-step set."""
    return rows.join(steps.filter(c("name") == name).select("hour"), "hour", "left_semi")


def write_techmap(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_techmap(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def solution_name(system: str, scenario: str) -> str:
    return f"{system}_{scenario}"


def save_solution(tables: dict[str, DataFrame], folder: str, system: str, scenario: str) -> str:
    """One Parquet folder per result table below ``<system>_<scenario>``; returns that path."""
    target = f"{folder}/{solution_name(system, scenario)}"
    write_techmap(tables, target)
    return target


def load_solution(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return read_techmap(spark, path, names)


def select_boundaries(features: DataFrame, codes: list[str], column: str = "code") -> DataFrame:
    """Features whose code starts with one of the codes; blanks in the codes are ignored.

    Dissolve the result with :func:`regionflow.operators.streets.dissolve`.
    """
    cleaned = [code.replace(" ", "").strip() for code in codes]
    pattern = "^(" + "|".join(cleaned) + ")"
    return features.filter(c(column).rlike(pattern))
