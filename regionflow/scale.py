"""Helpers that keep plans safe when one key holds a large part of all rows.

Three situations recur in every operator and are solved here once:

* a per-key aggregate must be attached back to the rows of its key (:func:`attach`,
  :func:`with_totals`): the aggregate itself is partially combined before its shuffle, and the
  join back carries a second key so that both inputs get their own exchange, which is what the
  adaptive skew-join rule needs to split a hot key over many tasks;
* an ordered computation inside a key (:func:`running`): keys of ordinary size use a plain
  window; when a count shows that a key is larger than the limit, rows are range-partitioned by
  (key, order), each range is scanned on its own and the ranges are stitched with per-range
  totals, so no task ever holds a whole hot key;
* iterations (:func:`cut_lineage`): lineage is cut by a table written to the folder the
  cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read, not the job.

No join is forced to broadcast: the adaptive planner broadcasts a side when its measured size
allows it.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key above which an ordered computation is split into ranges.
GROUP_LIMIT_CONF = "regionflow.group.limit"
GROUP_LIMIT_DEFAULT = 1_000_000

#: Rows that one task sorts on its own, on average.
TASK_ROWS = 500_000

_SALTS = 2
_STORED = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}
_COMPACT = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def _conf(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    value = spark.conf.get(key, None)
    if value is None:
        value = spark.sparkContext.getConf().get(key)
    return default if value is None else value


def cut_lineage(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write ``df`` as a table to the shared folder and return a DataFrame that reads it back.

    A table has the size of its files. A checkpoint would keep the size its plan was guessed to have, which a loop
    that joins its rows to themselves squares each round, until the guess alone takes the planner minutes.
    ``compact`` compresses the files, for tables that are written and read as a whole.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or _conf(spark, "spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="regionflow-")
    place = f"{folder}/{uuid.uuid4().hex}"
    # places instead of names: any name may be a column's
    named = [f"c{k}" for k in range(len(df.columns))]
    rows = df.toDF(*named)
    # plain files are as large as their rows, so that the planner broadcasts only what is small; short row groups
    # let several tasks read what one wrote
    rows.write.options(**(_COMPACT if compact else _STORED)).parquet(place)
    return spark.read.schema(rows.schema).parquet(place).toDF(*df.columns)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt evenly over tasks, for work that is heavy per row: a small file may be one task's input.

    The number of parts is given, so that the adaptive planner does not merge them again for being small.
    """
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) without binding a hot key to one task."""
    salted_rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    salted_lookup = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def with_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Add per-key aggregates to every row; NULL keys form a group of their own."""
    aggregates = [expr.alias(name) for name, expr in totals.items()]
    return attach(rows, rows.groupBy(*keys).agg(*aggregates), keys)


def group_limit(spark: SparkSession) -> int:
    return int(_conf(spark, GROUP_LIMIT_CONF, str(GROUP_LIMIT_DEFAULT)))


def has_hot_group(rows: DataFrame, keys: list[str]) -> bool:
    """True if some key has more rows than the limit (one partially combined count)."""
    limit = group_limit(rows.sparkSession)
    return not rows.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def group_sizes(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Number of all rows and of those of the largest key (one partially combined count)."""
    found = rows.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return found[0] or 0, found[1] or 0


def deal(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``total`` rows dealt over tasks by ``keys``, the more tasks the more rows: a task sorts about as many at any size."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-total // TASK_ROWS)), *keys)


def running(rows: DataFrame, keys: list[str], order: list[str], *,
            number: str | None = None,
            sums: dict[str, str] | None = None,
            previous: dict[str, str] | None = None,
            following: dict[str, str] | None = None,
            hot: bool | None = None) -> DataFrame:
    """Ordered per-key columns: 1-based position, running sums (inclusive), previous and next values.

    ``order`` must order the rows of a key totally up to exact copies. ``sums``, ``previous`` and
    ``following`` map new column names to source columns. Keys must not be NULL. ``hot`` is the
    answer of :func:`has_hot_group` if the caller has asked already.
    """
    sums, previous, following = sums or {}, previous or {}, following or {}

    def scan(frame: DataFrame, partition: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*partition).orderBy(*order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {}
        if number:
            columns[number] = F.row_number().over(ordered).cast("long")
        for name, source in sums.items():
            columns[name] = F.sum(source).over(upto)
        for name, source in previous.items():
            columns[name] = F.lag(source).over(ordered)
        for name, source in following.items():
            columns[name] = F.lead(source).over(ordered)
        return frame.withColumns(columns)

    if not (has_hot_group(rows, keys) if hot is None else hot):
        return scan(rows, keys)

    # Range boundaries are sampled, so the ranged rows are stored before they are read twice.
    ranged = cut_lineage(
        rows.repartitionByRange(*keys, *order).withColumn("_w_range", F.spark_partition_id()))
    # The outer rows of a range, by the order itself; exact copies of them are interchangeable.
    def outer(pick, sources):
        return pick(F.struct(*sources) if sources else F.lit(0), F.struct(*order))

    per_range = ranged.groupBy(*keys, "_w_range").agg(
        F.count(F.lit(1)).alias("_w_rows"),
        outer(F.max_by, list(dict.fromkeys(previous.values()))).alias("_w_last"),
        outer(F.min_by, list(dict.fromkeys(following.values()))).alias("_w_head"),
        *[F.sum(source).alias(f"_w_total_{name}") for name, source in sums.items()])
    # At most one row per key and range: the window below is bounded by the range count.
    by_range = Window.partitionBy(*keys).orderBy("_w_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, "_w_range",
        F.coalesce(F.sum("_w_rows").over(before), F.lit(0)).alias("_w_offset"),
        F.lag("_w_last").over(by_range).alias("_w_before"),
        F.lead("_w_head").over(by_range).alias("_w_after"), "_w_rows",
        *[F.sum(f"_w_total_{name}").over(before).alias(f"_w_carry_{name}") for name in sums])
    local = scan(ranged, [*keys, "_w_range"])
    place = F.row_number().over(Window.partitionBy(*keys, "_w_range").orderBy(*order))
    local = local.withColumn("_w_place", place)
    joined = local.join(offsets, [*keys, "_w_range"])
    fixed = {}
    if number:
        fixed[number] = F.col(number) + F.col("_w_offset")
    for name in sums:
        fixed[name] = F.when(F.col(f"_w_carry_{name}").isNull(), F.col(name)).otherwise(
            F.coalesce(F.col(name), F.lit(0)) + F.col(f"_w_carry_{name}"))
    for name, source in previous.items():
        fixed[name] = F.when(F.col("_w_place") == 1, F.col(f"_w_before.{source}")).otherwise(F.col(name))
    for name, source in following.items():
        fixed[name] = F.when(F.col("_w_place") == F.col("_w_rows"), F.col(f"_w_after.{source}")).otherwise(F.col(name))
    return joined.withColumns(fixed).select(*rows.columns, *fixed)


def dense_index(names: DataFrame, column: str, index: str) -> DataFrame:
    """0-based position of each (distinct, non-null) value in sorted order, without a global window."""
    ranged = cut_lineage(
        names.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range, so this window is bounded by the number of partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return (ranged.withColumn(index, position.cast("long"))
            .join(offsets, "_range")
            .withColumn(index, F.col(index) + F.col("_offset"))
            .drop("_range", "_offset"))
