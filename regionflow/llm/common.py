"""What several operators of this package share: stored tables, tokenizer files, heavy keys.

Heavy keys. One digest, source or shingle may hold a third of all rows. ``heavy_keys`` finds every
key above a share of the rows with the engine's frequent-items sketch (a Misra-Gries summary that
merges across tasks), so a caller can treat those few keys without a shuffle by key.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Items that the frequent-items sketch tracks; it finds every key above about 1 / (0.75 * this) of the rows.
SKETCH_ITEMS = 65_536
#: The most keys that may be treated as heavy: the bound of every broadcast made from them.
HEAVY_KEYS = 4_096
#: Share of the rows from which a key counts as heavy.
HEAVY_SHARE = 0.0005


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="regionflow-llm-")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read back: its lineage ends there."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def finished(df: DataFrame) -> DataFrame:
    """``df`` after the driver has let go of the steps before it, so that their shuffle files are removed now.

    Spark removes them when the driver's garbage collection finds their plans unused, which on a calm driver is late.
    """
    import gc
    import time
    for _ in range(2):  # what the first round lets go of may hold the last step's plan
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return df


def whole_text(column: str | Column) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def digest(column: Column) -> Column:
    """SHA-256 of a text as 32 bytes."""
    return F.unhex(F.sha2(column.cast("binary"), 256))


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file; called where the file is read, so that each machine finds its own copy."""
    import public_tokenizers
    return public_tokenizers.path(name)


def model_version(path: str) -> str:
    """Digest of a tokenizer's file: counts stored for another file never apply."""
    import hashlib
    from pathlib import Path
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def heavy_keys(rows: DataFrame, key: str, least_share: float = HEAVY_SHARE) -> DataFrame:
    """Keys (as text) that may hold ``least_share`` of the rows or more; at most ``HEAVY_KEYS`` rows.

    The sketch never underestimates a key by more than its error, so each key above the share is found;
    callers verify what they use by exact counts.
    """
    top = rows.agg(F.count(F.lit(1)).alias("_n"),
                   F.expr(f"approx_top_k(CAST({key} AS STRING), {HEAVY_KEYS}, {SKETCH_ITEMS})").alias("_top"))
    return (top.select("_n", F.explode("_top").alias("_t"))
            .filter(F.col("_t.count") >= F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(least_share))))
            .select(F.col("_t.item").alias(key)))


def attach_by_digest(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Join one row per digest (``found``) to all stored ``rows`` with that digest.

    Rows of heavy digests meet a broadcast of at most ``HEAVY_KEYS`` rows where they stand; others are shuffled.
    """
    heavy = F.broadcast(stored(heavy_keys(rows.select(F.hex(key).alias(key)), key)).select(F.unhex(key).alias(key)))
    hot = F.broadcast(found.join(heavy, key, "left_semi"))
    return (rows.join(heavy, key, "left_semi").join(hot, key)
            .unionByName(rows.join(heavy, key, "left_anti").join(found, key)))


#: Bytes of text that a task turns into Python strings at once (a longer text is taken alone).
SLICE_BYTES = 2_000_000


def text_slices(column, most: int = SLICE_BYTES):
    """``start, texts`` of consecutive parts of an Arrow text column with about ``most`` bytes each; NULL as empty.

    Only one part exists as Python strings at a time, however many rows a batch has and however long they are.
    """
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, [text or "" for text in column.slice(begin, end - begin).to_pylist()]
        begin = end


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by their places, so that no name of theirs clashes with a helper column."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place_of(docs: DataFrame, name: str) -> int:
    """Place of a column; the one exactly so written if names differ in case only."""
    names = docs.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def column_of(docs: DataFrame, name: str) -> Column:
    """A column of ``numbered(docs)`` by its name in ``docs``."""
    return F.col(f"c{place_of(docs, name)}")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``row`` beside key columns made with :func:`column_of`."""
    return numbered(docs).select(F.struct("*").alias("row"), *[key.alias(name) for name, key in keys.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that :func:`packed` made, as they were."""
    return rows.select("row.*").toDF(*docs.columns)


def not_null_id(column: Column) -> Column:
    """An id as text that is never NULL; NULL has a value of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
