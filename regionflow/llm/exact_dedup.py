"""Exact duplicates with a heavy-hitter split.

Each row is reduced to the SHA-256 of its text with white space runs made one space. A Misra-Gries summary (the
engine's frequent-items sketch, merged over tasks) proposes frequent digests; one partially combined aggregation
over just those verifies their counts and winners; the bounded list of winners is broadcast, so rows of a heavy
group are decided where they stand. All other digests are shuffled once. Texts are read once and never shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import column_of, digest, heavy_keys, not_null_id, numbered, packed, stored, unpacked, whole_text


def normalised(text: Column) -> Column:
    """White space runs (space, tab to carriage return) as one space; NULL as empty."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``doc_id, keep_id, group_size, kept, digest`` per row of ``docs``.

    The smallest id of each group of equal texts stays. NULL texts equal empty ones. NULL ids never win against
    others; a group of only NULL ids keeps NULL. Of rows that repeat the smallest id exactly one is kept. Other
    columns are left out, whatever their names; an empty table gives an empty one.
    """
    keyed = stored(numbered(docs).select(column_of(docs, doc_id).alias("doc_id"),
                                         digest(normalised(column_of(docs, text))).alias("digest")))
    heavy = F.broadcast(stored(heavy_keys(keyed.select(F.hex("digest").alias("digest")), "digest"))
                        .select(F.unhex("digest").alias("digest")))
    # One row per heavy digest: verified winner and size.
    winners = F.broadcast(keyed.join(heavy, "digest", "left_semi").groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    same = Window.partitionBy("digest")
    rest = keyed.join(heavy, "digest", "left_anti").select(
        "doc_id", "digest", F.min("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"))
    rest = rest.withColumn("kept", F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())) == 1)
    hot = keyed.join(winners, "digest")
    won = hot.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows with the winner's id are one per digest unless ids repeat; then one of them is kept.
    won = won.withColumn("kept", F.row_number().over(same.orderBy("doc_id")) == 1)
    lost = hot.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    order = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return rest.select(order).unionByName(lost.select(order)).unionByName(won.select(order))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id and digest, so the texts cross the network once; of rows that repeat the smallest id
    with equal texts one stays. NULLs and empty tables as in :func:`exact_duplicates`.
    """
    stay = exact_duplicates(docs, doc_id, text).filter("kept").select(
        not_null_id(F.col("doc_id")).alias("key"), "digest")
    rows = packed(docs, key=not_null_id(column_of(docs, doc_id)), digest=digest(normalised(column_of(docs, text))))
    place = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key"))
    return unpacked(rows.join(stay, ["key", "digest"], "left_semi").withColumn("place", place).filter("place = 1"), docs)
