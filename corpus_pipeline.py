"""A training corpus from raw documents: each stage works on what the one before it kept.

All stages but the last return the columns of their input, whatever those are named; helper columns never meet them.
NULL texts count as empty, NULL ids as an id of their own, repeated rows as rows; an empty table stays empty. Texts
may be of any length.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionflow.llm.common import stored
from regionflow.llm.exact_dedup import drop_duplicates
from regionflow.llm.jaccard_join import drop_near_duplicates
from regionflow.llm.language_id import fit_calibrated, held_out, keep_identified
from regionflow.llm.mixing import take_mix
from regionflow.llm.pieces import encode_pieces


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without letters go, and those whose score is nearer an even guess
    than the scores of known languages. Without any labelled text no language is known and every row goes."""
    learnt = docs.filter(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])).select("text", "lang")
    return keep_identified(docs, *fit_calibrated(learnt))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; the smallest id stays, empty and NULL texts are one group."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id stays; documents without words stay too."""
    return drop_near_duplicates(docs, percent=80, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows alike in id, source and text are taken as one row's copies."""
    return take_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, and the text that they decode to; columns of these names are replaced."""
    return encode_pieces(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup),
          ("mixing sources", mixing), ("pieces", pieces)]

#: SQL expresses neither the network of the first stage nor the draws of the mix nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
