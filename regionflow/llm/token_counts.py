"""Token counts through a cache keyed by content digest and tokenizer version.

The cache is a Parquet table ``content, tokenizer, n_tokens`` in a folder that all machines share. A run digests
every text (the vocabulary's normaliser changes nothing, so normalised content is the content itself, NULL as
empty), joins the digests to the cache, encodes one row of each digest that the cache lacks for this tokenizer
file, appends the new counts and joins the counts back. In a later run over mostly known texts the misses are few,
the planner broadcasts their digests and no text is shuffled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import (attach_by_digest, digest, model_version, not_null_id, shared_folder, stored,
                                   tokenizer_file, whole_text)
from regionflow.llm.pieces import blocks

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
#: Characters encoded in one call.
BLOCK_CHARS = 1_000_000


def _counter(tokenizer: str):
    """A function from texts to token counts; no added special tokens, truncation or padding."""
    path = tokenizer_file(tokenizer)
    if tokenizer.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def cached_counts(spark, cache: str) -> DataFrame:
    """The cache table; empty if nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = "piece_bpe_32k.model",
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``doc_id, n_bytes, n_tokens`` per row of ``docs``; new counts are appended to ``cache``.

    NULL texts count as empty: no bytes, no tokens. Rows with NULL or repeated ids each get their row. Other columns
    are left out, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    cache = cache or shared_folder(spark)
    version = model_version(tokenizer_file(tokenizer))
    content = whole_text(docs[text])
    full = docs.select(not_null_id(docs[doc_id]).alias("_id"), docs[doc_id].alias("doc_id"),
                       content.alias("_text"), digest(content).alias("content"))
    keyed = stored(full.select("_id", "doc_id", F.octet_length("_text").cast("bigint").alias("n_bytes"), "content"))
    known = cached_counts(spark, cache).filter(F.col("tokenizer") == version)
    missing = (keyed.groupBy("content").agg(F.min("_id").alias("_id"))
               .join(known.select("content"), "content", "left_anti"))
    texts = full.join(missing.withColumnRenamed("content", "_c").withColumnRenamed("_id", "_i"),
                      (F.col("_id") == F.col("_i")) & (F.col("content") == F.col("_c")), "left_semi")

    def run(batches):
        import pyarrow as pa
        count = _counter(tokenizer)
        for batch in batches:
            whole = batch.column(1).to_pylist()
            counts = [n for part in blocks(whole, BLOCK_CHARS) for n in count(whole[part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())],
                                             names=["content", "n_tokens"])

    fresh = (texts.select("content", "_text").mapInArrow(run, "content binary, n_tokens bigint")
             .groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
             .select("content", F.lit(version).alias("tokenizer"), "n_tokens"))
    fresh.write.mode("append").parquet(cache)
    counts = cached_counts(spark, cache).filter(F.col("tokenizer") == version)
    # Two runs at once may both have stored a count; equal rows become one.
    counts = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return attach_by_digest(keyed.drop("_id"), counts, "content").select("doc_id", "n_bytes", "n_tokens")
