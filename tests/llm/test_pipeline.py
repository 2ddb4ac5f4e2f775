"""The pipeline stage by stage against brute force on a small corpus."""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from regionflow.llm import language_id, queries  # noqa: E402
from regionflow.llm.common import stored  # noqa: E402
from test_jaccard import brute  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        kept.append(docs.collect())
    identified, unique, different, mixed = kept
    assert len(identified) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()  # all have a language
    norm = {}
    for r in identified:
        key = " ".join((r["text"] or "").replace(" ", "\x00").split())
        norm[key] = min(r["doc_id"], norm.get(key, r["doc_id"]))
    assert {r["doc_id"] for r in unique} >= set(norm.values())
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in unique], 80, 5)}
    assert {r["doc_id"] for r in different} == want and len(different) == len(want)
    assert {r["doc_id"] for r in mixed} <= want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == len(mixed) and {"ids", "decoded"} <= set(last.columns)
    assert len(corpus_pipeline.run(spark, FOLDER).columns) == len(columns) + 2


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def odd_documents(spark):
    """The small corpus with NULLs, empty, repeated and very long rows, and columns named like helper columns."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = docs.filter("lang = 'en'").first()["text"]
    odd = [(None, text + " and more of the same", "en", None), (9001, None, None, "src1"), (9002, "", "en", "src1"), (9003, "12 ?!", "en", "x"),
           (9004, " \n", None, None), (9005, "the " * 100_000 + "end", "en", "src1"), (9006, "repeated row of the text", "en", "src2"),
           (9006, "repeated row of the text", "en", "src2"), (9007, "repeated  row of\tthe text", None, "src2")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return rows.withColumns({name: F.lit(f"{name} kept") for name in (
        "_id", "_place", "key", "row", "content", "copies", "_lang_pred", "digest", "a.b", "C0", "c1")})


def test_odd_rows_and_names(spark, tmp_path):
    docs = odd_documents(spark)
    added = [n for n in docs.columns if n not in ("doc_id", "text", "lang", "source")]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == [*docs.columns, "ids", "decoded"]
    for name in added:
        assert [r[0] for r in done.select(f"`{name}`").distinct().collect()] == [f"{name} kept"]
    ids = [r["doc_id"] for r in done.collect()]
    assert not {9001, 9002, 9003, 9004, 9007} & set(ids)  # without letters, or a copy of 9006
    taken = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, docs, ""), "")
    assert [r["doc_id"] for r in taken.filter("doc_id >= 9001").orderBy("doc_id").collect()] == [9001, 9003, 9004, 9005, 9006]
    # names that differ in case only cannot be stored, but a stage takes them
    both = spark.createDataFrame([(1, "the same", "s", 5), (2, "the same", "s", 6)], "doc_id bigint, text string, source string, TEXT int")
    assert [tuple(r) for r in corpus_pipeline.exact_dedup(spark, both, "").collect()] == [(1, "the same", "s", 5)]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_the_language_score_decides(spark):
    """Letters of no learnt language go; short clean texts of learnt ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    network, least = language_id.fit_calibrated(docs.filter(~language_id.held_out(docs["doc_id"])))
    assert 1 / len(network.languages) < least < 0.9
    clean = docs.filter(language_id.held_out(docs["doc_id"]) & F.col("lang").isNotNull())
    short = clean.select("doc_id", F.substring("text", 1, 80).alias("text"), "lang").filter(F.col("text").rlike("[a-z]{4}"))
    n = short.count()
    assert language_id.keep_identified(short, network, least).count() >= 0.98 * n
    assert language_id.keep_identified(clean, network, least).count() >= 0.995 * clean.count()
    # halves of different languages, in turns, leave an even guess
    samples = {r["lang"]: r["text"] for r in docs.filter("lang is not null and length(text) > 2000").collect()}
    mixed = "".join(text[k:k + 2] for k in range(0, 1500, 2) for text in samples.values())
    junk = spark.createDataFrame([(1, mixed, "en"), (2, "qzxjw " * 60, "en"), (3, "ЖЩЪ" * 200, "en")], "doc_id bigint, text string, lang string")
    scores = language_id.identify(junk, network).select("score").collect()
    assert language_id.keep_identified(junk, network, least).count() == sum(r["score"] >= least for r in scores)
    assert language_id.keep_identified(junk, network, max(r["score"] for r in scores) + 1e-9).count() == 0
