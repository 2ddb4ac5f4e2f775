"""The mix: targets by brute force, sums near targets, the same draws on every run."""
import random

from pyspark.sql import functions as F

from regionflow.llm import mixing


def brute_targets(sizes):
    """Shares by weight, capped at three times the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3 * sizes[s] for s in capped}, **share}
        capped |= over


def corpus(spark, n=9_000):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        source = None if k % 50 == 0 else "hot" if k % 3 == 0 else f"s{rng.randint(0, 9)}"
        rows.append((k, None if k % 97 == 0 else "w " * rng.choice([0, 1, 5, 20, 300 if k % 400 == 0 else 7]), source, 1))
    rows += [(None, "a b", "tiny", 2), (None, "a b", "tiny", 2), (5, "again", "", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)  # several levels of the tree
    docs = corpus(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source]
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_take_mix_repeats_rows(spark):
    docs = corpus(spark, 300)
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    words = taken.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.mix_sources(nothing).collect()} == {0}
