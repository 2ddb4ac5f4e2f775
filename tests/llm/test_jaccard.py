"""The Jaccard join against all pairs, with long lists, blocks and odd rows."""
import random

import numpy as np
import pytest

from regionflow.llm import jaccard_join
from regionflow.llm.shingles import Shingler


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, percent, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(k)] = min(doc, ids.get(find(k), doc))
    return [(doc, len(sets[k]), ids.get(find(k))) for k, (doc, _) in enumerate(rows)]


def families(seed, families_, members, words):
    """Texts that were changed more or less, so that similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    texts = []
    passage = " ".join(f"p{k}" for k in range(40))
    for _ in range(families_):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, max(1, words // 12))):
                own[rng.randrange(words)] = f"v{rng.randint(0, 10 ** 6)}"
            texts.append(" ".join(own) + (" " + passage if rng.random() < 0.5 else ""))
    return texts


def test_hashes_tell_shingles_apart():
    texts = families(1, 3, 5, 60) + ["", "one", "a b c", "A B c", "x " * 120_000 + "y", None]
    sets = Shingler(4).sets(texts)
    for text, hashes in zip(texts, sets):
        assert len(hashes) == len(shingles(text, 4)) and (np.diff(hashes.astype(object)) > 0).all()
    assert (sets[texts.index("a b c")] == sets[texts.index("A B c")]).all()


@pytest.mark.parametrize("percent,width,short", [(85, 4, 32), (80, 5, 3)])
def test_components(spark, monkeypatch, percent, width, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 8 if short == 3 else 128)
    texts = families(width, 6, 25, 80) + families(9, 30, 3, 30) + families(8, 40, 2, 6)
    texts += [None, "", "  \n", "one", "One", "a b c", "a b c d", " ", "the same text again and again"] * 3
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(None, "one"), (None, "lonely null id"), (3, texts[0])]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, node string, n int")
    got = jaccard_join.near_duplicates(docs, percent, width).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(rows, percent, width)))


@pytest.mark.parametrize("short", [32, 3])
def test_every_link_is_counted(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 8 if short == 3 else 128)
    texts = families(5, 3, 20, 80) + families(9, 10, 3, 30) + [None, "", "one", "One", "the same text again and again"] * 3
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "one"), (3, texts[3])]
    sets = [shingles(t, 4) for _, t in rows]
    want = [(doc, sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if j != k) if a else 0)
            for k, ((doc, _), a) in enumerate(zip(rows, sets))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.near_duplicates(docs, count_links=True).select("doc_id", "n_links").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want)) and max(n for _, n in want) > 2


def test_one_of_each_component_stays(spark):
    texts = families(2, 4, 6, 60) + ["", None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, content string")
    left = jaccard_join.drop_near_duplicates(docs)
    want = {r[2] for r in brute(list(enumerate(texts)), 80, 5)}
    assert {r["doc_id"] for r in left.collect()} == want and left.columns == docs.columns
    assert jaccard_join.drop_near_duplicates(docs.limit(0)).count() == 0


def test_bounds_lose_no_link():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    sets, sets2 = [], []
    for n in [1, 2, 7, 60, 64, 65, 300, 511, 700, 3000]:
        for change in (0, 0.02, 0.08, 0.1, 0.12, 0.2, 0.5, 1):
            for extra in (0, n // 10, n // 5):
                hashes = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
                other = np.where(rng.random(len(hashes)) < change, rng.integers(0, 1 << 63, len(hashes), np.uint64), hashes)
                sets.append(hashes)
                sets2.append(np.unique(np.concatenate([other, rng.integers(0, 1 << 63, extra, np.uint64)])))
    columns = [pa.array([jaccard_join.parity_bits(s) for s in side], pa.binary()) for side in (sets, sets2)]
    sizes, sizes2 = (np.array([len(s) for s in side]) for side in (sets, sets2))
    assert len({len(b) for b in columns[0].to_pylist()}) == 5
    share = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets, sets2)])
    for percent in (80, 85):
        passing = jaccard_join.may_link(columns[0].slice(0), columns[1], sizes, sizes2, percent)
        assert passing[100 * share >= percent].all() and (100 * share >= percent).sum() > 40
        assert not passing[(share < 0.3) & (sizes >= 60)].any()


def test_unrelated_texts_in_shared_lists_are_not_fetched(spark, monkeypatch):
    """Many texts share phrases at random, as in a large corpus; few of them are alike."""
    for name, value in (("SKETCH_CELLS", 64), ("SHORT_LIST", 3), ("BLOCK_NODES", 8), ("UNIT_ROWS", 16)):
        monkeypatch.setattr(jaccard_join, name, value, raising=name != "UNIT_ROWS")
    rng = random.Random(4)
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(40)]
    texts = [" ".join([*(f"w{rng.randint(0, 10 ** 6)}" for _ in range(60)), *rng.sample(phrases, 3)]) for _ in range(150)]
    texts += families(6, 3, 20, 80)
    fetched, verified = [], jaccard_join.verified

    def counted(units, *rest):
        units = jaccard_join.stored(units)
        fetched.append(units.count())
        return verified(units, *rest)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(texts)), 85, 4))
    assert sum(fetched) < 6 * 60
