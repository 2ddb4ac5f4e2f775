"""Token alignment, spelling variants and sketches against brute force, with odd rows, ties and small blocks."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from regionflow.llm import alignment, grams, minhash, spelling

from test_jaccard import brute as brute_components
from test_jaccard import families

ODD = [(None, "a b <|endoftext|> c▁d"), (7001, None), (7002, ""), (7003, "<|endoftext|> x"), (7006, "  "),
       (7004, "  two  spaces \n\t日本語 emoji 😀 \x00 end "), (7004, "ß" * 9000), (7005, " ".join(map(str, range(40000)))),
       (7007, "it's 's x's  y\u00a0 z\u2003w \u00ad é 'll \n a\nb \t\tc 12 3.4, <a b> …  "), (7008, "é " * 3000 + " "), (7009, " x"),
       (7010, "x y\n"), (7011, "x y\n x  y"), (7012, "▁"), (7013, "x ▁ y"), (7014, "x y ▁x"), (7015, "▁x"), (7016, "x ▁x y"),
       (7006, "the same words"), (7006, "the same words")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()] + ODD
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, block string, n int")


def brute_alignment(rows):
    a_side, b_side = alignment.ByteLevel("byte_bpe_50k.json"), alignment.Pieces("piece_bpe_32k.model")
    held, found = Counter(), []
    for number, text in rows:
        text = text or ""
        a, b, whole = a_side.model.encode(" " + text, add_special_tokens=False).ids, b_side.model.encode(text), (" " + text).encode()
        sides = [[side.bytes[i] for i in ids] for side, ids in ((a_side, a), (b_side, b))]
        if not text or any(b"".join(parts) != whole for parts in sides):
            found.append((number, 0, 0, 0, Counter(), ""))
            continue
        groups, own, x, y, i, j = [], ([], []), 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x, i = x + len(sides[0][i]), i + 1
                own[0].append(a[i - 1])
            else:
                y, j = y + len(sides[1][j]), j + 1
                own[1].append(b[j - 1])
            if x == y:
                groups.append(own)
                own = ([], [])
        links = Counter()
        for left, right in groups:
            for p, m in Counter(left).items():
                for q, k in Counter(right).items():
                    links[p, q] += m * k
        held.update(links.keys())
        text_ = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((number, len(a), len(b), len(groups), links, hashlib.sha256(text_.encode()).hexdigest()))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return [(d, a, b, g, sum(links.values()), sum(n for (p, q), n in links.items() if held[p, q] == best[p]),
             sum(n * held[pair] for pair, n in links.items()), digest) for d, a, b, g, links, digest in found]


@pytest.mark.parametrize("block,small", [(alignment.BLOCK_CHARS, alignment.SMALL_SLICE), (20_000, 2)])
def test_alignment(spark, docs, monkeypatch, block, small):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "SLICE_BYTES", min(block, alignment.SLICE_BYTES))
    monkeypatch.setattr(alignment, "SMALL_SLICE", small)
    rows, table = docs
    got = sorted(map(tuple, alignment.aligned_tokens(table).collect()), key=str)
    assert got == sorted(brute_alignment(rows), key=str)
    assert alignment.aligned_tokens(table.limit(0)).count() == 0
    assert alignment.aligned_tokens(table.filter("text = ''")).collect()[0]["groups_sha256"] == ""


def brute_spelling(rows, least_n=2, times=10):
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if number is None else number}:{word}".encode())
            if code % 31 == 0:
                word = word[:code % len(word)] + word[code % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= least_n}
    near, cut = defaultdict(set), defaultdict(list)
    for word in words:
        for k in range(len(word)):
            rest = word[:k] + word[k + 1:]
            cut[k, rest].append(word)
            if rest in words:
                near[word].add(rest)
                near[rest].add(word)
    for same in cut.values():
        for word in same:
            near[word].update(set(same) - {word})
    form = {}
    for word in words:
        if near[word]:
            best = min(near[word], key=lambda x: (-words[x], x))
            if words[best] >= times * words[word]:
                form[word] = best

    def root(word):
        return root(form[word]) if word in form else word
    return sorted((w, form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words)


def typo_rows():
    """Words with edits at every place, chains of forms, ties, marks next to them, and letters outside ASCII."""
    rng = random.Random(3)
    texts, letters = [], "abcdeéèñÿ×"
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 12, 16, 30])))
        texts += [word] * rng.choice([1, 2, 30, 400])
        for k in range(len(word) + 1):
            c = rng.choice(letters)
            for other in (word[:k] + c + word[k:], word[:k] + word[k + 1:], word[:k] + c + word[k + 1:]):
                texts += [other.upper() if rng.random() < 0.1 else other] * rng.choice([1, 2, 3, 25])
    rng.shuffle(texts)
    return [(k if k % 17 else None, " ".join(texts[k::200]) + ". |x|") for k in range(200)] + [(1, None), (2, ""), (3, "  ")]


def test_spelling(spark, docs):
    for rows in (typo_rows(), docs[0]):
        table = spark.createDataFrame([(*r, "y", 1.0) for r in rows], "doc_id bigint, text string, word string, `a.b` double")
        got = sorted((tuple(r) for r in spelling.spelling_variants(table).collect()), key=lambda r: r[0])
        assert got == brute_spelling(rows)
    assert spelling.spelling_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(table, least_length=6)


def test_frequent_grams_leave_pairs_their_lists(spark, monkeypatch):
    """With many frequent grams, hence long ones, no near pair is lost, and each word's bound leaves a gram."""
    rows = typo_rows()
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = spelling.word_counts(table).filter("n >= 2")
    want = {w for w, *_, n_near, _ in brute_spelling(rows) if n_near}
    for least in (1, 3, 10 ** 6):
        got = {r["word"] for r in spelling.near_words(words, share=0.0, least=least).collect()}
        assert got == want
    frequent = spelling.frequent_grams(words, share=0.0, least=2)
    assert all(gram[:-1] in frequent for gram in frequent if len(gram) > grams.SHORTEST)
    for r in words.collect():
        for more in (0, 1):
            dictionary = grams.GramDictionary(frequent, grams.longest_gram(max(6, len(r["word"]) - more)))
            marked = f"|{r['word']}|"
            spans = dictionary.decompose(marked)
            assert dictionary.bound(marked, spans) < len(spans)


def test_a_bound_covers_every_edit():
    """No edit changes more grams of a word than its bound says."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 14))) for _ in range(120)]
    counts = Counter(g for w in words for g in {f"|{w}|"[k:k + q] for q in range(2, 6) for k in range(len(w) + 3 - q)})
    frequent = {g: n for g, n in counts.items() if n > 6}
    for word in words:
        dictionary = grams.GramDictionary(frequent, grams.longest_gram(len(word)))
        marked = f"|{word}|"
        spans = dictionary.decompose(marked)
        bound = dictionary.bound(marked, spans)
        for k in range(1, len(marked)):
            for other, shift in ((marked[:k] + "b" + marked[k:], 1), (marked[:k] + marked[k + 1:], -1),
                                 (marked[:k] + "c" + marked[k + 1:], 0)):
                if k == len(marked) - 1 and shift < 1:
                    continue
                left = {(a, other[a:b]) for a, b in dictionary.decompose(other)}
                lost = [(a, b) for a, b in spans if (a, marked[a:b]) not in left and (a + shift, marked[a:b]) not in left]
                assert len(lost) <= bound


@pytest.mark.parametrize("width,percent", [(4, 80), (5, 90)])
def test_sketched_duplicates(spark, docs, width, percent):
    texts = families(width, 5, 25, 80) + families(9, 20, 3, 30) + families(8, 30, 2, 6)
    texts += [None, "", "  \n", "one", "One", "a b c", "a b c d", " ", "the same text again and again"] * 3
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(None, "one"), (None, "lonely null id"), (3, texts[0])]
    table = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, node string, `a.b` int")
    got = minhash.sketched_duplicates(table, percent, width).collect()
    want = [(d, n, c, d == c) for d, n, c in brute_components(rows, percent, width)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert minhash.sketched_duplicates(table.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    """All coordinates fill; their agreement is near the similarity, for sets of one element to thousands."""
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 100, 4000):
        for share in (0.0, 0.5, 0.8, 1.0):
            agree = []
            for _ in range(12):
                every = np.unique(rng.integers(0, 1 << 63, 3 * size, np.uint64))
                both = round(2 * size * share / (1 + share))
                a, b = every[:size], np.concatenate([every[:both], every[size:2 * size - both]])
                rows = minhash.sketches([a, b, a])
                assert (rows[0] == rows[2]).all() and (rows != 0).all()
                true = both / (2 * size - both)
                agree.append((rows[0] == rows[1]).mean() - true)
            assert abs(np.mean(agree)) < 0.08
