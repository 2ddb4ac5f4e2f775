"""URL rules, personal data, neighbours and languages."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionflow.llm import language_id, nearest, pii, url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if set(re.split(r"[.-]", host)) & set(url_filter.BLOCK_TERMS) else "allow"


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["Example.ORG", "a.example.org", "badexample.org", "org", ".org", "x.com", "x.com.", "casino-win.net", "a.bet",
             "é.com", "", "x.com:80", "user@x.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a#b", "/de/", "?q=/de/", "#://", "/fr/\n"]
    urls = [None, "", "x.org/", "://", "http://", "http:// "] + [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://a.org/", "h"), (1, "", "h")],
                                  "page_id bigint, url string, host string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == pages.count()
    for row in rows:
        if row["page_id"] is not None and row["page_id"] > 1:
            assert (row["host"], row["path"], row["rule"], row["verdict"]) == judged(urls[row["page_id"]])
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_with_crowded_filters(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)  # many false positives, so many levels
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    listed = keys.filter("listed").select("key").unionByName(spark.createDataFrame([("outside",), (None,)], "key string"))
    cascade = url_filter.build_cascade(listed, keys, "key")
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [(kind, *m.span()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m)]


def test_personal_data(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x_y", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 010-9999",
            "+", "12", "0", "é", "🙂", "\u0001", "$0", "\\", "mail", "7.7.7.7.7", "b.co@d-e.fr", "\n", "000255"]
    texts = [None, "", "a" * 20_000, "1" * 20_000, "1 " * 9_000, "+1" + " " * 5_000, "a@b.c_d@e.f", "9.9.9.9" * 500]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a@b.c", 1), (0, None, 1)],
                                 "doc_id bigint, text string, base int")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        want = base_pii(texts[row["doc_id"]] or "") if row["doc_id"] is not None else [("email", 0, 5)]
        assert [tuple(s) for s in row["base"]] == want, texts[row["doc_id"]]
        assert set(want) <= {tuple(s) for s in row["spans"]}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_personal_data_beyond_the_base_rules(spark):
    """Values that no base rule matches are added whatever the corpus holds; clean numbers are not."""
    private = [("email", "Please write, ", "jane.roe(at)example(dot)org", " soon"), ("email", "mail: ", "max [at] uni.de", ", thanks"),
               ("phone", "my phone is ", "555 010 9999", " at home"), ("phone", "Tel. ", "(030) 901820-77", "."),
               ("phone", "call ", "+(1) 555-010-9999", " now"), ("card", "pay with card ", "4111.1111.1111.1111", " today"),
               ("card", "Visa ", "4222222222222", "; ok"), ("card", "amex: ", "378282246310005", " end"),
               ("card", "it was ", "5500.0000.0000.0004", " then")]
    clean = ["about 5550109999 grains of sand", "order 4111.1111.1111.1111 came", "card 4111.1111.1111.1112 no", "we met (at) noon",
             "phone of 2024-05-17 is new", "token = 681c09b8e90e7e8c9575180f595f646cf29690", "pi is 3.14159265358979", "999.1.2.3.4 of it",
             "ISBN 978-3-16-148410-0", "hotel 5550109999 grains", "from 12.05.2019 14.06.2020 on", "invoice phone 5550109999"]
    texts = [b + v + a for _, b, v, a in private] + clean
    base_only = [f"word {k} +1 (555) 010-{1000 + k} and a{k}@b.org" for k in range(60)]
    for more in ([], base_only):
        docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id bigint, text string")
        rows = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
        for k, text in enumerate(texts):
            added = [tuple(s) for s in rows[k]["spans"] if s not in rows[k]["base"]]
            want = [(private[k][0], len(private[k][1]), len(private[k][1]) + len(private[k][2]))] if k < len(private) else []
            assert added == want and not rows[k]["base"], text


def test_boosting_learns_and_calibrates():
    """A rule over two features is found again, and the threshold keeps its precision on other cells."""
    rng = random.Random(6)
    cells = {}
    for _ in range(4000):
        codes = tuple(rng.randrange(n) for n in pii.FEATURES.values())
        yes = codes[4] == 1 and codes[1] >= 3 and rng.random() < 0.99
        cell = cells.setdefault(codes, [0, 0])
        cell[not yes] += 1
    rows = [(codes, a, b) for codes, (a, b) in sorted(cells.items())]
    bias, trees = pii._grow(rows[::2], 12, 0.5, 1.0)
    scored = [(pii._scored(bias, trees, codes), a, b) for codes, a, b in rows[1::2]]
    least = pii._threshold(scored, 0.95)
    kept = [(a, b) for s, a, b in scored if s >= least]
    assert sum(a for a, _ in kept) >= 0.9 * sum(a for _, a, _ in scored)
    assert sum(a for a, _ in kept) >= 0.95 * sum(a + b for a, b in kept)
    assert pii._threshold([(0.0, 0, 5)], 0.9) == float("inf")


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 16))
    x = (centers[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16)))
    x[100:140] = x[0]  # ties
    rows = [(k, v.tolist(), "s") for k, v in enumerate(x)]
    bad = [(2000, None, "s"), (2100, [0.0] * 16, "s"), (2200, [float("nan")] * 16, "s"), (2300, [None] + [1.0] * 15, "s"),
           (2400, [1.0, 2.0], "s"), (2500, [], "s"), (None, x[3].tolist(), "s"), (2600, [float("inf")] * 16, "s")]
    vectors = spark.createDataFrame(rows + bad + rows[:50], "vec_id bigint, embedding array<double>, score string")
    found = nearest.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).collect()
    hits = total = 0
    for query in range(0, 1500, 50):
        d = np.sqrt(((x - x[query]) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(1500), d)) if k != query][:10]
        got = sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in got)
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        if query in (0, 100):
            assert [r["vec_id"] for r in got] == order  # all ties of a vector were reranked
        hits, total = hits + len(set(order) & {r["vec_id"] for r in got}), total + 10
    assert hits >= 0.9 * total and len(found) == total
    few = nearest.nearest_neighbours(vectors.filter("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert nearest.nearest_neighbours(vectors.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("different", [1, 20])
def test_neighbours_among_many_copies(spark, different):
    """Pivots are drawn from the different vectors, so copies cost none of them."""
    some = spark.createDataFrame([([float(k), 1.0, -k * k / 7.0],) for k in range(60)], "v array<double>")
    latest = [r["v"] for r in some.orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 40)).desc()).collect()][:different]
    vectors = spark.createDataFrame([(k, latest[k % different]) for k in range(10_000)],
                                    "vec_id bigint, embedding array<double>")
    assert len(nearest.draw_pivots(nearest.usable(vectors, "vec_id", "embedding"))) == different
    found = nearest.nearest_neighbours(vectors, F.col("vec_id") % 1000 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(q, k) for q in range(0, 10_000, 1000) for k in range(1, 11)]
    assert all(r["score"] == 0 and r["vec_id"] % different == r["query_id"] % different for r in found)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language_id.fit(docs.filter(~language_id.held_out(docs["doc_id"])), rows=1500)
    found = language_id.identify(docs, network).filter(language_id.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "12 34 !?", 9), (None, "the and of that", 9),
                                 (5, "the " * 50_000, 9), (5, "é", 9)], "doc_id bigint, text string, score int")
    rows = language_id.identify(odd, network).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and rows[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[5]["lang_pred"] in network.languages
    assert language_id.keep_identified(odd, network).columns == odd.columns
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), network).count() == 0


def test_copies_do_not_crowd_a_language_out(spark):
    """A language whose rows are copies of one text enters the sample as one that has the text once."""
    rows = [(f"text number {k} of many", "en") for k in range(300)]
    latest = spark.createDataFrame([(f"ein Satz {k}",) for k in range(40)], "t string").orderBy(
        F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 40)).desc()).first()["t"]
    docs = spark.createDataFrame(rows + [(latest, "de")] * 3000, "text string, lang string")
    once = spark.createDataFrame(rows + [(latest, "de")], "text string, lang string")
    sample = lambda d: sorted(map(tuple, language_id.training_sample(d, rows=600).collect()))
    assert sample(docs) == sample(once) and sum(label == "de" for _, label in sample(docs)) == 1


def test_windows_cover_every_byte():
    """Long texts: the folded tables over windows equal a plain convolution over the whole text."""
    rng = np.random.default_rng(1)
    network = language_id.train_network(["abc", "xyz"], ["a", "b"])
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 700))
    codes, counts, sizes = language_id._codes([text, "b", ""])
    top = language_id._strongest(language_id._folded(network), codes, 0, int(counts.sum()))
    plain = []
    for own in network.tables():
        out = sum(own[k][codes[k:len(codes) - 4 + k]] for k in range(len(own)))
        plain.append(out[:counts.sum() * language_id.WINDOW])
    want = np.concatenate(plain, axis=1).reshape(counts.sum(), language_id.WINDOW, -1).max(axis=1)
    assert np.abs(top - want).max() < 1e-5 and sizes.tolist() == [700, 1, 0]


def test_every_labelled_text_trains(spark):
    """Texts that no snippet is drawn from change the network, and the round over all texts follows the same gradients."""
    base = [(f"the cat and the dog number {k} of many", "en") for k in range(40)] + [
        (f"der Hund und die Katze Nummer {k} von vielen", "de") for k in range(40)]
    more = base + [("ein anderes Wort nach dem anderen " * 2000, "de")]
    frame = lambda rows: spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    begun = language_id.train_network([t for t, _ in base], [v for _, v in base])
    sizes = lambda rows: {v: sum(len(t) for t, w in rows if w == v) for v in ("de", "en")}
    nets = [language_id.trained_on_all(frame(rows), begun, sizes(rows)) for rows in (base, more)]
    assert np.abs(nets[0].dense - begun.dense).max() > 0 and np.abs(nets[1].dense - nets[0].dense).max() > 0
    german = [language_id.Predictor(n)._means(["ein anderes Wort nach dem anderen"])[0][0] for n in (begun, nets[1])]
    assert german[1] > german[0]
    one = language_id._Round(begun)
    one.learn([base[0][0], base[50][0]], np.array([1, 0]), np.array([1.0, 1.0]))
    assert one.windows == 2 and all(v.shape == w.shape for v, w in zip(one.network().filters, begun.filters))


def test_the_least_score_counts_all_labelled_texts(spark, monkeypatch):
    """More labelled texts than the draw of snippets holds: all of them are scored."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    seen = []
    real = language_id.identify
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 50)
    monkeypatch.setattr(language_id, "identify", lambda rows, *more: seen.append(rows.count()) or real(rows, *more))
    language_id.fit_calibrated(docs)
    assert seen == [docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).count()]
