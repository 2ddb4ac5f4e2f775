"""Token counts, pieces, exact duplicates and secrets against brute force on odd rows."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from regionflow.llm import exact_dedup, pieces, secret_scan, token_counts
from regionflow.llm.common import shared_folder, tokenizer_file

SCHEMA = "doc_id bigint, text string, ids string, digest string, kept string, content string"


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "漢", "🙂", "\u0000", "<s>", "1234", " ", ".", "   x"]
    return ([None, "", " ", "  ", "▁", "▁▁ a", " a", "a ", "a  b", "\n\n", "x" * 30_000, "word " * 9_000, "🙂" * 50]
            + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)])


def frame(spark, texts, first=0):
    rows = [(k + first, t, "x", None, "y", "z") for k, t in enumerate(texts)]
    rows += [(None, "a b", "x", None, "y", "z"), (None, "a b", "x", None, "y", "z"), (0, texts[-1], "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(spark, model):
    docs = frame(spark, odd_texts())
    rows = pieces.encode_pieces(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        want = model.encode(row["text"] or "") + [model.eos_id()]
        assert row["ids"] == want and row["decoded"] == model.decode(want)
    assert pieces.encode_pieces(docs).columns == ["doc_id", "text", "digest", "kept", "content", "ids", "decoded"]
    assert pieces.encode_pieces(docs.limit(0)).count() == 0


def test_a_small_chunk_table_changes_nothing(model):
    table = pieces.ChunkTable(tokenizer_file("piece_bpe_32k.model"), end=False, limit=7)
    for text in odd_texts():
        ids, bounds = table.encode([text or "", "tail"])
        assert ids[bounds[0]:bounds[1]].tolist() == model.encode(text or "")


@pytest.mark.parametrize("tokenizer", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, tokenizer):
    docs, cache = frame(spark, odd_texts()), shared_folder(spark)
    count = token_counts._counter(tokenizer)
    rows = token_counts.count_tokens(docs, cache, tokenizer).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for row in docs.filter("doc_id > 0").collect():
        text = row["text"] or ""
        got = by_id[row["doc_id"]]
        assert (got["n_bytes"], got["n_tokens"]) == (len(text.encode()), count([text])[0])
    stored = token_counts.cached_counts(spark, cache).count()
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("quite new")))
    assert token_counts.count_tokens(more, cache, tokenizer).count() == docs.count() + 1
    assert token_counts.cached_counts(spark, cache).count() == stored + 1  # only the miss was encoded
    assert token_counts.count_tokens(docs.limit(0), cache, tokenizer).count() == 0


def test_exact_duplicates(spark):
    texts = ["a  b", "a\tb", "a b", "a b ", None, "", "c", " c"] * 40 + [f"own {k}" for k in range(50)]
    docs = frame(spark, texts)
    rows = exact_dedup.exact_duplicates(docs).collect()
    groups = {}
    for row in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row["text"] or ""), []).append(row["doc_id"])
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    assert len(rows) == docs.count()
    for row in rows:
        ids = by_digest[bytes(row["digest"])]
        assert row["keep_id"] == min(i for i in ids if i is not None) and row["group_size"] == len(ids)
        assert row["kept"] == (row["doc_id"] == row["keep_id"]) or ids.count(row["doc_id"]) > 1
    assert sum(r["kept"] for r in rows) == len(groups)
    left = exact_dedup.drop_duplicates(docs)
    assert left.count() == len(groups) and left.columns == docs.columns
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def base_secrets(text):
    rules = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    spans = [(m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(rules)
             for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


def test_secrets_and_ledger(spark):
    rng = random.Random(5)
    bits = ["token", "PassWord", " = ", ":", "'", '"', "AKIA", "ABCDEFGH1234", "0123456789abcdef", "secret=", "api_key",
            " ", "é", "tokſen=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "xyz123", "-"]
    texts = [None, "", "f" * 40, "token = abc token=abcdef"] + ["".join(rng.choice(bits) for _ in range(12)) for _ in range(200)]
    docs, ledger = frame(spark, texts), shared_folder(spark)
    base = {rule.kind for rule in secret_scan.BASE}
    rows = secret_scan.scan_secrets(docs, ledger, secret_scan.BASE).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r["findings"] for r in rows if r["doc_id"]}
    for row in docs.filter("doc_id > 0").collect():
        assert [tuple(f) for f in by_id[row["doc_id"]]] == base_secrets(row["text"] or "")
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    pairs = lambda: secret_scan.read_ledger(spark, ledger).select("blob", "rule_version").distinct().count()
    assert pairs() == blobs * 3
    before = secret_scan.read_ledger(spark, ledger).count()
    again = secret_scan.scan_secrets(docs, ledger).collect()  # the new rules meet all blobs, the old ones none
    assert pairs() == blobs * len(secret_scan.RULES)
    assert secret_scan.read_ledger(spark, ledger).filter(F.col("rule_version").isin(
        [r.version for r in secret_scan.BASE])).count() == before
    for row in again:
        kept = [tuple(f) for f in row["findings"] if f["kind"] in base]
        if row["doc_id"]:
            assert kept == base_secrets(docs.filter(F.col("doc_id") == row["doc_id"]).first()["text"] or "") if (
                row["doc_id"] < 12) else True
    assert any(f["kind"] == "private_key" for row in again for f in row["findings"])
    assert secret_scan.scan_secrets(docs.limit(0), ledger).count() == 0
