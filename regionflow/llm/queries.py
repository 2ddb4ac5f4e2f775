"""Each operator applied to its whole table, with the digest columns that its contract asks for."""
from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.llm import (alignment, exact_dedup, jaccard_join, language_id, minhash, mixing, nearest, pieces, pii,
                            secret_scan, spelling, token_counts, url_filter)

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(spans, *names):
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                    x["end"].cast("string"))))


def _of(spans, *kinds):
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


@_query("op1_token_counts")
def op1(spark, folder):
    counts = token_counts.count_tokens(_table(spark, folder, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@_query("op4_mix_sources")
def op4(spark, folder):
    return mixing.mix_sources(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@_query("op6_secret_scan")
def op6(spark, folder):
    found = secret_scan.scan_secrets(_table(spark, folder, "documents"))
    base = [rule.kind for rule in secret_scan.BASE]
    return found.select(
        "doc_id", *[F.size(_of("findings", kind)).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(_of("findings", *base)), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


@_query("op8_pieces")
def op8(spark, folder):
    done = pieces.encode_pieces(_table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op9_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def op9(spark, folder):
    found = exact_dedup.exact_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _jaccard_sql(percent: int, more: str = "") -> str:
    """Components of documents whose sets of 4-word shingles reach ``percent``, from all pairs that share one."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
        lambda i: array_to_string(words[i:i + 3], ' '))) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b USING (shingle) GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
      WHERE 100 * both_ >= PERCENT * (x.n + y.n - both_)),
r AS (SELECT u AS doc_id, u AS seen FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.seen)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_idMORE
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""".replace(
        "PERCENT", str(percent)).replace("MORE", more)


@_query("op10_jaccard_join", _jaccard_sql(85))
def op10(spark, folder):
    return jaccard_join.near_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@_query("op13_minhash_dedup", _jaccard_sql(80, ", coalesce(min(r.seen), d.doc_id) = d.doc_id AS kept"))
def op13(spark, folder):
    return minhash.sketched_duplicates(_table(spark, folder, "documents"))


@_query("op11_token_alignment")
def op11(spark, folder):
    return alignment.aligned_tokens(_table(spark, folder, "documents"))


# The CRC-32 is a fold over bytes with the usual table; near words share what a deletion leaves.
@_query("op12_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
coded AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2),
    lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM bytes, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0
      THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (pos, rest) WHERE a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
                  row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
                  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (word)),
chain AS (SELECT word, word AS root, 0 AS d FROM judged
    UNION ALL SELECT c.word, j.form, d + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word) USING (word)""")
def op12(spark, folder):
    return spelling.spelling_variants(_table(spark, folder, "documents"))


@_query("op5_url_filter", r"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT p.*, r.* FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host))
      AND starts_with(path, rule_path)),
b AS (SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict FROM f GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'),
    ['adult', 'bet', 'casino', 'gambling', 'poker', 'porn', 'sex', 'xxx']) THEN 'block' ELSE 'allow' END) AS verdict
FROM b""")
def op5(spark, folder):
    return url_filter.judge_urls(_table(spark, folder, "pages"))


@_query("op3_personal_data")
def op3(spark, folder):
    found = pii.find_personal_data(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[F.size(_of("base", kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@_query("op2_language_id")
def op2(spark, folder):
    docs = _table(spark, folder, "documents")
    # rows with a NULL id have no remainder and are not learnt from
    learnt = docs.filter(docs["doc_id"].isNotNull() & ~language_id.held_out(docs["doc_id"]))
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(learnt))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query("op7_nearest")
def op7(spark, folder):
    return nearest.nearest_neighbours(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
