"""The opN queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmill.llm import bpe, langid, mixing, neardup, pii, quality, sharding, topk, urlrules, warc
from dialmill.llm.text import word_count
from dialmill.runtime import shared_path, stash, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, as a parameter for the operators that read one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~fold).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text", fold.alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.digest(F.col("text")).alias("text"), word_count(F.col("text")).alias("size"))
    sized = stash(docs, "mix-sizes")  # texts are read once; totals and plan work on their sizes and digests
    return mixing.plan_mix(sized, sized=True).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) || '|' || coalesce(source, 'null') AS key FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size) - 1 AS k FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM s),
w AS (SELECT *, [5, 2, 1][(idx % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM i),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END, 3.0) AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + (('0x' || substr(md5(key || '|' || k || '|mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    index = urlrules.mine(pages, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return urlrules.judge(pages, index).select("page_id", "host", "path", "rule", "verdict")


#: The explicit rules, and every token combination of the labelled urls by brute force in place of FP-growth. Up to
#: SAMPLE_ROWS labelled urls the operator reads them all, as this does.
OP4_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS q, string_split(host, '.') AS names,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(coalesce(regexp_extract(url, '\?([^#]*)', 1), ''), '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))), '&') AS keys FROM h),
t AS (SELECT *, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN [] ELSE list_transform(list_filter([{'k': 'scheme:', 'v': split_part(url, '://', 1)}, {'k': 'host:', 'v': host}, {'k': 'sub:', 'v': CASE WHEN len(names) > 2 THEN names[1] ELSE '' END},
  {'k': 'site:', 'v': array_to_string(names[-2:], '.')}, {'k': 'first:', 'v': regexp_extract(q, '^/([^/]+)', 1)}, {'k': 'folders:', 'v': regexp_extract(q, '(?s)^(/.*)/', 1)}, {'k': 'file:', 'v': regexp_extract(q, '([^/]+)$', 1)},
  {'k': 'ending:', 'v': regexp_extract(q, '\.([^./]+)$', 1)}, {'k': 'keys:', 'v': keys}], lambda x: x.v <> ''), lambda x: x.k || x.v) END AS items FROM p),
bad AS (SELECT doc_id, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
seen AS (SELECT items, bad FROM t JOIN bad ON page_id = doc_id WHERE len(items) > 0),
base AS (SELECT count(*) FILTER (bad) / count(*)::DOUBLE AS b FROM seen),
part AS (SELECT list_sort(list_filter(items, lambda x, k: ((m >> (k - 1)) & 1) = 1)) AS s, bad FROM seen, (SELECT unnest(range(1, 512)) AS m) WHERE m < (1 << len(items))),
found AS (SELECT s, count(*) AS n, count(*) FILTER (bad) AS w FROM part GROUP BY s),
rules AS (SELECT s FROM found, base WHERE w >= 20 AND w / n::DOUBLE >= 1.5 * b AND w / n::DOUBLE - b >= 4.0 * sqrt(b * (1 - b) / n)),
x AS (SELECT page_id, host, path, items, list_filter([('example.org/en/1', 'block', 'example.org', '/en/1'), ('example.org/es/', 'block', 'example.org', '/es/'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'), ('org/', 'allow', 'org', '/')],
  lambda r: (host = r[3] OR ends_with(host, '.' || r[3])) AND starts_with(path, r[4])) AS fit FROM t)
SELECT page_id, host, path, fit[1][1] AS rule, coalesce(fit[1][2], CASE WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(items, s)) THEN 'block' ELSE 'allow' END) AS verdict FROM x
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_archive(spark, path)
    return records.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM k
"""


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "shards")
    sharding.rewrite_affected(docs, path)  # from six shards to eight each one loses or gains, so the files hold every row
    rows = sharding.facts(sharding.read_shards(docs, path).withColumnsRenamed({"old_shard": "was", "slot": "at", "shard": "now"}), 6, "doc_id", "text")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("now").alias("shard"), F.col("at").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("was").alias("old_shard"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.detect(docs, pii.default_model(), keep=["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_exact_top_k, op3_mix_sources, op4_url_filters, op5_near_duplicates, op6_warc_archive, op7_bpe_codec, op8_reshard, op9_personal_data, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op3_mix_sources": OP3_SQL, "op4_url_filters": OP4_SQL, "op6_warc_archive": OP6_SQL}
