"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact_dedup, jaccard_join, language_id, mixing, packing, quality, resampling, token_counts, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(chat.format_chats(chat.with_example(table(spark, sf_dir, "conversations"))))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, quality.grade(table(spark, sf_dir, "labels"))))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_mix_sources, op3_language_id, op4_token_counts, op5_chat_format, op6_warc, op7_exact_dedup, op8_quality, op9_pack, op10_exact_top_k, op11_bpe, op12_collocations, op13_resample, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM o JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.v) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.u = d.doc_id GROUP BY ALL
""",
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM s
), c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS n FROM w
), r AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS here FROM c
), l AS (
  SELECT *, (SELECT arg_min(here, n) FROM r WHERE cap > weight * here) AS level FROM r
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * level, CAST(cap AS DOUBLE))) AS target FROM l
), j AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM j
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN before IS NULL THEN length(r) + 7 WHEN before = role THEN 6 ELSE length(r) + 15 END) + 8 AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT html, first, sha1(html) AS hex, octet_length(CAST(encode(html) AS BLOB)) AS payload_bytes FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda d:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) // d % 32 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN h USING (html)
""",
    "op7_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
""",
    "op13_resample": rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), e AS (SELECT r, unnest(w) AS word FROM w),
entries AS (
  SELECT list(list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY v) AS t FROM range(256) x(v)
), words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM e UNION SELECT word FROM b)),
k AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS BIGINT))),
    lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % 10000 AS bucket FROM words, entries
), s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), f AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM e JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
d AS (
  SELECT doc_id, r, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN f USING (r)
), c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS place, 10 * count(*) OVER () // 100 AS drawn FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM c LEFT JOIN o USING (r)
""",
    "op12_collocations": rf"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), g AS (
  SELECT lang, k, w[i : i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) t(k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1),
i AS (SELECT lang, ws[i : i + k - 1] AS ws, max(a) AS a FROM (SELECT lang, ws, a, k, unnest(range(1, len(ws) - k + 2)) AS i FROM c, range(2, 4) t(k) WHERE len(ws) > k) GROUP BY ALL),
l AS (SELECT c.* FROM c LEFT JOIN i USING (lang, ws) WHERE i.a IS NULL OR 100 * i.a < 80 * c.a),
s AS (
  SELECT x.lang, x.ws, x.a, y.f AS l, z.f AS r, x.k, CAST((2000000::HUGEINT * x.a) // (y.f + z.f) AS BIGINT) AS score
  FROM (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM l) x JOIN f y ON y.lang = x.lang AND y.ws = x.ws[1 : x.k] JOIN f z ON z.lang = x.lang AND z.ws = x.ws[x.k + 1 :]
), b AS (SELECT lang, ws, a, unnest(min(struct_pack(score, k, l, r))) FROM s GROUP BY lang, ws, a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
""",
}
