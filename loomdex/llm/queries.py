"""Contract queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Libraries beyond those of the engine that a query, or the pipeline, needs.
LIBRARIES = {
    "op9_langid": ("regex",),
    "op10_bpe": ("tiktoken", "public_tokenizers"),
    "op13_crosstok": ("tiktoken", "sentencepiece", "public_tokenizers"),
    "pipeline": ("regex", "tiktoken", "public_tokenizers"),
}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, KINDS, find, listed, train

    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(spark, docs))
    counts = [F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    n_spans = sum((F.size(f"all_{k}") for k in KINDS), F.lit(0)).cast("bigint").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"), n_spans)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat

    out = format_chat(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "position", "root_turn", "reply_to", "n_quotes", "n_linked", F.size("unlinked").alias("n_unlinked"), "chat")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    s = shard(table(spark, sf_dir, "documents"), shards=8)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out
    from .toxicity import PREDICT_AT, score_documents, train

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import mine

    return mine(table(spark, sf_dir, "embeddings"))


def op13_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crosstok import align

    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash, op2_exact_dedup, op3_pii, op4_ngram_join, op5_chat, op6_sharding, op7_toxicity, op8_mixing, op9_langid, op10_bpe, op11_htmltext, op12_hardneg, op13_crosstok)}


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^ \t\n\x0B\f\r]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
b AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, source, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, l[(xor(s, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM b, tab),
h AS (
  SELECT *, ('0x' || substr(md5('shard-1:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), 1, 15))::BIGINT AS key
  FROM c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
  FROM h),
g AS (
  SELECT *, row_number() OVER (ORDER BY (rank * 2 + 1)::DOUBLE / (n * 2)::DOUBLE, source IS NULL, source, key, doc_id, size, text_crc32) - 1 AS place
  FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 8 // total)::INTEGER AS shard,
       (place - (place * 8 // total * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM g
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[!-@\[-`{-~]')) AS marks, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS text_md5
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5), 1, 15))::BIGINT + 1) / 1152921504606846976.0::DOUBLE)
            / ((8 - least(7, floor(marks * 32 / greatest(chars, 1)))) / 8.0::DOUBLE) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM k GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS n
  FROM s),
f AS (
  SELECT a.*, (a.total - coalesce((SELECT sum(b.lim) FROM r b WHERE b.n < a.n), 0.0::DOUBLE))
            / (SELECT sum(b.w) FROM r b WHERE b.n >= a.n) AS level
  FROM r a),
t AS (
  SELECT source, source_size,
         least(lim, w * (SELECT level FROM f o WHERE o.lim > o.level * o.w ORDER BY o.n LIMIT 1)) AS target
  FROM f),
o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target / t.source_size)::BIGINT AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN size > 0 THEN epochs ELSE 0 END
         + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""


# the article of these pages is an element of that name, without parts to leave out
OP11_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS b FROM a),
t AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM d a JOIN d b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (
  SELECT anchor, id AS positive_id, row AS positive, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) <= 5),
n AS (
  SELECT s.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY s.anchor, p.positive ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM s JOIN p USING (anchor) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_ngram_join": OP4_SQL, "op6_sharding": OP6_SQL, "op8_mixing": OP8_SQL, "op11_htmltext": OP11_SQL, "op12_hardneg": OP12_SQL}
