"""The queries of this subpackage and their SQL.

Each query is thin: it hands a whole table to its operator, with production parameters, and derives
digest columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.chat_format import CHUNK, rotate
from gleanery.llm.common import table
from gleanery.llm.decontaminate import find_benchmark
from gleanery.llm.embed_dedup import similar_vectors
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.minhash_dedup import near_duplicates
from gleanery.llm.packing import pack
from gleanery.llm.quality import co_train
from gleanery.llm.sharding import BLOCK_ROWS, LEAST_BLOCKS, TOLERANCE, histogram_shard
from gleanery.llm.substring_dedup import substring_dedup
from gleanery.llm.toxicity import held_out, toxicity, train

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY doc_id
"""


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    out = histogram_shard(
        docs.select("doc_id", "text", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")),
        size=F.col("size"), text=F.col("text"), ident=F.col("doc_id"), payload=["doc_id", "size", "text_crc32"],
    )
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Op 8 without its checksum, for which DuckDB has no function; the tests hold the query against it.
SHARDING_SQL = f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, text,
    ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS k1, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS k2
  FROM documents
), total AS (SELECT sum(size) AS b, count(*) AS n FROM keyed),
wanted AS (SELECT i, i * b / 40.0 AS want, b / 40.0 AS per FROM total, range(1, 40) r(i)),
g1 AS (SELECT k1, sum(s) OVER (ORDER BY k1) AS up, sum(s) OVER (ORDER BY k1) - s AS low
  FROM (SELECT k1, sum(size) AS s FROM keyed GROUP BY k1)),
g2 AS (SELECT k1, k2, sum(s) OVER (ORDER BY k1, k2) AS up, sum(s) OVER (ORDER BY k1, k2) - s AS low
  FROM (SELECT k1, k2, sum(size) AS s FROM keyed GROUP BY k1, k2)),
cut AS (
  SELECT i, CASE
    WHEN want - g1.low <= g1.up - want AND abs(g1.low - want) <= {TOLERANCE} * per THEN g1.low
    WHEN want - g1.low > g1.up - want AND abs(g1.up - want) <= {TOLERANCE} * per THEN g1.up
    WHEN want - g2.low <= g2.up - want THEN g2.low ELSE g2.up END AS up_to
  FROM wanted JOIN g1 ON g1.low < want AND g1.up >= want JOIN g2 ON g2.low < want AND g2.up >= want
), placed AS (
  SELECT keyed.*, (SELECT count(*) FROM cut WHERE cut.up_to < g2.up) AS shard,
    k2 % greatest({LEAST_BLOCKS}, (SELECT CAST(ceil(n / (40.0 * {BLOCK_ROWS})) AS BIGINT) FROM total)) AS block
  FROM keyed JOIN g2 USING (k1, k2)
)
SELECT doc_id, size, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, k1, k2) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted")
    )


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_benchmark(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["length"])
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op4_decontamination"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
at_item AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
patterns AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM at_item),
lengths AS (SELECT DISTINCT m FROM patterns),
at_doc AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m),
found AS (
  SELECT DISTINCT doc_id, i, d.m, item_id
  FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM at_doc) d JOIN patterns USING (m, p)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op9_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (SELECT doc_id, w, least(5, len(w)) AS k FROM words WHERE len(w) > 0),
shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
inverted AS MATERIALIZED (SELECT doc_id, s FROM shingled),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM inverted a JOIN inverted b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reached r JOIN both_ways e ON e.a = r.id),
least AS (SELECT id, min(c) AS c FROM reached GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON least.id = doc_id
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL["op10_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (SELECT h, min(doc_id) AS low FROM runs GROUP BY h HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM runs JOIN firsts USING (h) WHERE doc_id > low),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
joined AS (
  SELECT p.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
    string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM placed p LEFT JOIN covered c USING (doc_id, pos) GROUP BY p.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN joined USING (doc_id)
"""


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


SQL["op7_embedding_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reached(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM reached r JOIN links e ON e.a = r.id),
least AS (SELECT id, min(c) AS c FROM reached GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id JOIN least ON id = vec_id
"""


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ",")
    return out.select(
        "conv_id", "participant", "chunk", "offset", "n_turns", "n_own", spans.alias("mask"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    )


SQL["op2_chat_formatting"] = rf"""
WITH c AS (
  SELECT conv_id, turn AS number, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY ALL
), t AS (
  SELECT conv_id, coalesce(number, 0) AS turn, role, text, unnest(range(CASE WHEN number IS NULL THEN n ELSE 1 END)) AS again FROM c
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text, again) - 1 AS pos,
    translate(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(13) || chr(10), '  ') AS name, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown FROM t
), each AS (
  SELECT r.*, pos // {CHUNK} AS chunk, p.role AS participant, r.role = p.role AS own,
    '<|turn|>' || CASE WHEN r.role = p.role THEN 'assistant' ELSE 'user ' || name END || chr(10) AS head, shown || '<|end|>' || chr(10) AS body
  FROM r JOIN (SELECT DISTINCT conv_id, role FROM t) p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS since FROM each
), begun AS (
  SELECT *, min(since) OVER (PARTITION BY conv_id, participant, chunk) AS begins FROM placed
)
SELECT conv_id, participant, chunk, min(begins) AS "offset", count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  coalesce(string_agg((since - begins + length(head)) || ':' || length(body), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
  sha256(string_agg(head || body, '' ORDER BY pos)) AS text_sha256
FROM begun GROUP BY conv_id, participant, chunk
"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
