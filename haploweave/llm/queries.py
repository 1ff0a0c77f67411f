"""Registered queries of the ten operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, knn_join, language_id, lm_score, mixing, order_minhash, packing, quotation, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    # The named tokenizer file has one special token; the ranks are the same vocabulary without it.
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "specials": {"<|endoftext|>": 50256}}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), **tokenizer_files())


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_rows(_table(spark, sf_dir, "documents"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(_table(spark, sf_dir, "conversations"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", knn_join.quantise("embedding").alias("v"))
    return knn_join.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_ngram_jaccard_join, op4_mix_targets, op5_language_id, op6_order_minhash, op7_quotation_links, op8_extendible_shards, op9_context_tree_weighting, op10_voronoi_top_k, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = d.doc_id""",
    "op4_mix_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 10))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS w, (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
q AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, round(target)::BIGINT - whole * source_size AS extra,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM c""",
    "op7_quotation_links": r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations),
y AS (SELECT *, regexp_extract(x, '^(?:[ \t]*>)+') AS marks FROM m),
z AS (SELECT conv_id, turn, role, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(x, length(marks) + 1) AS raw FROM y),
n AS (SELECT *, trim(regexp_replace(lower(raw), '[ \t\r]+', ' ', 'g')) AS norm FROM z),
spans AS (SELECT DISTINCT conv_id, turn, level, norm AS h, 1 AS w FROM n WHERE norm <> '' AND level < 2
          UNION ALL SELECT conv_id, turn, level, string_agg(norm, chr(10) ORDER BY i), count(*) FROM n WHERE norm <> '' AND level < 2 GROUP BY 1, 2, 3 HAVING count(*) > 1),
o AS (SELECT conv_id, h, min(turn) AS origin FROM spans WHERE level = 0 GROUP BY 1, 2),
f AS (SELECT s.conv_id, s.turn, origin, sum(w) AS w, sum(CASE WHEN w = 1 THEN 1 ELSE 0 END) AS k FROM spans s JOIN o USING (conv_id, h) WHERE level = 1 AND origin < s.turn GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, arg_max(origin, (w, origin)) AS parent_turn, sum(k) AS linked_lines FROM f GROUP BY 1, 2),
r(conv_id, turn, up, hops) AS (SELECT conv_id, turn, parent_turn, 1 FROM b UNION ALL SELECT r.conv_id, r.turn, b.parent_turn, hops + 1 FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.up),
t AS (SELECT conv_id, turn, arg_max(up, hops) AS root_turn, max(hops) AS reply_depth FROM r GROUP BY 1, 2),
g AS (SELECT conv_id, turn, any_value(role) AS role, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0), '') AS clean_text,
             count(*) FILTER (level > 0 AND norm <> '') AS quoted_lines, max(level)::BIGINT AS quote_depth FROM n GROUP BY 1, 2)
SELECT g.*, coalesce(linked_lines, 0)::BIGINT AS linked_lines, parent_turn, coalesce(root_turn, g.turn) AS root_turn, coalesce(reply_depth, 0)::BIGINT AS reply_depth
FROM g LEFT JOIN b USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)""",
    "op8_extendible_shards": r"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_bytes) - 1 AS copy FROM d),
h AS (SELECT doc_id, n_bytes, copy, ('0x' || substr(md5(doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 15))::BIGINT AS h FROM c),
p AS (SELECT *, h >> (60 - depth) AS prefix FROM (SELECT *, unnest(range(0, 40)) AS depth FROM h)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY 1, 2),
f AS (SELECT p.doc_id, p.n_bytes, p.copy, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) WHERE shard_bytes <= 1048576 OR shard_docs = 1 GROUP BY 1, 2, 3)
SELECT f.doc_id, f.n_bytes, f.depth::INTEGER AS depth, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(p.prefix), f.depth::INTEGER, '0') END AS shard, shard_bytes, shard_docs
FROM f JOIN p USING (doc_id, n_bytes, copy, depth) JOIN s ON s.depth = f.depth AND s.prefix = p.prefix""",
    "op10_voronoi_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
