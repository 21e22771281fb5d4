"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of op2, in the form that parse_rule reads.
URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.chat_format import format_preferences, pair_other_replies

    return format_preferences(*pair_other_replies(_table(spark, sf_dir, "conversations")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.url_filter import filter_urls, parse_rule

    return filter_urls(_table(spark, sf_dir, "pages"), [parse_rule(x) for x in URL_RULES]).drop("tried")


def op3_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vulnlake.llm.lm_score import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.decontaminate import find_leaks, fit_space

    docs = _table(spark, sf_dir, "documents")
    return find_leaks(docs, fit_space(docs, _table(spark, sf_dir, "benchmark")))


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    from vulnlake.llm.common import is_held_out

    return scored.select("doc_id", is_held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.toxicity import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return _classified(score_documents(docs, train(docs, _table(spark, sf_dir, "labels"))), 0.5)


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0, 20)


def op7_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.quality import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return _classified(score_documents(docs, train(docs, _table(spark, sf_dir, "labels"))), 0.3)


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.sharding import assign_shards

    out = assign_shards(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.bpe_trie import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vulnlake.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_bitmap_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.cohorts import retention

    return retention(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "clients"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vulnlake.llm.lexical_search import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_preference_format, op2_url_filter, op3_attention_score, op4_latent_decontamination, op5_compression_toxicity, op6_multiprobe_neighbours, op7_jaccard_trie, op8_nbsvm_quality, op9_sampled_splitters, op10_bpe_trie, op11_token_counts, op12_bitmap_cohorts, op13_treap_search)}


_OP1 = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o1 AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
 k1 AS (SELECT conv_id, coalesce(max(i) FILTER (role = 'assistant'), max(i) + 1) AS last FROM o1 GROUP BY conv_id),
 y AS (SELECT xor(conv_id, 1) AS conv_id, role, text FROM o1 JOIN k1 USING (conv_id) WHERE i = last),
 n AS (SELECT conv_id AS pair_id, false AS odd, role, text, i FROM o1
   UNION ALL SELECT conv_id, true, role, text, i FROM o1 JOIN k1 USING (conv_id) WHERE i < last AND conv_id IN (SELECT conv_id FROM y)
   UNION ALL SELECT conv_id, true, y.role, y.text, last FROM k1 JOIN y USING (conv_id)),
 b AS (SELECT pair_id, i, c.role IS NOT NULL AND r.role IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
   FROM (SELECT * FROM n WHERE NOT odd) c FULL JOIN (SELECT * FROM n WHERE odd) r USING (pair_id, i)),
 p AS (SELECT pair_id, coalesce(min(i) FILTER (NOT coalesce(same, false)), max(i) + 1) - 1 AS k FROM b GROUP BY pair_id),
 r AS (SELECT n.pair_id, odd, i, i <= k AS shared, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM n JOIN p USING (pair_id)),
 o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, odd, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
 g AS (SELECT pair_id, odd, coalesce(string_agg(s, '' ORDER BY i) FILTER (shared), '') AS prompt,
   coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT shared), '') AS completion,
   coalesce(string_agg(CAST(CAST(pos AS BIGINT) + 13 + length(role) AS VARCHAR) || '-' || CAST(CAST(pos AS BIGINT) + length(s) - 1 AS VARCHAR), ',' ORDER BY i)
     FILTER (NOT shared AND role = 'assistant'), '') AS mask FROM o GROUP BY pair_id, odd)
SELECT p.pair_id, CAST(k AS BIGINT) AS prompt_turns, coalesce(c.prompt, r.prompt) AS prompt, c.completion AS chosen, c.mask AS chosen_mask, r.completion AS rejected, r.mask AS rejected_mask
FROM p LEFT JOIN (SELECT * FROM g WHERE NOT odd) c USING (pair_id) LEFT JOIN (SELECT * FROM g WHERE odd) r USING (pair_id)
"""

_OP2 = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 m AS (SELECT u.*, (SELECT arg_max({'rule': rh || rp, 'verdict': r.verdict}, length(rh || rp)) FROM r
   WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b FROM u)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM m
"""


_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
 x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 m AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT DISTINCT a AS v, a AS c FROM m UNION SELECT m.b, r.c FROM r JOIN m ON m.a = r.v)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(k.c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) k ON k.v = s.doc_id
"""


_OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
 q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
 l AS (SELECT r, count(*) AS n FROM t GROUP BY r),
 a AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM l),
 p AS (SELECT r, doc_id, t, count(*) AS tf FROM t WHERE t IN (SELECT t FROM q) GROUP BY ALL),
 w AS (SELECT t, floor(1000 * ln((2 * any_value(a.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t),
 i AS (SELECT p.r, p.doc_id, p.t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * l.n * a.n) // a.l)) AS i FROM p JOIN l USING (r), a),
 s AS (SELECT item_id, doc_id, r, sum(q * w * i)::BIGINT AS score FROM q JOIN w USING (t) JOIN i USING (t) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


#: crc32 of a decimal number: the table of the polynomial 0xEDB88320, then a fold over its characters.
_OP12 = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 k AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
 h AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM k, t),
 c AS (SELECT client_id, ts, kind, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents,
   coalesce(arrived_at + (CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END) * INTERVAL 1 DAY < TIMESTAMP '2024-02-01 00:00:00', false) AS known FROM h),
 a AS (SELECT 0 AS state, client_id, ts, kind, cents FROM c WHERE known UNION ALL SELECT 1, client_id, ts, kind, cents FROM c),
 s AS (SELECT state, client_id, min(ts) AS s FROM a WHERE kind = 'error' GROUP BY ALL),
 g AS (SELECT client_id, min(source) AS source FROM clients GROUP BY client_id),
 d AS (SELECT s.state, s.client_id, s, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(s AS DATE)) / 7) AS BIGINT) AS cohort, coalesce(g.source, '') AS segment,
   xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(s.client_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
   FROM t, s LEFT JOIN g USING (client_id)),
 m AS (SELECT a.*, coalesce(a.cohort <> b.cohort, false) AS moved FROM d a LEFT JOIN d b ON a.client_id = b.client_id AND a.state <> b.state),
 x AS (SELECT m.state, segment, cohort, (epoch_us(ts) - epoch_us(s)) // 604800000000 AS period, client_id, any_value(crc) AS crc, any_value(moved) AS moved, sum(cents) AS cents
   FROM a JOIN m USING (state, client_id) WHERE ts >= s GROUP BY ALL)
SELECT state, segment, cohort, CAST(period AS BIGINT) AS period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32, count(*) FILTER (moved) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM x GROUP BY state, segment, cohort, period
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_treap_search": _OP13, "op12_bitmap_cohorts": _OP12, "op7_jaccard_trie": _OP7, "op1_preference_format": _OP1, "op2_url_filter": _OP2}
