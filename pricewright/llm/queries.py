"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import fingerprints, langid, merkle, mixing, near_dup, packing, pii, substring_dedup, token_counts, token_files, topk, toxicity, vector_codes
from pricewright.llm.common import shared_folder, table


#: The key of the registered queries only; a real run passes its own secret.
DEMO_KEY = "registered query"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_replaced")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every executor; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.integer_top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id != c.vec_id
    WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    token_files.write_ids(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), folder)
    return token_files.read_ids(spark, folder, with_ids=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, p, vector[len(vector) // 16 * p + 1:len(vector) // 16 * (p + 1)] AS x FROM kept, range(16) AS positions(p)),
b0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
    FROM parts JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), a0 AS (
    SELECT vec_id, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best FROM parts JOIN b0 USING (p) GROUP BY ALL
), m0 AS (
    SELECT p, best % 64 AS e, i, sum(v)::BIGINT AS s, count(*) AS n
    FROM (SELECT p, best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM parts JOIN a0 USING (vec_id, p)) GROUP BY ALL
), b1 AS (
    SELECT p, e, coalesce(any_value(moved), any_value(c)) AS c
    FROM b0 LEFT JOIN (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS moved FROM m0 GROUP BY p, e) USING (p, e) GROUP BY p, e
), a1 AS (
    SELECT vec_id, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best FROM parts JOIN b1 USING (p) GROUP BY ALL
), m1 AS (
    SELECT p, best % 64 AS e, i, sum(v)::BIGINT AS s, count(*) AS n
    FROM (SELECT p, best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM parts JOIN a1 USING (vec_id, p)) GROUP BY ALL
), b2 AS (
    SELECT p, e, coalesce(any_value(moved), any_value(c)) AS c
    FROM b1 LEFT JOIN (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS moved FROM m1 GROUP BY p, e) USING (p, e) GROUP BY p, e
), a2 AS (
    SELECT vec_id, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best FROM parts JOIN b2 USING (p) GROUP BY ALL
), coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
    FROM kept JOIN a2 USING (vec_id) GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_documents(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE said AS (
    SELECT doc_id, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail, lang,
        list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, 4294967295::BIGINT) AS crc
    FROM documents
), leaves AS (
    SELECT doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM said
), up AS (
    SELECT tree, 0 AS depth, pos, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, depth + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, depth, pos // 2, n
), top AS (
    SELECT 0 AS depth, tree AS pos, count(*) OVER () AS n, digest FROM up WHERE n = 1
    UNION ALL
    SELECT depth + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY depth, pos // 2, n
), beside AS (
    SELECT l.tree, l.pos, e.depth, s.pos % 2 AS slot, s.digest
    FROM leaves l JOIN (SELECT DISTINCT tree, depth FROM up WHERE n > 1) e ON e.tree = l.tree LEFT JOIN up s ON s.tree = e.tree AND s.depth = e.depth AND s.pos = xor(l.pos >> e.depth, 1)
    UNION ALL
    SELECT l.tree, l.pos, 1000 + e.depth, s.pos % 2, s.digest
    FROM leaves l CROSS JOIN (SELECT DISTINCT depth FROM top WHERE n > 1) e LEFT JOIN top s ON s.depth = e.depth AND s.pos = xor(l.tree >> e.depth, 1)
), proofs AS (
    SELECT tree, pos, string_agg(digest, '' ORDER BY depth) AS proof, list(CASE slot WHEN 0 THEN 'l' ELSE 'r' END || coalesce(digest, '') ORDER BY depth) AS steps FROM beside GROUP BY tree, pos
), folded AS (
    SELECT l.*, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(coalesce(steps, []::VARCHAR[]), lambda acc, x: CASE WHEN x[1] = 'l' THEN sha256(x[2:] || acc) ELSE sha256(acc || x[2:]) END, coalesce(changed, leaf)) AS folded_root
    FROM leaves l LEFT JOIN proofs USING (tree, pos)
)
SELECT doc_id, leaf, u.digest AS subroot, r.digest AS root, proof_sha256, folded_root, folded_root = r.digest AS verified
FROM folded f JOIN up u ON u.tree = f.tree AND u.n = 1, (SELECT digest FROM top WHERE n = 1) r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": OP8_SQL, "op12_vector_codes": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
