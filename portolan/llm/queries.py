"""The registered queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from portolan.llm import (
    bpe,
    chat,
    embedding_links,
    exact_dedup,
    jaccard_join,
    packing,
    periodic_runs,
    pii,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
    vector_codes,
)

PATTERN = public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(documents(spark, sf_dir), path, PATTERN)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text")
    )
    return chat.digests(chat.examples(said.unionByName(extra)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), PATTERN)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(documents(spark, sf_dir))
    return periodic_runs.digests(periodic_runs.find_runs(planted))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


NORMAL = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

CRC_STEP = "list_reduce(list_prepend(xor(c, b), [{zeros}]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN {poly} ELSE 0 END))".format(
    zeros=", ".join(["0::BIGINT"] * 8), poly=0xEDB88320
)


def _lloyd_sql() -> str:
    def assign(books: str) -> str:
        squared = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
        return f"""SELECT r, p, any_value(x) AS x, arg_min(e, ({squared}) * 64 + e) AS e, min({squared}) AS error
  FROM parts JOIN {books} USING (p) GROUP BY r, p"""

    def update(books: str, assigned: str) -> str:
        means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
        return f"""SELECT p, e, coalesce(m, c) AS c FROM {books} LEFT JOIN (SELECT p, e, [{means}] AS m FROM {assigned} GROUP BY p, e) USING (p, e)"""

    return f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT r, p, v[4 * p + 1:4 * p + 4] AS x FROM k, range(16) AS t(p)
), seeds AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64
), b0 AS (SELECT p, e, v[4 * p + 1:4 * p + 4] AS c FROM seeds, range(16) AS t(p)
), a1 AS MATERIALIZED ({assign("b0")}
), b1 AS MATERIALIZED ({update("b0", "a1")}
), a2 AS MATERIALIZED ({assign("b1")}
), b2 AS MATERIALIZED ({update("b1", "a2")}
), a3 AS ({assign("b2")}
), codes AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a3 GROUP BY r
), book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN k USING (r), book
"""


SQL = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({NORMAL}) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
""",
    "op5_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g'))
             + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 9) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op7_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM starts
), hot AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM windows WHERE k IN (SELECT k FROM hot)
), gathered AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(
         CASE WHEN js IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda x: CASE WHEN list_contains(js, x) THEN NULL ELSE w[x] END), lambda y: y IS NOT NULL) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gathered USING (r)
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END) AS g FROM d
), flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM grams
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM shared WHERE 5 * c >= 4 * (nx + ny - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), classes AS (SELECT x, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x)
SELECT x AS doc_id, class_id, class_size, (SELECT count(*) FROM links WHERE links.x = classes.x) AS n_links FROM classes
""",
    "op11_periodic_runs": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {CRC_STEP}), 4294967295) AS h
  FROM documents
), g AS (SELECT r, doc_id, w, h, h // 10 AS g, len(w) AS n FROM d
), ap AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g
), t AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) END AS w
  FROM ap
), grams AS (
  SELECT r, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 12)
), often AS (SELECT r, k FROM grams GROUP BY r, k HAVING count(*) > 1
), again AS (SELECT * FROM grams SEMI JOIN often USING (r, k)
), met AS (SELECT x.r, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.r = y.r AND x.k = y.k AND x.i < y.i
), islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS s FROM met
), stretches AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY r, q, s HAVING count(*) + 5 >= q
), runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= 12 GROUP BY r, start, length
), told AS (
  SELECT r, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS best,
         sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), words AS (SELECT r, unnest(w) AS x, unnest(range(0, n)) AS i FROM t SEMI JOIN runs USING (r)
), stay AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period,
       (1000 * best[2] // best[3])::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
       sha256(coalesce(kept, array_to_string(w, ' '), '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN stay USING (r)
""",
    "op12_vector_codes": _lloyd_sql(),
    "op13_embedding_links": """
WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              THEN embedding::DOUBLE[] END AS v
  FROM embeddings
), links AS (
  SELECT a.r AS x, b.r AS y FROM k a JOIN k b ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT r AS x, r AS y FROM k UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), components AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN k ON reach.y = k.r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.x = k.r) AS n_links, component_id, vec_id = component_id AS kept
FROM k JOIN components ON components.x = k.r
""",
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_exact_dedup,
        op3_quality_rules,
        op4_token_counts,
        op5_chat,
        op6_pii,
        op7_substring_dedup,
        op8_secret_scan,
        op9_jaccard_join,
        op10_packing,
        op11_periodic_runs,
        op12_vector_codes,
        op13_embedding_links,
        pipeline,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
