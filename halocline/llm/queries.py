"""The registered queries ``opN_<name>`` and the pipeline, with SQL where SQL can state the result.

Each takes a session and a folder of tables and applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    licenses,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    sharding,
    simhash,
    substring,
    token_count,
    warc,
)

WORD_VOCABULARY = "word_bpe_49k.json"
SECRET_VOCABULARY = "byte_bpe_50k.tiktoken"
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, public_tokenizers.path(SECRET_VOCABULARY), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.learn_field(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, field, threshold=0.7)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_copies(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), limit=2048)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows(table(spark, sf_dir, "documents"), window=35)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), max_tokens=2048)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    borrowed = F.crc32(conv.cast("string").cast("binary")) % 9
    turns = table(spark, sf_dir, "conversations")
    return conversation_trie.prefix_trie(turns, lender=conv - conv % 5, borrowed=borrowed, most=8)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), change=periodic_runs.loop_words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_simhash, op3_quality, op4_exact_dedup, op5_token_counts, op6_substring_dedup,
        op7_license_scan, op8_packing, op9_decontamination, op10_sharding, op11_conversation_trie,
        op12_warc, op13_periodic_runs, pipeline,
    )
}

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Windows of 35 words by their text; ``\\x20\\x09-\\x0D`` is the white space of the contract.
SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM docs
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM repeated
), removed AS (
  SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN words ELSE
         list_filter(words, lambda w, k: NOT list_contains(gone, k)) END, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN removed USING (doc_id)
"""

DECONTAMINATION = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words)
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM item_words)
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""

SHARDING = f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15] AS BIGINT) AS h FROM documents
), sums AS (
  SELECT depth, h >> (60 - depth) AS up, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM rows, (SELECT unnest(range(0, 61)) AS depth) GROUP BY 1, 2
), leaf AS (
  SELECT doc_id, n_bytes, min(depth) AS depth, arg_min(up, depth) AS up, arg_min(shard_bytes, depth) AS shard_bytes,
         arg_min(shard_rows, depth) AS shard_rows
  FROM rows JOIN sums ON up = h >> (60 - depth) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY doc_id, n_bytes
)
SELECT doc_id, n_bytes, depth || '-' || up AS shard, CAST(depth AS INTEGER) AS depth, shard_bytes, shard_rows,
       shard_bytes <= {SHARD_BYTES} AS fits FROM leaf
"""

#: CRC-32 by its table, the rebuilt conversations as lists of turns, and the nodes as their distinct beginnings.
CONVERSATION_TRIE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
), ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), borrowed AS (
  SELECT conv_id, conv_id - conv_id % 5 AS lender, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 AS h
  FROM ids, crc_table
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations
), rebuilt AS (
  SELECT conv_id, 0 AS part, place, x FROM borrowed JOIN (SELECT conv_id AS lender, place, x FROM turns) USING (lender) WHERE place < h
  UNION ALL SELECT conv_id, 1, place, x FROM turns JOIN borrowed USING (conv_id) WHERE place >= h
), sequences AS (
  SELECT conv_id, coalesce(list(x ORDER BY part, place) FILTER (x IS NOT NULL), []) AS s FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM sequences
), members AS (
  SELECT conv_id, depth, len(s) AS n, CAST(s[1:depth] AS VARCHAR) AS node, CAST(s[1:depth - 1] AS VARCHAR) AS up,
         CASE WHEN depth > 0 THEN strlen(s[depth].t) ELSE 0 END AS size FROM prefixes
), nodes AS (
  SELECT node, depth, any_value(CASE WHEN depth > 0 THEN up END) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT up AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), below AS (
  SELECT DISTINCT a.node, a.depth, b.node AS low, b.depth AS low_depth FROM members a JOIN members b USING (conv_id) WHERE b.depth >= a.depth
), sums AS (
  SELECT below.node, below.depth, count(*) FILTER (children.n IS NULL) AS n_leaves, CAST(sum((v.n_convs - 1) * v.size) AS BIGINT) AS saved_tokens
  FROM below JOIN nodes v ON v.node = low AND v.depth = low_depth LEFT JOIN children ON children.node = low AND children.depth = low_depth
  GROUP BY 1, 2
)
SELECT nodes.conv_id, CAST(depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
       n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (node, depth) LEFT JOIN children USING (node, depth)
LEFT JOIN (SELECT node AS up, depth + 1 AS depth, conv_id FROM nodes) p USING (up, depth)
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_id END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS revisit FROM firsts)
"""

SQL = {
    "op4_exact_dedup": EXACT_DEDUP,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op10_sharding": SHARDING,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_warc": WARC,
}
