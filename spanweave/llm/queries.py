"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import boosted_rules, chat_format, html_tree, media, mixing, packing, rff_quality, simhash, substring_index, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(rows)))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("passages")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_digests(media.store_texts(_read(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.deduplicate(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op9_substring_dedup": op9_substring_dedup,
    "op1_simhash_dedup": op1_simhash_dedup,
    "op4_packing": op4_packing,
    "op6_media_columns": op6_media_columns,
    "op5_toxicity": op5_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op10_chat_format": op10_chat_format,
}

_ESC = r"regexp_replace({}, '([<\[])(~*)(\|(?:turn|sep|end|nl|im_start|im_end|endoftext)\|>|/?s>|/?INST\])', '\1~\2\3', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op10_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
         length({_ESC.format("text")}) AS n, length(replace({_ESC.format("role")}, chr(10), '<|nl|>')) AS m
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN same THEN 7 ELSE 8 + m + 1 + 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_substring_dedup": """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t)),
f AS (SELECT words, min(doc_id) AS first FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f USING (words) WHERE first < doc_id),
w AS (SELECT doc_id, ws[pos] AS word, pos FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM t)),
k AS (SELECT w.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE c.pos IS NULL) AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.pos = w.pos GROUP BY 1)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
""",
    "op6_media_columns": """
WITH RECURSIVE t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS m, hex(b) || repeat('00', greatest(64, (octet_length(b) + 63) // 64 * 64) - octet_length(b)) AS h FROM t),
le AS (SELECT *, printf('%02x%02x%02x%02x', (m + 36) & 255, (m + 36) >> 8 & 255, (m + 36) >> 16 & 255, (m + 36) >> 24 & 255) AS riff, printf('%02x%02x%02x%02x', m & 255, m >> 8 & 255, m >> 16 & 255, m >> 24 & 255) AS data FROM p),
w AS (SELECT *, '52494646' || riff || '57415645666d74201000000001000100401f0000401f000001000800' || '64617461' || data || h AS wav FROM le),
b AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS v, m FROM (SELECT doc_id, h, m, unnest(range(m)) AS i FROM w)),
s AS (SELECT doc_id, sum(v)::BIGINT AS total, sum(turn)::BIGINT AS turns FROM (SELECT doc_id, v, CASE WHEN (v >= 128) <> lag(v >= 128) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM b) GROUP BY 1),
crc(n, k, c) AS (SELECT n, 0, n::BIGINT FROM range(256) r(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS l FROM crc WHERE k = 8),
e AS (SELECT doc_id, list(v::BIGINT ORDER BY i) AS last FROM b WHERE i >= m - 64 GROUP BY 1),
z AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, last), lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295) AS tail FROM e, tab)
SELECT w.doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256, tail::BIGINT AS tail_crc32, (m + 44)::BIGINT AS media_bytes, sha256(unhex(wav)) AS media_sha256,
       'audio/wav;8000;8;samples=' || m || ';sum=' || total || ';turns=' || turns || ';declared=ok;embedded=0;carved=0' AS feature
FROM w JOIN s USING (doc_id) JOIN z USING (doc_id)
""",
}
