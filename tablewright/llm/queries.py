"""One query for each operator, over its whole table, and SQL where SQL can
say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, jaccard_join, langid, media, packing, pii, token_counts, toxicity
from .common import documents

#: Where the public vocabulary files lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def vocabulary() -> str:
    return f"{TOKENIZERS}/byte_bpe_50k.json"


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), "n_iban", "n_secret", F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return toxicity.score(docs, field, keep_spans=False).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_toxic_words")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(documents(spark, sf_dir), vocabulary())


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), keep_media=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary(), keep_ids=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message: its call's id, whether it is linked and valid, the call's
    level and a digest of the canonical JSON."""
    calls = chat.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    linked = chat.link_tool_calls(calls, chat.CONVERSATION_SCHEMAS)
    return linked.select("conv_id", "turn", "role", F.col("id").alias("call_id"), "linked", "valid", "level", F.sha2("canonical", 256).alias("canonical_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.learn(docs, remainder(4) != 2))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_pii, op3_toxicity, op4_jaccard_join, op5_token_counts, op6_media, op7_exact_dedup, op8_bpe, op9_chat, op10_langid, pipeline)}


OP7_SQL = """
SELECT doc_id, keep_id, group_size,
       doc_id = keep_id AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""

OP9_SQL = """
WITH RECURSIVE m AS (
  SELECT *, CASE WHEN role = 'user' THEN conv_id || ':' || turn
                 WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
calls AS (SELECT DISTINCT conv_id, turn, call_id FROM m WHERE role = 'user'),
lv AS (
  SELECT c.*, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, c.call_id, lv.level + 1
  FROM lv JOIN calls c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
answered AS (SELECT DISTINCT call_id FROM m WHERE role = 'assistant')
SELECT m.conv_id, m.turn, m.role, m.call_id,
       CASE WHEN m.role = 'user' THEN a.call_id IS NOT NULL
            WHEN m.role = 'assistant' THEN lv.call_id IS NOT NULL END AS linked,
       CASE WHEN m.role = 'user' THEN m.text IS NOT NULL END AS valid,
       lv.level AS level,
       sha256(CASE WHEN m.role = 'user'
         THEN '{"arguments":{"text":' || to_json(m.text) || ',"turn":' || m.turn || '},"call_id":' || to_json(m.call_id) || ',"name":"reply"'
         ELSE '{' || CASE WHEN m.call_id IS NULL THEN '' ELSE '"call_id":' || to_json(m.call_id) || ',' END || '"content":' || to_json(m.text) END
         || ',"role":' || to_json(m.role) || ',"turn":' || m.turn || '}') AS canonical_sha256
FROM m LEFT JOIN lv ON lv.call_id = m.call_id LEFT JOIN answered a ON a.call_id = m.call_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, md5_number_lower(unnest(g)) AS t FROM s),
d AS (SELECT t, count(*) AS df FROM e GROUP BY t HAVING count(*) > 1),
r AS (SELECT e.doc_id, e.t, coalesce(d.df, 1) AS df,
             row_number() OVER (PARTITION BY e.doc_id ORDER BY coalesce(d.df, 1), e.t) AS place
      FROM e LEFT JOIN d USING (t)),
p AS (SELECT r.doc_id, t FROM r JOIN n USING (doc_id) WHERE df > 1 AND place <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.t = y.t AND x.doc_id < y.doc_id),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op9_chat": OP9_SQL}
