"""Queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.quality import apply_policy, ledger

    kept = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citeweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.pii import digests, find

    return digests(find(table(spark, sf_dir, "documents")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeweave.llm.chat import digests, format_conversations, with_probe

    return digests(format_conversations(with_probe(spark, table(spark, sf_dir, "conversations"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citeweave.llm.language import identify

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from citeweave.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills a stored ledger, shows that a second run finds nothing left to scan, and joins findings back from the stored rows."""
    import uuid

    from pyspark.sql import functions as F

    from citeweave.llm.secrets import address, findings, read_ledger, update_ledger
    from citeweave.sources.scratch import scratch_dir

    docs, path = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/secrets-ledger-{uuid.uuid4().hex}"
    update_ledger(docs, path, "doc_id")
    again = update_ledger(docs, path, "doc_id")
    if again:
        raise RuntimeError(f"a second run scanned {again} blobs")
    found = findings(address(docs, "doc_id"), read_ledger(spark, path))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "blob")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaimed
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1 FROM m),
f AS (SELECT *, f0::INT + 2 * f1::INT + 4 * (100 * n_symbols > 25 * n_words)::INT + 8 * (100 * n_upper > 60 * word_chars)::INT + 16 * (100 * n_exclaimed > 30 * n_words)::INT
  + 32 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT + 64 * (word_chars > 20 * n_words)::INT + 128 * (word_chars < 2 * n_words)::INT AS fail_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
v AS (SELECT conv_id, max((contains(t, '</turn>') OR contains(t, '### ') OR regexp_matches(t, '\\[ethcl]'))::INT) AS level FROM c GROUP BY 1),
s AS (SELECT c.*, level, CASE WHEN level = 0 THEN t ELSE replace(replace(replace(t, '\', '\e'), '</turn>', '\t'), '### ', '\h') END AS body FROM c JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  length(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(13 + length(r) + length(body))::BIGINT AS formatted_chars, max(level) AS level FROM s GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other operators learn, hash, tokenise or align, and are held against brute force in the tests."""
    return {"op1_quality": OP1, "op7_chat": OP7}
