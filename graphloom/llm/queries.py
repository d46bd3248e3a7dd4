"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import audio, bitpack, chat, curve, decon, katz, knn, rlz, shards, superminhash, tokens
from graphloom.llm.store import table

N_SHARDS = 40


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents, trained on those outside fold 2 of 7."""
    return katz.score(table(spark, sf_dir, "documents"), 7, 2)


def op2_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 13-word windows of earlier documents, removed."""
    return rlz.digest(table(spark, sf_dir, "documents"), 13)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target expansion of all conversations, and one that speaks control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat.digest(chat.expand(rows.unionByName(extra)))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards of near equal bytes by 4,096 virtual slots."""
    return shards.assign(table(spark, sf_dir, "documents"), N_SHARDS)[0]


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    return superminhash.digest(table(spark, sf_dir, "documents"), 3, 85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows outside fold 0 of 5."""
    return knn.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0)


def op6_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as bit-packed token files, read back."""
    return bitpack.read(bitpack.write(table(spark, sf_dir, "documents"), tokens.vocabulary_path()))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes as stored telephony audio, read back and decoded."""
    return audio.digest(audio.store(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a benchmark item, with the item and the alignment score."""
    return decon.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along a Hilbert curve into sequences of 2,048 ids."""
    path = tokens.vocabulary_path()
    return curve.with_crc(curve.pack(table(spark, sf_dir, "documents"), path, 2048), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_rlz": op2_rlz,
    "op3_chat": op3_chat,
    "op4_superminhash": op4_superminhash,
    "op5_toxicity": op5_toxicity,
    "op6_bitpack": op6_bitpack,
    "op7_shards": op7_shards,
    "op8_audio": op8_audio,
    "op9_decontamination": op9_decontamination,
    "op10_curve": op10_curve,
}

SQL: dict[str, str] = {
    "op3_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\[<\\\\]', '', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length(role) + length(regexp_replace(role, '[^\\[<\\\\]', '', 'g')) END AS written
  FROM c),
w AS (
  SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = count(*) OVER (PARTITION BY conv_id) AS final
  FROM l)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR final THEN upto END) AS BIGINT) AS formatted_chars,
  count(CASE WHEN role = 'assistant' OR final THEN 1 END) AS n_examples
FROM w GROUP BY conv_id
""",
}
