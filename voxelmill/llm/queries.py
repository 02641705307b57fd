"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import chat_format, conversation_repair, embedding_dedup, exact_dedup, language_id, license_scan, mixing, packing, pii, secret_scan, simhash, token_files, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    model = chat_format.RoleModel.learn(turns.filter(~language_id.held_out(F.col("conv_id"))))
    found = chat_format.render(chat_format.recover_roles(turns.drop("role"), model))
    return found.select("conv_id", "turn", "part", "role", "rendered")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select(
        "doc_id",
        language_id.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS)


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token_ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), path)
    return token_files.documents(token_files.read_blocks(spark, path))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(turns))
    return conversation_repair.repaired_table(turns, found)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books, _ = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return vector_codes.code_table(spark, codes, books)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_license_scan": op4_license_scan,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_pii": op10_pii,
    "op11_token_output": op11_token_output,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS kept,
       text_sha256
FROM d""",
    "op4_license_scan": license_scan.oracle_sql(),
    "op12_conversation_repair": conversation_repair.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
