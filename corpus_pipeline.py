"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes the rows that its predecessor wrote and acts on all of them;
all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import exact_dedup, language_id, mixing, near_dedup, packing
from voxelmill.session import fresh_path

#: A text is rejected if no language has this mean probability: it has no
#: letters, or no learned language fits. Texts that switch between two
#: languages stay.
LEAST_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; rejected documents go."""
    found = language_id.identify(docs, language_id.learn(docs), out="__language")
    kept = (F.col("__language.lang") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    return found.filter(kept).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup against an index that starts empty; one document of each group stays."""
    found = exact_dedup.exact_dedup(docs, exact_dedup.new_index(spark))
    return exact_dedup.keep_groups(docs, found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: five-word shingles, similarity 0.8; the document with the smallest id of each group stays."""
    found = near_dedup.near_components(docs)
    kept = found.filter("kept").select(exact_dedup.row_key(F.col("doc_id"), F.col("text_key").cast("string")).alias("k")).distinct()
    key = exact_dedup.row_key(F.col("doc_id").cast("long"), near_dedup.text_key(F.col("text")).cast("string"))
    return exact_dedup.keep_documents(docs, kept, key=key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document comes as often as the mix takes it,
    up to 3 times; the fraction left by whole passes is drawn by its id."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 4096 tokens; a row for each piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the language model, the mix's draws or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
