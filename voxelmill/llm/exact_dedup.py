"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced
to one candidate for each digest (with map-side combine), the candidates that
the index holds already go by a sort-merge anti-join, and the rest is appended.
Only digests, lengths and ids are shuffled, never texts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, fresh_path

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text's UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests of all documents accepted so far.

    path: where the table's files are (shared storage). buckets: its number of
    buckets, by default that of shuffle partitions. It is stored beside the
    table, and a new DigestIndex on the same path, of any session, goes on with
    it; another number given then is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0):
        self.spark, self.path = spark, path
        self.buckets = self._stored(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, code_points BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _stored(self, wanted: int, otherwise: int) -> int:
        """The number of buckets of the index at the path, written if it is new."""
        name = f"{self.path.rstrip('/')}_buckets"
        try:
            held = self.spark.read.schema("buckets int").json(name).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = None
        if held is None:
            buckets = wanted or otherwise
            self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(name)
            return buckets
        if wanted and wanted != held["buckets"]:
            raise ValueError(f"the index at {self.path} has {held['buckets']} buckets, not {wanted}")
        return held["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, candidates: DataFrame) -> None:
        """Add the candidates (columns of the table) whose digest is new."""
        held = self.rows().select("digest")
        fresh = candidates.join(held.hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", "code_points", "group_size")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table, path=self.path)
        )
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, in_index.

    Equal texts (see normalised) form a group. Of a group that the index holds
    from an earlier batch no row is kept, and keep_id is that batch's document
    (in_index is true). Else the row with the most code points in its original
    text, then the smallest id, is kept and appended. group_size counts the
    group's rows in this batch. Null and empty texts are equal. Rows that repeat
    an id and a text are one document: all of them are kept or none. A null id
    sorts last and is kept only where no other row of its group has an id.
    Other columns of docs, whatever their names, are not read.
    """
    keyed = cut(
        docs.select(
            F.col(id).cast("long").alias("doc_id"),
            digest_of(F.col(text)).alias("digest"),
            F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("code_points"),
        )
    )
    best = F.min(F.struct((-F.col("code_points")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
    groups = cut(
        keyed.groupBy("digest")
        .agg(best.alias("b"), F.count("*").alias("group_size"))
        .select("digest", F.col("b.i").alias("best_id"), (-F.col("b.n")).alias("code_points"), "group_size")
    )
    held = index.rows().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("was_held"))
    judged = cut(
        groups.join(held.hint("merge"), "digest", "left").select(
            "digest",
            "group_size",
            F.when(F.col("was_held"), F.col("old_id")).otherwise(F.col("best_id")).alias("keep_id"),
            F.coalesce("was_held", F.lit(False)).alias("in_index"),
        )
    )
    index.append(groups.withColumnRenamed("best_id", "keep_id"))
    # plain exchanges on both sides: a digest of a third of all rows is split as a skewed join
    return keyed.join(judged, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("in_index") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "in_index",
    )


def row_key(id: Column, digest: Column) -> Column:
    """One binary key, never null, of an id that may be null and a digest of the row's text."""
    return F.concat(F.coalesce(id.cast("string"), F.lit("null")).cast("binary"), F.lit(":").cast("binary"), digest.cast("binary"))


def keep_documents(docs: DataFrame, kept: DataFrame, id: str = "doc_id", key: Column | None = None, first: Column | None = None) -> DataFrame:
    """The rows of docs whose key is in kept (one column, distinct), all columns.

    One row for each key stays, the first by `first`, so the key has to tell
    apart all rows that aren't copies (see row_key). Without a key it is the id:
    of rows that repeat an id any one stays, and rows without one go.
    """
    names = docs.columns
    keyed = docs.withColumn("__key", F.col(id) if key is None else key)
    keys = kept.select(F.col(kept.columns[0]).alias("__keep"))
    joined = keyed.join(keys, keyed["__key"] == keys["__keep"], "left_semi")
    one = Window.partitionBy("__key").orderBy("__key" if first is None else first)
    return joined.withColumn("__nth", F.row_number().over(one)).filter("__nth = 1").select(*names)


def keep_groups(docs: DataFrame, found: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs that found, the result of exact_dedup, marks kept; of
    rows that share id and normalised text the one with the most code points."""
    kept = found.filter("kept").select(row_key(F.col("doc_id"), F.unhex("text_sha256")).alias("k")).distinct()
    longest = F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(text))
    return keep_documents(docs, kept, id, row_key(F.col(id).cast("long"), digest_of(F.col(text))), longest)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest_index"))
