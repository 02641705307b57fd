"""Validation as queries: manifests, arrays, partitions of sets, status roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = ("pass", "warn", "fail")


def compare_manifest(expected: DataFrame, actual: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """A status for each expected row: missing, size, digest or same."""
    e = expected.select(key, F.col(size).alias("e_size"), F.col(digest).alias("e_digest"))
    a = actual.select(key, F.col(size).alias("a_size"), F.col(digest).alias("a_digest"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(~F.col("e_size").eqNullSafe(F.col("a_size")), "size")
    status = status.when(~F.col("e_digest").eqNullSafe(F.col("a_digest")), "digest").otherwise("same")
    return e.join(a, key, "left").select(key, status.alias("status"))


def compare_arrays(actual: DataFrame, expected: DataFrame, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """For each key of (key, idx, value) tables: rows on both sides, on one only,
    the largest difference, and whether all are close."""
    a = actual.select("key", "idx", F.col("value").alias("a"), F.lit(1).alias("ia"))
    b = expected.select("key", "idx", F.col("value").alias("b"), F.lit(1).alias("ib"))
    gap = F.abs(F.col("a") - F.col("b"))
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    close = both & (gap <= F.abs(F.col("b")) * rtol + atol)
    return a.join(b, ["key", "idx"], "full_outer").groupBy("key").agg(
        F.sum(both.cast("long")).alias("n_both"), F.sum((~both).cast("long")).alias("n_one"), F.max(gap).alias("max_error"), F.coalesce(F.every(close), F.lit(False)).alias("close")
    )


def roll_up(checks: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """The worst status of each group."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    worst = F.max(rank)
    return checks.groupBy(*group).agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), worst.cast("int")).alias("status"), F.count("*").alias("n"))


def membership(sets: dict[str, DataFrame], id: str) -> DataFrame:
    """(id, n_sets, in_<name>...): in which of the named id sets each id is."""
    tagged = None
    for name, df in sets.items():
        part = df.select(F.col(id).alias("id"), F.lit(name).alias("s"))
        tagged = part if tagged is None else tagged.union(part)
    flags = [F.max((F.col("s") == n).cast("int")).alias(f"in_{n}") for n in sets]
    total: Column = F.lit(0)
    for n in sets:
        total = total + F.col(f"in_{n}")
    return tagged.groupBy("id").agg(*flags).withColumn("n_sets", total)


def field_checks(df: DataFrame, required: list[str], finite: list[str], nonzero: list[str]) -> DataFrame:
    """One row for each rule (name, status) on a table's columns."""
    rows = [F.struct(F.lit(f"has {c}").alias("name"), F.lit("pass" if c in df.columns else "fail").alias("status")) for c in required]
    held = [c for c in dict.fromkeys([*finite, *nonzero]) if c in df.columns]
    bad = {c: F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long")) for c in held}
    top = {c: F.max(F.abs(F.col(c).cast("double"))) for c in held}
    rows += [F.struct(F.lit(f"finite {c}").alias("name"), F.when(bad[c] > 0, "fail").otherwise("pass").alias("status")) for c in finite if c in held]
    rows += [F.struct(F.lit(f"nonzero {c}").alias("name"), F.when(top[c] > 0, "pass").otherwise("warn").alias("status")) for c in nonzero if c in held]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
