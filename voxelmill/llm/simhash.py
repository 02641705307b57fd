"""SimHash near-dedup with pivot distance tables.

Fingerprints: 64 bits over XXH64 (seed 42) of word shingles. Equal fingerprints
are one node. Each node gets a row of distances to reference fingerprints
(pivots): zero, a mask for each block of two bits, and pseudorandom ones. Two
fingerprints within `radius` bits differ by at most `radius` in every coordinate
of that table, so a pair whose largest coordinate difference is over `radius` is
discarded, and the bits of the others are compared.

The table also says which pairs to look at. The distances to zero and to a mask
tell how many bits of the mask's block are set, and bits that differ in at most
two places change at most two blocks. The blocks' coordinates are put in six
groups, so fingerprints within two bits agree in all coordinates of at least
four groups, and each choice of four groups is an equality key (about 32 bits of
information). A key with up to `crowd` nodes is joined with itself. In a crowded
key, as around a family of near copies, no pairs are made: each node is put
under every fingerprint within radius / 2 bits of it, and those that meet under
one such centre are within `radius` (for radius 2 the two statements are the
same thing, so no link is lost). The smallest member of a centre stands for its
links, 65 rows a node at most, whatever the family's size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut
from .components import connected_components

BITS, BLOCK, GROUPS, SEED = 64, 2, 6, 42
BLOCKS = BITS // BLOCK


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a text. Null, or no words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The signed 64-bit fingerprint of hashes: bits set in over half of them."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def references(extra: int = 8) -> list[int]:
    """Fixed reference fingerprints: 0, a mask for each block, then `extra` pseudorandom ones."""
    masks = [0] + [((1 << BLOCK) - 1) << (BLOCK * b) for b in range(BLOCKS)]
    random = [xxhash.xxh64_intdigest(f"reference {k}".encode(), SEED) for k in range(extra)]
    return [x - (1 << 64) if x >> 63 else x for x in masks + random]


def pivot_row(fp: Column, pivots: list[int]) -> Column:
    """The distances to the references, as an array of bytes."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots])


def pivot_groups(row: Column) -> Column:
    """For each group of blocks, its blocks' coordinates as one number."""
    base = BLOCK + 1
    # bits set in block b, from the distances to zero and to the block's mask
    held = lambda b: F.shiftright(row[0] - row[b + 1] + BLOCK, 1).cast("long")
    return F.array(*[sum((held(b) * base**b for b in range(g + GROUPS, BLOCKS, GROUPS)), held(g) * base**g) for g in range(GROUPS)])


def pivot_keys(groups: Column) -> Column:
    """(groups, value) for each choice of all but two of pivot_groups."""
    keys = [
        F.struct(F.lit(n).cast("tinyint").alias("groups"), sum((groups[g] for g in some[1:]), groups[some[0]]).alias("value"))
        for n, some in enumerate(combinations(range(GROUPS), GROUPS - 2))
    ]
    return F.array(*keys)


def near_pairs(keyed: DataFrame, radius: int, coordinates: int) -> DataFrame:
    """Pairs (u, v) of keyed (groups, value, fp, row) that share a key and are
    not discarded by the table."""
    left = keyed.select("groups", "value", F.col("fp").alias("u"), F.col("row").alias("ru"))
    right = keyed.select("groups", "value", F.col("fp").alias("v"), F.col("row").alias("rv"))
    pairs = left.join(right, ["groups", "value"]).filter("u < v")
    for k in range(coordinates):
        pairs = pairs.filter(F.abs(F.col("ru")[k] - F.col("rv")[k]) <= radius)
    return pairs.select("u", "v")


def link_fingerprints(nodes: DataFrame, radius: int = 2, extra: int = 8, crowd: int = 32) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` of nodes just as
    all pairs within `radius` (2) bits do."""
    if radius != 2:
        raise ValueError("groups and centres are laid out for a radius of 2 bits")
    refs = references(extra)
    table = nodes.select("fp", pivot_row(F.col("fp"), refs[: BLOCKS + 1]).alias("row")).select("fp", pivot_groups(F.col("row")).alias("g"))
    # kept, as the keys are made twice; 56 bytes a node
    table = cut(table.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    keyed = table.select("fp", F.explode(pivot_keys(F.col("g"))).alias("k")).select("fp", "k.groups", "k.value")
    sizes = keyed.groupBy("groups", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["groups", "value"]))

    small = shared.filter(F.col("n") <= crowd).withColumn("row", pivot_row(F.col("fp"), refs))
    near = near_pairs(small, radius, len(refs)).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)

    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)) for b in range(BITS)])
    crowded = shared.filter(F.col("n") > crowd).select("fp").distinct()
    centres = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    # at most 65 fingerprints are within one bit of a centre
    met = centres.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("all")).filter(F.size("all") > 1)
    starred = met.select(F.explode(F.slice(F.col("all"), 2, BITS)).alias("v"), F.col("all")[0].alias("u")).select("u", "v")
    return near.union(starred).distinct()


def simhash_components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints that differ in
    at most 2 bits. Null, empty and blank texts have fingerprint zero and link
    like any other. Rows that repeat an id are rows of their own; a null id
    counts only where its component has no other. Other columns aren't read.
    """
    marked = cut(docs.select(F.col(id).cast("long").alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(link_fingerprints(nodes))
    member = nodes.join(parts, nodes["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    linked = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(member.join(linked, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
