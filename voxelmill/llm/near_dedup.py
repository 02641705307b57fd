"""Near-dedup by the similarity of shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Equal sets are one node. Candidates come from two
sides: the pivot tables of SimHash link the closest copies (fingerprints within
2 bits), and, as most pairs near 0.8 are farther apart in their fingerprints,
nodes that share a band of their MinHash sketch (20 bands of 4 minima: a pair of
similarity 0.8 shares none with a probability of 3e-5, a closer one with less).
Every link is verified on the whole sets.

Only connected components are asked for, so pairs that are linked already are
not compared: first all members of a band's bucket meet its smallest member,
then, a few times, the members of a crowded bucket that hold several components
meet a leader of another one, and at last all pairs of a bucket that are still
in different components are compared, whatever the bucket's size. These last
pairs are told apart by parity sketches while they meet: two sketches differ in
no more bits than the sets in shingles, so what differs in too many bits is no
link, and of a crowd's pairs hardly others than links are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import cut, release
from .components import connected_components
from .simhash import link_fingerprints, majority

SEED, BANDS, ROWS = 42, 20, 4
#: Bits of a parity sketch; a multiple of 64.
PARITY_BITS = 1024
_DRAW = np.random.default_rng(SEED)
_TURN = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 of the word shingles, sorted. A text of fewer words is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the MinHash sketch."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        np.minimum(least, (grams[None, at : at + 4096] * _TURN[:, None] + _SHIFT[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def sketch(text: Column, words: int) -> Column:
    """node (XXH64 of the shingle set), n (its size), fp (its SimHash), keys (bands)."""

    @F.pandas_udf("node long, n long, fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            g = shingles(t, words)
            out.append((np.uint64(xxhash.xxh64_intdigest(g.tobytes(), SEED)).view(np.int64), len(g), majority(g), bands(g)))
        return pd.DataFrame(out, columns=["node", "n", "fp", "keys"])

    return of(text)


def gram_sets(text: Column, words: int) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts])

    return of(text)


def parity(grams: Column) -> Column:
    """The parity sketch of a set of shingles: each flips one of PARITY_BITS bits."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(sets: pd.Series) -> pd.Series:
        flips = lambda g: np.bincount(np.asarray(g, np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
        return pd.Series([np.packbits(flips(g).astype(np.uint8)).view(np.int64) for g in sets])

    return of(grams)


def meet(rows: DataFrame, by: str, least: float) -> DataFrame:
    """Pairs (u, v) of rows (by, node, n, component, bits) that share `by`, are
    of different components and may be `least` alike: sets that are differ in
    few enough shingles, so their parity sketches do in few enough bits."""
    words = range(PARITY_BITS // 64)
    # a column for each word, not null: the join's condition stays small enough to be compiled
    side = lambda x: rows.select(
        by, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component")], *[F.coalesce(F.col("bits")[k], F.lit(0)).alias(f"{x}{k}") for k in words]
    )
    n_u, n_v = F.col("n_u"), F.col("n_v")
    differ = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in words[1:]), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
    pairs = side("u").join(side("v"), by).filter("node_u < node_v AND component_u <> component_v")
    pairs = pairs.filter(F.least(n_u, n_v) >= F.lit(least) * F.greatest(n_u, n_v) - 1e-9)
    pairs = pairs.filter(differ <= F.lit((1 - least) / (1 + least)) * (n_u + n_v) + 1e-6)
    return pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))


def text_key(text: Column) -> Column:
    """A 64-bit hash of the text as it is; null differs from empty."""
    return F.xxhash64(text)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, grams) are at least `least` alike."""
    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    both = F.size(F.array_intersect("gu", "gv"))
    alike = both >= F.lit(least) * (F.size("gu") + F.size("gv") - both) - 1e-9
    return cut(pairs.join(left, "u").join(right, "v").filter(alike).select("u", "v"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints the pivot tables of simhash link:
    the smallest node of each fingerprint stands for it."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
    same = nodes.join(first, "fp").filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    links = link_fingerprints(first.select("fp"))
    left, right = (first.select(F.col("fp").alias(f), F.col("lead").alias(n)) for f, n in (("u", "a"), ("v", "b")))
    far = links.join(left, "u").join(right, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return same.union(far)


def rare_pairs(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes (node, n, component) of different components whose
    sets may be `least` alike: such sets share one of the first (1 - least) n + 1
    shingles of each, the nodes' rarest first. No pair that is alike is left out,
    and shingles that very many nodes share are used by those alone that have
    hardly others."""
    held = nodes.join(sets, "node")
    grams = held.select("node", "n", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).filter("often > 1")
    # a shingle of one node makes no pair, but takes a place among its first ones
    known = grams.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("often", "gram"))
    most = F.floor(F.lit(1 - least + 1e-9) * F.col("n")) + 1
    rare = cut(known.withColumn("nth", nth).filter((F.col("nth") <= most) & (F.col("often") > 1)).select("node", "gram"))
    signed = held.select("node", "n", "component", parity(F.col("grams")).alias("bits"))
    return meet(rare.join(signed, "node"), "gram", least)


def link_sets(nodes: DataFrame, sets_of, least: float = 0.8, crowd: int = 64, rounds: int = 4) -> DataFrame:
    """(node, component) of the nodes (node, n, fp, keys) that have a near copy.
    sets_of(some): (node, grams) of the nodes of some (node)."""
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n")).filter("c > 1")
    shared = cut(keyed.join(groups, "key"))
    close = cut(simhash_pairs(nodes.select("node", "fp")))
    release(nodes.sparkSession)
    sets = cut(sets_of(shared.select("node").union(close.select("u")).union(close.select("v")).distinct()))
    sized = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9

    pairs = shared.filter("node <> lead").filter(sized(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("u"), F.col("node").alias("v"))
    links = verified(pairs.union(close).distinct(), sets, least)
    before = None
    for turn in range(rounds + 1):
        parts = cut(connected_components(links))
        release(nodes.sparkSession)
        now = shared.select("key", "node", "n", "c").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # a bucket of one component is done
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        now = cut(now.join(mixed, "key"))
        crowded = now.filter(F.col("c") > crowd)
        many = crowded.count()
        # a round that hardly thins the crowds is not followed by others: what is left is not alike, or not to a leader
        last = turn == rounds or not many or (before is not None and many > 0.9 * before)
        before = many
        if last:
            signed = sets.select("node", parity(F.col("grams")).alias("bits"))
            some = meet(now.filter(F.col("c") <= crowd).join(signed, "node"), "key", least)
            if many:
                some = some.union(rare_pairs(crowded.select("node", "n", "component").distinct(), sets, least))
        else:
            rank = F.xxhash64("key", "node", F.lit(turn))
            lead = crowded.groupBy("key").agg(F.min_by(F.struct("node", "n", "component"), rank).alias("l"))
            some = crowded.join(lead, "key").filter("component <> l.component").filter(sized(F.col("n"), F.col("l.n")))
            some = some.select(F.least("node", "l.node").alias("u"), F.greatest("node", "l.node").alias("v"))
        links = cut(links.union(verified(some.distinct(), sets, least)))
        release(nodes.sparkSession)
        if last:
            break
    return connected_components(links)


def near_components(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, least: float = 0.8, crowd: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, component_id, kept.

    Rows are in one component if a chain of texts leads from one to the other
    whose neighbours are at least `least` alike in their sets of `words`-word
    shingles. component_id is the smallest id of the component, kept is true for
    the row of that id; of rows that share it, for the smallest text_key. A null
    id counts only where its component has no other. Texts without words are
    alike. Rows of one id and one text are all kept or none. Other columns
    aren't read.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"))
    marked = cut(rows.withColumn("s", sketch(F.col("text"), words)).select("doc_id", "text_key", "s.node", "s.n", "s.fp", "s.keys"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_key").alias("k")))
    nodes = cut(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), first.alias("first")))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = nodes.join(some, "node").select("node", F.col("first.k").alias("text_key"))
        texts = rows.select("text_key", "text").join(wanted, "text_key").dropDuplicates(["node"])
        return texts.select("node", gram_sets(F.col("text"), words).alias("grams"))

    parts = link_sets(nodes.select("node", "n", "fp", "keys"), sets_of, least, crowd)
    member = nodes.select("node", "first").join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = member.groupBy("component").agg(F.min("first").alias("best"))
    named = cut(member.join(named, "component").select("node", "best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("text_key") == F.col("best.k"))
    return marked.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", F.col("best.i").alias("component_id"), kept.alias("kept"))
