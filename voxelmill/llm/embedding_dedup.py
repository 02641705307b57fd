"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one and halved. Two codebooks, one for each half,
fitted on a bounded sample, make a product grid of cells; each vector is filed
under its label and cell. A vector visits cells in the order of the multi-
sequence: by the sum of two costs, one for each half, where a half's cost for a
codeword is the squared distance that the half must move before that codeword is
its nearest. Visits stop at the cost that reaches the target recall: a
neighbour at the least cosine moves by a known length, so the cost at which such
moves are found with that recall is measured on moved copies of the sample.
Cells are then compared in blocks of bounded size, and a link is kept only if
its cosine in double precision is at least the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected_components

BLOCK = 1024
CELL_ROWS = 192


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / np.where(top > 0, top, 1)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def codebook(points: np.ndarray, words: int, rng: np.random.Generator, passes: int = 12) -> np.ndarray:
    """k-means centres of points."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    centres = points[rng.choice(len(points), min(words, len(points)), replace=False)].copy()
    for _ in range(passes):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between codewords."""
    return np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 0))


def move_costs(points: np.ndarray, centres: np.ndarray, gap: np.ndarray | None = None) -> np.ndarray:
    """For each point and codeword: the squared length of the shortest move (as
    the farthest of the bisecting planes bounds it) that makes it the nearest."""
    d = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    nearest = np.argmin(d, axis=1)
    gap = gaps(centres) if gap is None else gap
    own = d[np.arange(len(d)), nearest]
    apart = gap[nearest]
    reach = np.where(apart > 0, (d - own[:, None]) / np.maximum(2 * apart, 1e-12), 0.0)
    return np.maximum(reach, 0) ** 2


class MultiIndex:
    """The codebooks and the cost at which visits stop.

    sample: scaled vectors, at most sample_rows of them (a documented bound);
    words: codewords of each half; recall: the share of neighbours at exactly
    the least cosine that the visits must reach.
    """

    def __init__(self, sample: np.ndarray, words: int, least_cosine: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        self.books = [codebook(part, words, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.gaps = [gaps(b) for b in self.books]
        some = sample[rng.permutation(len(sample))[:2000]]
        noise = rng.standard_normal((4, *some.shape))
        at = []
        for n in noise:
            n = unit(n - (n * some).sum(1, keepdims=True) * some)
            moved = least_cosine * some + np.sqrt(1 - least_cosine**2) * n
            costs = self.costs(some)
            cells = self.cells(moved)
            at.append(sum(c[np.arange(len(c)), cells[:, k]] for k, c in enumerate(costs)))
        self.stop = float(np.quantile(np.concatenate(at), recall)) + 1e-12

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.argmin((b**2).sum(1) - 2 * p @ b.T, axis=1) for p, b in zip(self.halves(vectors), self.books, strict=True)], axis=1)

    def costs(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (move_costs(p, c, g) for p, c, g in zip(self.halves(vectors), self.books, self.gaps, strict=True))
        return a, b

    def visits(self, vectors: np.ndarray) -> list[list[int]]:
        """The cells of each vector within the stop, by rising cost."""
        out = []
        width = len(self.books[1])
        for a, b in zip(*self.costs(vectors), strict=True):
            first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            sa, sb = a[first], b[second]
            # row i of the grid of sorted costs is within the stop up to upto[i]
            upto = np.searchsorted(sb, self.stop - sa, side="right")
            rows = np.repeat(np.arange(len(sa)), upto)
            cols = np.arange(len(rows)) - np.repeat(np.cumsum(upto) - upto, upto)
            order = np.argsort(sa[rows] + sb[cols], kind="stable")
            out.append((first[rows] * width + second[cols])[order].tolist())
        return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def find_links(vectors: DataFrame, indexes: dict[int, MultiIndex], least_cosine: float) -> DataFrame:
    """vectors (row, label, d: length, copies, v: array) to rows (row, linked,
    root): linked counts new links of `row` in one pair of blocks, each as often
    as the other side has copies; (row, root) edges join the same rows as the
    links do. row is unique. indexes: by length; only vectors of one label and
    length meet."""
    kind, label = (vectors.schema[c].dataType.simpleString() for c in ("v", "label"))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, own in batch.groupby("d"):
                index = indexes[int(d)]
                width = len(index.books[1])
                for at in range(0, len(own), 2048):
                    part = own.iloc[at : at + 2048]
                    v = unit(_stack(part["v"]))
                    cells = index.cells(v)
                    yield part.assign(cell=cells[:, 0] * width + cells[:, 1], visits=index.visits(v))

    group = ["label", "d", "cell"]
    filed = cut(vectors.mapInPandas(file, f"row long, label {label}, d int, copies long, v {kind}, cell long, visits array<long>"))
    home = filed.groupBy(*group).agg(F.count("*").alias("n_home"))
    asked = filed.select("label", "d", F.explode("visits").alias("cell")).groupBy(*group).agg(F.count("*").alias("n_asked"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    sizes = cut(home.join(asked, group).select(*group, parts("n_home").alias("hs"), parts("n_asked").alias("as")))
    spot = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.select("row", "label", "d", "copies", "v", F.explode("visits").alias("cell")).join(sizes, group)
    left = left.withColumn("a", spot(1, "as")).withColumn("h", span("hs")).select(*group, "a", "h", "row", "copies", "v")
    right = filed.select("row", "label", "d", "copies", "v", "cell").join(sizes, group)
    right = right.withColumn("h", spot(2, "hs")).withColumn("a", span("as")).select(*[F.col(c).alias(c) for c in (*group, "a", "h", "row", "copies", "v")])

    def compare(asks: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"row": [], "linked": [], "root": []}, dtype="int64")
        if not len(asks) or not len(homes):
            return empty
        index = indexes[int(asks["d"].iloc[0])]
        x, y = unit(_stack(asks["v"])), unit(_stack(homes["v"]))
        rx, ry = asks["row"].to_numpy(), homes["row"].to_numpy()
        near = (x @ y.T >= least_cosine) & (rx[:, None] != ry)
        if not near.any():
            return empty
        i, j = np.nonzero(near)
        # a home row that visits the asking row's cell finds the link itself
        keep = np.unique(j)
        ya, yb = index.costs(y[keep])
        cx = index.cells(x)
        jj = np.searchsorted(keep, j)
        alone = ya[jj, cx[i, 0]] + yb[jj, cx[i, 1]] > index.stop
        rows = np.concatenate([rx, ry])
        # counts are whole numbers far below 2^53, so sums in doubles are exact
        of_x = np.bincount(i, homes["copies"].to_numpy(np.float64)[j], len(rx))
        of_y = np.bincount(j[alone], asks["copies"].to_numpy(np.float64)[i[alone]], len(ry))
        counts = np.concatenate([of_x, of_y]).astype(np.int64)
        root = _roots(rows, i, j + len(rx))
        used = (counts > 0) | (root != rows)
        return pd.DataFrame({"row": rows[used], "linked": counts[used], "root": root[used]})

    keys = [*group, "a", "h"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "row long, linked long, root long")


def _roots(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each over links between positions i, j."""
    root = rows.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            return root


def embedding_components(
    vectors: DataFrame,
    least_cosine: float = 0.93,
    recall: float = 0.995,
    sample_rows: int = 20_000,
    seed: int = 7,
    embedding: str = "embedding",
    id: str = "vec_id",
    label: str = "label",
) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Only vectors with equal labels (of any type) that are not null are compared.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing; vectors are compared with those of their own length only. n_links counts other vectors within
    the cosine; component_id is the smallest id reachable. Links found are
    exact; `recall` of those at the very threshold are expected to be found,
    more of the closer ones. Vectors that are equal component by component (by
    128 bits of hashes) are compared as one and count as often as they come. The
    codebooks of all lengths are fitted on a sample of about sample_rows vectors,
    and one more for each length, and grow with the square root of the largest
    label; every vector is filed and asked for. Rows that repeat an id are linked
    as rows of their own. A null id links with nothing. Empty tables give no rows. Other columns aren't read.
    """
    # vectors travel as they are stored; each comparison scales them in double precision
    v = F.col(embedding) if vectors.schema[embedding].dataType.simpleString() == "array<float>" else F.col(embedding).cast("array<double>")
    base = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    usable = usable & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    hashes = [F.when(usable, F.xxhash64(F.lit(k), "label", "v")).alias(f"h{k}") for k in (1, 2)]
    base = base.select("vec_id", "label", "v", *hashes)

    copies = base.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("v").alias("v")
    )
    # a number for each different vector, fixed by what is written
    nodes = cut(copies.withColumns({"row": F.monotonically_increasing_id(), "d": F.size("v")}))
    sizes = nodes.groupBy("d", "label").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()
    if not sizes:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = F.lit(1.3 * sample_rows / len(sizes) * (1 << 20)) / F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.d, r.n)]), F.col("d"))
    picked = nodes.filter(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 20)) < share).select("d", "v")
    one = nodes.groupBy("d").agg(F.min_by("v", "h1").alias("v"))
    samples: dict[int, list] = {}
    for r in picked.union(one).collect():
        samples.setdefault(r.d, []).append(r.v)
    words = {r.d: max(2, int(np.sqrt(r.most / CELL_ROWS))) for r in sizes}
    indexes = {d: MultiIndex(unit(np.array(v, dtype=np.float64)), words[d], least_cosine, recall, seed) for d, v in samples.items()}
    links = find_links(nodes.select("row", "label", "d", "copies", "v"), indexes, least_cosine)
    found = cut(links.groupBy("row", "root").agg(F.sum("linked").alias("linked")))
    edges = found.filter("row <> root").select(F.col("row").alias("u"), F.col("root").alias("v"))
    parts = connected_components(edges)
    counts = found.groupBy("row").agg(F.sum("linked").alias("linked"))
    named = nodes.select("h1", "h2", "row", "copies", "least_id").join(counts, "row", "left").join(parts, F.col("row") == parts["node"], "left")
    links = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
    named = cut(named.select("h1", "h2", "least_id", links.alias("links"), F.coalesce("component", "row").alias("part")))
    first = named.groupBy("part").agg(F.min("least_id").alias("component"))
    named = named.join(first, "part").select("h1", "h2", "links", "component")
    component = F.coalesce("component", "vec_id")
    return base.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
