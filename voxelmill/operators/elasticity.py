"""Eight-node brick elements on a regular grid: stiffness, products, solution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CORNERS = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)


def elasticity(modulus: float, ratio: float) -> np.ndarray:
    """The 6 x 6 isotropic matrix (xx, yy, zz, xy, yz, zx)."""
    lam, mu = modulus * ratio / ((1 + ratio) * (1 - 2 * ratio)), modulus / (2 * (1 + ratio))
    d = np.zeros((6, 6))
    d[:3, :3] = lam
    d[np.arange(3), np.arange(3)] += 2 * mu
    d[np.arange(3, 6), np.arange(3, 6)] = mu
    return d


def strain(at: np.ndarray, edge: float) -> np.ndarray:
    """The 6 x 24 strain matrix of a cube at a point of -1..1."""
    signs = 2 * CORNERS - 1
    slope = np.empty((8, 3))
    for axis in range(3):
        others = [a for a in range(3) if a != axis]
        slope[:, axis] = signs[:, axis] * np.prod(1 + signs[:, others] * at[others], axis=1) / 8 * (2 / edge)
    b = np.zeros((6, 24))
    for n, (x, y, z) in enumerate(slope):
        b[:, 3 * n : 3 * n + 3] = [[x, 0, 0], [0, y, 0], [0, 0, z], [y, x, 0], [0, z, y], [z, 0, x]]
    return b


def stiffness(modulus: float, ratio: float, edge: float) -> np.ndarray:
    """The 24 x 24 stiffness of a cube, by 2 x 2 x 2 Gauss points."""
    d, g, k = elasticity(modulus, ratio), 1 / np.sqrt(3), np.zeros((24, 24))
    for point in (2 * CORNERS - 1) * g:
        b = strain(point, edge)
        k += b.T @ d @ b * (edge / 2) ** 3
    return k


def _nodes(x, y, z):
    return F.array(*[F.struct((x + int(i)).alias("x"), (y + int(j)).alias("y"), (z + int(k)).alias("z")) for i, j, k in CORNERS])


def product(elements: DataFrame, nodes: DataFrame, kernel: np.ndarray, value: str) -> DataFrame:
    """K times a nodal vector (node struct, `value` array of 3): node, ku. Elements:
    x, y, z, scale. Gather by a join, multiply by rows of Arrow, scatter by a sum."""
    each = elements.select("x", "y", "z", "scale", F.posexplode(_nodes(F.col("x"), F.col("y"), F.col("z"))).alias("c", "node"))
    met = each.join(nodes.select("node", F.col(value).alias("v")), "node")
    rows = met.groupBy("x", "y", "z").agg(F.max("scale").alias("scale"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("r"))
    rows = rows.select("x", "y", "z", "scale", F.flatten(F.transform("r", lambda e: e["v"])).alias("u"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                f = (np.stack(batch["u"].to_numpy()) @ kernel.T) * batch["scale"].to_numpy()[:, None]
                yield batch[["x", "y", "z"]].assign(f=list(f))

    kind = elements.schema["x"].dataType.simpleString()
    forces = rows.mapInPandas(multiply, f"x {kind}, y {kind}, z {kind}, f array<double>")
    sent = forces.select(F.posexplode(_nodes(F.col("x"), F.col("y"), F.col("z"))).alias("c", "node"), "f")
    sums = [F.sum(F.element_at("f", F.col("c") * 3 + (i + 1))) for i in range(3)]
    return sent.groupBy("node").agg(F.array(*sums).alias("ku"))


def _dot(a: str, b: str):
    return F.sum(sum((F.col(a)[i] * F.col(b)[i] for i in (1, 2)), F.col(a)[0] * F.col(b)[0]))


def _plus(a: str, b: str, t: float):
    return F.zip_with(a, b, lambda p, q: p + q * t)


def solve(elements: DataFrame, fixed, forces: DataFrame, kernel: np.ndarray, tol: float = 1e-6, most: int = 400) -> DataFrame:
    """Nodal displacements (node, u): K u = f with the nodes where `fixed` (a
    column on node.x, node.y, node.z) holds kept at 0. forces: node, f."""
    nodes = elements.select(F.explode(_nodes(F.col("x"), F.col("y"), F.col("z"))).alias("node")).distinct()
    zero = F.array(*[F.lit(0.0)] * 3)
    free = ~fixed
    state = nodes.join(forces, "node", "left").select("node", free.alias("free"), F.when(free, F.coalesce("f", zero)).otherwise(zero).alias("r"))
    state = cut(state.withColumn("u", zero).withColumn("p", F.col("r")))
    rr = state.agg(_dot("r", "r")).first()[0] or 0.0
    goal = rr * tol * tol
    for _ in range(most):
        if rr <= goal:
            return state.select("node", "u")
        state = state.join(product(elements, state, kernel, "p"), "node", "left")
        state = cut(state.withColumn("ku", F.when(F.col("free"), F.coalesce("ku", zero)).otherwise(zero)))
        alpha = rr / state.agg(_dot("p", "ku")).first()[0]
        state = state.select("node", "free", _plus("u", "p", alpha).alias("u"), _plus("r", "ku", -alpha).alias("r"), "p")
        new = state.agg(_dot("r", "r")).first()[0]
        state = state.select("node", "free", "u", "r", _plus("r", "p", new / rr).alias("p"))
        rr = new
    raise RuntimeError(f"no solution after {most} steps: {rr}")
