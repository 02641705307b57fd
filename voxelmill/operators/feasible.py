"""A point inside each cell's half-spaces.

Whether a start or the box's middle will do is an aggregate over the planes.
Only for cells where neither does, the centre of the largest ball inside is
found: a linear programme in four unknowns (the point and the radius), solved
by a randomised incremental method that folds over the cell's planes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
Box = tuple[tuple[float, float, float], tuple[float, float, float]]
TOL = 1e-9
#: Normals shorter than this say nothing about places.
FLAT = 1e-12


def maximise(c: np.ndarray, a: np.ndarray, b: np.ndarray, most: float, r: np.random.Generator, tol: float = 1e-10) -> np.ndarray | None:
    """An x of largest c x with a x <= b and |x| <= most in each unknown; None
    without one. Rows of a are taken in random order; the first row that the
    best point so far breaks is met with equality, which leaves a programme of
    one unknown less over the rows before it."""
    n = np.abs(a).max(1, initial=0.0)
    none = n <= FLAT
    if (b[none] < -tol).any():
        return None
    a, b = a[~none] / n[~none, None], b[~none] / n[~none]
    if len(c) == 1:
        up, down = a[:, 0] > 0, a[:, 0] < 0
        high = min(most, (b[up] / a[up, 0]).min(initial=np.inf))
        low = max(-most, (b[down] / a[down, 0]).max(initial=-np.inf))
        if low > high + tol:
            return None
        return np.array([max(low, min(high, high if c[0] >= 0 else low))])
    order = r.permutation(len(a))
    a, b = a[order], b[order]
    x, k = np.where(c >= 0, most, -most).astype(float), 0
    while True:
        broken = a[k:] @ x > b[k:] + tol * max(1.0, np.abs(x).max())
        if not broken.any():
            return x
        k += int(np.argmax(broken))
        j = int(np.abs(a[k]).argmax())
        others = np.arange(len(c)) != j
        share = a[k, others] / a[k, j]
        rows = np.concatenate([a[:k], np.eye(len(c))[[j]], -np.eye(len(c))[[j]]])
        right = np.concatenate([b[:k], [most, most]])
        y = maximise(c[others] - c[j] * share, rows[:, others] - rows[:, [j]] * share, right - rows[:, j] * b[k] / a[k, j], most, r, tol)
        if y is None:
            return None
        x = np.empty(len(c))
        x[others], x[j] = y, b[k] / a[k, j] - share @ y
        k += 1


def inner_centre(normals: np.ndarray, rhs: np.ndarray, most: float, seed: int = 0) -> tuple[np.ndarray, float] | None:
    """(centre, radius) of a largest ball inside n p <= rhs; None if no ball of some size is."""
    size = np.sqrt((normals**2).sum(1))
    size = np.where(size <= FLAT, 1.0, size)
    rows = np.concatenate([np.c_[normals / size[:, None], np.ones(len(rhs))], [[0.0, 0.0, 0.0, -1.0]]])
    x = maximise(np.array([0.0, 0.0, 0.0, 1.0]), rows, np.r_[rhs / size, 0.0], most, np.random.default_rng(seed))
    return None if x is None or x[3] <= TOL else (x[:3], float(x[3]))


def feasible_points(planes: DataFrame, starts: DataFrame, cell: list[str], box: Box, margin: float = 1e-6) -> DataFrame:
    """(cell, how, x, y, z, slack): a point of each cell of starts (cell, x, y, z)
    that violates none of its planes (cell, nx, ny, nz, rhs; n p <= rhs).

    how: `start`, moved into the box where it is outside; else `middle`, that of
    the box; else `inner`, the centre of a largest ball, no coordinate of which
    exceeds a thousand times the box; else `none`, without a point. slack: the
    distance to the nearest plane. Cells without planes keep their start, with
    no slack. Planes without a normal hold or fail everywhere; planes with a
    null are left out. A task holds one cell's planes.
    """
    low, high = box
    moved = [F.greatest(F.lit(lo + margin), F.least(F.lit(hi - margin), F.col(a).cast("double"))).alias(f"s{a}") for a, lo, hi in zip(AXES, low, high, strict=True)]
    middle = [(lo + hi) / 2 for lo, hi in zip(low, high, strict=True)]
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    whole = planes.select(*cell, *[F.col(c).cast("double").alias(c) for c in (*NORMAL, "rhs")]).na.drop(subset=[*NORMAL, "rhs"])
    scaled = whole.withColumn("size", F.when(size <= FLAT, 1.0).otherwise(size)).select(*cell, *[(F.col(c) / F.col("size")).alias(c) for c in (*NORMAL, "rhs")])
    placed = starts.select(*cell, *moved)
    gap = lambda p: F.col("nx") * p[0] + F.col("ny") * p[1] + F.col("nz") * p[2] - F.col("rhs")
    tested = placed.join(scaled, cell, "left").groupBy(*cell, *[f"s{a}" for a in AXES]).agg(
        F.max(gap([F.col(f"s{a}") for a in AXES])).alias("at_start"), F.max(gap([F.lit(m) for m in middle])).alias("at_middle")
    )
    how = F.when(F.coalesce("at_start", F.lit(0.0)) <= TOL, "start").when(F.col("at_middle") <= TOL, "middle")
    told = tested.withColumn("how", how)
    at = [F.when(F.col("how") == "start", F.col(f"s{a}")).otherwise(F.lit(m)).alias(a) for a, m in zip(AXES, middle, strict=True)]
    simple = told.filter("how IS NOT NULL").select(*cell, "how", *at, F.when(F.col("how") == "start", -F.col("at_start")).otherwise(-F.col("at_middle")).alias("slack"))
    most = 1e3 * max(max(abs(v) for v in (*low, *high)), 1.0)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, rhs = rows[list(NORMAL)].to_numpy(float), rows["rhs"].to_numpy(float)
        found = inner_centre(n, rhs, most)
        out = rows[cell].head(1).copy()
        ok = found is not None and (n @ found[0] - rhs).max() <= TOL * max(1.0, float(np.abs(found[0]).max()))
        out["how"] = "inner" if ok else "none"
        for k, a in enumerate(AXES):
            out[a] = float(found[0][k]) if ok else None
        out["slack"] = float((rhs - n @ found[0]).min()) if ok else None
        return out

    hard = scaled.join(told.filter("how IS NULL").select(*cell), cell, "left_semi")
    kinds = ", ".join(f"`{c}` {scaled.schema[c].dataType.simpleString()}" for c in cell)
    return simple.unionByName(hard.groupBy(*cell).applyInPandas(solve, f"{kinds}, how string, x double, y double, z double, slack double"))
