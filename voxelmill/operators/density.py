"""Voxel densities: quantising, intensities, masks, analytic fields, moments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSITY_COLUMNS = ("density_milli", "density", "density_field", "density_matrix")


def flat_index(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    """Place of a voxel in C order, as a long."""
    return (x.cast("long") * ny + y) * nz + z


def voxelise(points: DataFrame, x: Column, y: Column, z: Column, mass: Column, most: int = 1000) -> DataFrame:
    """Sparse voxel table (x, y, z, density_milli) of integer masses, clipped at `most`."""
    cells = points.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), mass.cast("long").alias("m"))
    return cells.groupBy("x", "y", "z").agg(F.least(F.lit(most).cast("long"), F.sum("m")).alias("density_milli"))


def density_column(df: DataFrame) -> Column:
    """The first density column that df has, in the fixed order of preference."""
    for name in DENSITY_COLUMNS:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {DENSITY_COLUMNS} is a column")


def to_milli(df: DataFrame, value: str, out: str = "density_milli") -> DataFrame:
    """Thousandths, half to even, clipped to 0..65535. Values count as fractions
    only where the largest of the table is at most 1.5."""
    top = df.agg(F.max(F.col(value).cast("double"))).first()[0]
    scale = 1000.0 if top is not None and top <= 1.5 else 1.0
    return df.withColumn(out, F.greatest(F.least(F.rint(F.col(value).cast("double") * scale), F.lit(65535.0)), F.lit(0.0)).cast("int"))


def truncated_milli(density: Column) -> Column:
    """Fractions clipped to 0..1 in thousandths, cut off, not rounded."""
    return (F.greatest(F.least(density.cast("double"), F.lit(1.0)), F.lit(0.0)) * 1000).cast("int")


def weight(density: Column, gamma: float) -> Column:
    return F.when(density > 0, F.power(density.cast("double"), F.lit(float(gamma)))).otherwise(0.0)


def intensity(df: DataFrame, gamma: float, density: str = "density_milli", out: str = "intensity") -> DataFrame:
    """Weights scaled to a maximum of 1; all zero if no density is positive."""
    top = df.agg(F.max(weight(F.col(density), gamma))).first()[0] or 0.0
    return df.withColumn(out, weight(F.col(density), gamma) / F.lit(top) if top > 0 else F.lit(0.0))


def probability(df: DataFrame, gamma: float, density: str = "density_milli", out: str = "probability") -> DataFrame:
    """Weights scaled to a sum of 1; an error if that sum is 0."""
    total = df.agg(F.sum(weight(F.col(density), gamma))).first()[0] or 0.0
    if not total > 0:
        raise ValueError("the weights sum to 0")
    return df.withColumn(out, weight(F.col(density), gamma) / F.lit(total))


def in_annulus(x: Column, y: Column, centre: float, inner: float, outer: float, tol: float = 0.0) -> Column:
    """Whether a voxel's centre is between two radii, both included."""
    r2 = F.power(x + 0.5 - centre, 2) + F.power(y + 0.5 - centre, 2)
    return (r2 >= inner * inner - tol) & (r2 <= outer * outer + tol)


def in_cylinder_domain(x: Column, y: Column, z: Column, centre: float, inner: float, outer: float, low: float, high: float, tol: float = 1e-9) -> Column:
    r2 = F.power(x - centre, 2) + F.power(y - centre, 2)
    return z.between(low - tol, high + tol) & (r2 >= inner * inner - tol) & (r2 <= outer * outer + tol)


# Fixed values of the published field: its level, and the weights of its four waves.
LEVEL, WAVES = 0.52, (0.23, 0.18, 0.11, 0.08)


def wavy_density(x: Column, y: Column, z: Column, centre: float, inner: float, outer: float, height: float) -> Column:
    """The analytic field on voxels: four waves over the angle, the share of the
    wall between the radii and the share of the height, scaled to 0.001..1, to
    three decimals; 0 for voxels outside the radii."""
    dx, dy = x + 0.5 - centre, y + 0.5 - centre
    unit = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    r = unit((F.sqrt(dx * dx + dy * dy) - inner) / max(outer - inner, 1e-6))
    h, t = unit(z / max(height - 1, 1.0)), F.atan2(dy, dx)
    a, b, c, d = WAVES
    wave = F.sin(3.0 * t + 5.5 * h) * a + F.cos(2 * math.pi * r) * b + F.sin(7.0 * r - 4.0 * h) * c + F.cos(9.0 * t * r + 2.5 * h) * d
    share = unit((wave + sum(WAVES)) / (2 * sum(WAVES)))
    return F.when(in_annulus(x, y, centre, inner, outer), F.round(share * 0.999 + 0.001, 3)).otherwise(0.0)


def moments(df: DataFrame, keep: Column) -> DataFrame:
    """One row: n, means and the six covariances (divided by n) of x, y, z."""
    axes = ("x", "y", "z")
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return df.filter(keep).agg(
        F.count("*").alias("n"),
        *[F.avg(a).alias(f"mean_{a}") for a in axes],
        *[F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs],
    )


def fit_box(df: DataFrame, keep: Column) -> dict:
    """The oriented box about the kept voxels: centre (their mean), axes (rows,
    by falling variance, right-handed) and half extents. Ten numbers reach the driver."""
    m = moments(df, keep).first()
    if not m["n"]:
        raise ValueError("no voxel is kept")
    cov = np.array([[m[f"cov_{min(a, b)}{max(a, b)}"] for b in "xyz"] for a in "xyz"])
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(values)[::-1]].T
    if np.linalg.det(axes) < 0:
        axes[2] = -axes[2]
    centre = np.array([m[f"mean_{a}"] for a in "xyz"])
    along = [sum((F.col(a) - float(c)) * float(w) for a, c, w in zip("xyz", centre, row, strict=True)) for row in axes]
    ends = df.filter(keep).agg(*[f(p) for p in along for f in (F.min, F.max)]).first()
    return {"centre": centre, "axes": axes, "half": np.array([(ends[2 * i + 1] - ends[2 * i]) / 2 for i in range(3)])}
