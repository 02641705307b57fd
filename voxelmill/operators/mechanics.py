"""Element-wise mechanics: remodelling rates, moduli, stresses, energies, gathers and scatters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RateLaw:
    """Fixed values of the stimulus-to-rate law."""

    reference: float = 0.000485
    half_width: float = 0.1
    saturation: float = 7e-3
    peak: float = 2.0
    full: float = 3e-2
    most: float = 0.1
    overload: float = -0.05

    @property
    def low(self) -> float:
        return self.reference * (1 - self.half_width)

    @property
    def high(self) -> float:
        return self.reference * (1 + self.half_width)

    @property
    def slopes(self) -> tuple[float, float, float]:
        hump = -4 * self.saturation * self.peak / (self.high - self.full) ** 2
        return self.saturation / self.low, hump, abs(self.overload) / (self.full - self.most) ** 2


def rate(s: Column, law: RateLaw = RateLaw()) -> Column:
    """Density rate of a stimulus: loss, dead zone, hump, overload, plateau."""
    c1, c2, c3 = law.slopes
    mid = (law.high + law.full) / 2
    return (
        F.when(s < law.low, (s - law.low) * c1)
        .when(s <= law.high, 0.0)
        .when(s <= law.full, F.power(s - mid, 2) * c2 + law.saturation * law.peak)
        .when(s <= law.most, F.power(s - law.most, 2) * c3 + law.overload)
        .otherwise(law.overload)
    )


def rate_slope(s: Column, law: RateLaw = RateLaw()) -> Column:
    c1, c2, c3 = law.slopes
    mid = (law.high + law.full) / 2
    return (
        F.when(s < law.low, c1).when(s <= law.high, 0.0).when(s <= law.full, (s - mid) * (2 * c2)).when(s <= law.most, (s - law.most) * (2 * c3)).otherwise(0.0)
    )


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def modulus(density: Column, top: float, floor: float, full_density: float = 1.0, least: float = 0.001) -> Column:
    """Cubic interpolation between floor and top, at most top."""
    return F.least(F.lit(top), F.lit(floor) + F.power(clip(density, least, full_density) / full_density, 3) * top)


def stimulus(energy: Column, modulus_: Column, density: Column) -> Column:
    return energy * modulus_ / density


def advance(density: Column, s: Column, dt: float, most: float, least: float = 0.001) -> Column:
    """The density after one step."""
    return clip(density + rate(s) * dt, least, most)


def bucket(value: Column, top: float, buckets: int) -> Column:
    """Nearest of 0..buckets to value / top, half to even, clipped."""
    return clip(F.rint(value / top * buckets), 0.0, float(buckets)).cast("int")


def von_mises(s: dict[str, Column]) -> Column:
    """From the six components xx, yy, zz, xy, yz, zx."""
    normal = F.power(s["xx"] - s["yy"], 2) + F.power(s["yy"] - s["zz"], 2) + F.power(s["zz"] - s["xx"], 2)
    shear = F.power(s["xy"], 2) + F.power(s["yz"], 2) + F.power(s["zx"], 2)
    return F.sqrt(normal * 0.5 + shear * 3.0)


def rigid_move(p: dict[str, Column], ref: tuple[float, float, float], u: tuple[float, float, float], turn: tuple[float, float, float]) -> dict[str, Column]:
    """u + turn x (p - ref)."""
    d = {a: p[a] - r for a, r in zip("xyz", ref, strict=True)}
    return {
        "x": turn[1] * d["z"] - turn[2] * d["y"] + u[0],
        "y": turn[2] * d["x"] - turn[0] * d["z"] + u[1],
        "z": turn[0] * d["y"] - turn[1] * d["x"] + u[2],
    }


def segment_distance2(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Squared distance of a point to a segment; a segment of no length is its start."""
    d = [y - x for x, y in zip(a, b, strict=True)]
    w = [x - y for x, y in zip(p, a, strict=True)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    n = dot(d, d)
    t = F.when(n <= 1e-18, 0.0).otherwise(clip(dot(w, d) / n, 0.0, 1.0))
    off = [x - t * y for x, y in zip(w, d, strict=True)]
    return dot(off, off)


def quadratic_form(u: Column, kernel: np.ndarray) -> Column:
    """Half of u.K.u for an array column; zero entries of K cost nothing."""
    terms = [float(kernel[i, j]) * u[i] * u[j] for i, j in zip(*np.nonzero(kernel), strict=True)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total * 0.5


def gather(elements: DataFrame, nodes: DataFrame, values: list[str]) -> DataFrame:
    """elements (element_id, nodes: array of node_id) to element_id, u: the nodes'
    values in order, node by node. Nodes that are missing give nulls."""
    each = elements.select("element_id", F.posexplode("nodes").alias("at", "node_id"))
    met = each.join(nodes.select("node_id", F.array(*values).alias("v")), "node_id", "left")
    width = len(values)
    # at most as many entries as an element has nodes
    row = F.array_sort(F.collect_list(F.struct("at", F.coalesce("v", F.array(*[F.lit(None)] * width)).alias("v"))))
    return met.groupBy("element_id").agg(F.flatten(F.transform(row, lambda r: r["v"])).alias("u"))


def scatter_add(elements: DataFrame, forces: list[str]) -> DataFrame:
    """elements (nodes: array of node_id, and force columns) to node_id and the
    sums of what its elements bring; nodes without force are left out."""
    each = elements.select(F.explode("nodes").alias("node_id"), *forces)
    total = each.groupBy("node_id").agg(*[F.sum(f).alias(f) for f in forces])
    any_ = F.lit(False)
    for f in forces:
        any_ = any_ | (F.col(f) != 0)
    return total.filter(any_)


def adjoint_step(next_: Column, slope: Column, s: Column, density: Column, volume: float, lku: Column, top: float, full: float) -> Column:
    """The costate of a step from that of the next, an array column."""
    growth = slope * 2.0 * (s * density) / (F.power(density, 2) * volume) + 1.0
    drop = lku * 3.0 * F.power(density, 2) * top / full**3
    return F.transform(next_, lambda v: v * growth - drop)
