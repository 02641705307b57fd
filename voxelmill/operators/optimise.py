"""Design updates by the method of moving asymptotes, for one constraint.

The convex subproblem is separable: for a given multiplier each variable has a
closed form, so a design table of any length is updated by projections, and the
multiplier is found by sums over the table at many trial values at once.
(Svanberg, The method of moving asymptotes, 1987, and its 2007 notes.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Settings:
    xmin: float = 0.001
    xmax: float = 1.0
    start: float = 0.5
    grow: float = 1.2
    shrink: float = 0.7
    inner: float = 0.1
    move: float = 0.5
    raa0: float = 1e-5
    c: float = 1000.0
    d: float = 1.0


def asymptotes(design: DataFrame, iteration: int, s: Settings = Settings()) -> DataFrame:
    """design (id, x, xold1, xold2, low, upp) with low and upp moved."""
    span, x = s.xmax - s.xmin, F.col("x")
    if iteration <= 2:
        return design.withColumns({"low": x - s.start * span, "upp": x + s.start * span})
    turn = (x - F.col("xold1")) * (F.col("xold1") - F.col("xold2"))
    factor = F.when(turn > 0, s.grow).when(turn < 0, s.shrink).otherwise(1.0)
    low = x - factor * (F.col("xold1") - F.col("low"))
    upp = x + factor * (F.col("upp") - F.col("xold1"))
    near, far = 0.01 * span, 10.0 * span
    return design.withColumns({"low": F.least(F.greatest(low, x - far), x - near), "upp": F.greatest(F.least(upp, x + far), x + near)})


def _primal(lam: Column, a: Column, b: Column) -> Column:
    p, q = F.sqrt(F.col("p0") + lam * F.col("p1")), F.sqrt(F.col("q0") + lam * F.col("q1"))
    return F.greatest(F.least((p * F.col("low") + q * F.col("upp")) / (p + q), b), a)


def step(design: DataFrame, constraint: float, iteration: int, s: Settings = Settings(), tries: int = 32, rounds: int = 9) -> DataFrame:
    """The design after one update: id, x, xold1, xold2, low, upp, and moved (the
    absolute change). design also has df and dg, the slopes of the goal and of
    the constraint, whose value is `constraint` (at most 0 where fulfilled)."""
    t = asymptotes(design, iteration, s)
    x, low, upp, span = F.col("x"), F.col("low"), F.col("upp"), s.xmax - s.xmin
    alpha = F.greatest(low + s.inner * (x - low), x - s.move * span, F.lit(s.xmin))
    beta = F.least(upp - s.inner * (upp - x), x + s.move * span, F.lit(s.xmax))

    def parts(g: str) -> tuple[Column, Column]:
        up, down = F.greatest(F.col(g), F.lit(0.0)), F.greatest(-F.col(g), F.lit(0.0))
        small = 0.001 * (up + down) + s.raa0 / span
        return (up + small) * (upp - x) ** 2, (down + small) * (x - low) ** 2

    (p0, q0), (p1, q1) = parts("df"), parts("dg")
    t = t.withColumns({"alpha": alpha, "beta": beta, "p0": p0, "q0": q0, "p1": p1, "q1": q1})
    t = cut(t)
    b = (t.agg(F.sum(F.col("p1") / (upp - x) + F.col("q1") / (x - low))).first()[0] or 0.0) - constraint

    def slack(values: list[float]) -> list[float]:
        sums = []
        for v in values:
            at = _primal(F.lit(v), F.col("alpha"), F.col("beta"))
            sums.append(F.sum(F.col("p1") / (upp - at) + F.col("q1") / (at - low)))
        got = t.agg(*sums).first()
        return [g - b - max(0.0, (v - s.c) / s.d) for g, v in zip(got, values, strict=True)]

    lo, hi = 0.0, 1e-6
    if slack([0.0])[0] > 0:
        grow = [10.0**k for k in range(-6, 13)]
        over = slack(grow)
        place = next((k for k, v in enumerate(over) if v <= 0), len(grow) - 1)
        lo, hi = (grow[place - 1] if place else 0.0), grow[place]
        for _ in range(rounds):
            trial = [lo + (hi - lo) * (k + 1) / (tries + 1) for k in range(tries)]
            over = slack(trial)
            place = next((k for k, v in enumerate(over) if v <= 0), tries)
            lo, hi = (trial[place - 1] if place else lo), (trial[place] if place < tries else hi)
            if hi - lo <= 1e-15 * max(1.0, hi):
                break
        lam = (lo + hi) / 2
    else:
        lam = 0.0
    new = _primal(F.lit(lam), F.col("alpha"), F.col("beta"))
    return t.select(*[c for c in design.columns if c not in ("x", "xold1", "xold2", "low", "upp")], new.alias("x"), x.alias("xold1"), F.col("xold1").alias("xold2"), "low", "upp", F.abs(new - x).alias("moved"))
