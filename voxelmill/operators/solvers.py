"""Iterative solvers on tables: conjugate gradients and a separable convex update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def multiply(matrix: DataFrame, x: DataFrame, value: str) -> DataFrame:
    """matrix (i, j, v) times x (i, value): i, y."""
    gathered = matrix.join(x.select(F.col("i").alias("j"), F.col(value).alias("__x")), "j")
    return gathered.groupBy("i").agg(F.sum(F.col("v") * F.col("__x")).alias("y"))


def conjugate_gradients(matrix: DataFrame, load: DataFrame, tol: float = 1e-8, most: int = 200, cut_every: int = 5) -> DataFrame:
    """(i, u) with matrix u = load, for a symmetric positive matrix (i, j, v) and
    load (i, f); rows without a load have 0. Scalars of each step reach the
    driver, vectors stay tables. Raises if it hasn't settled after `most` steps."""
    rows = matrix.select("i").distinct()
    state = rows.join(load, "i", "left").select("i", F.lit(0.0).alias("u"), F.coalesce("f", F.lit(0.0)).alias("r"))
    state = cut(state.withColumn("p", F.col("r")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    goal = rr * tol * tol
    for step in range(1, most + 1):
        if rr <= goal or rr == 0.0:
            return state.select("i", "u")
        state = cut(state.join(multiply(matrix, state, "p"), "i", "left").na.fill(0.0, ["y"]))
        alpha = rr / state.agg(F.sum(F.col("p") * F.col("y"))).first()[0]
        state = state.select("i", (F.col("u") + F.col("p") * alpha).alias("u"), (F.col("r") - F.col("y") * alpha).alias("r"), "p")
        new = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = state.select("i", "u", "r", (F.col("r") + F.col("p") * (new / rr)).alias("p"))
        rr = new
    raise RuntimeError(f"conjugate gradients: residual {rr} after {most} steps")
