"""Exact quantiles and quantile bands without gathering a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .prefix import running_sum


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The exact quantiles of a column, with linear interpolation. Equal values
    are counted first; a running count then gives the order statistics, of which
    two for each share reach the driver. Nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    ranked = cut(running_sum(counts, [F.col("v")], F.col("k"), "upto"))
    n = ranked.agg(F.max("upto")).first()[0]
    if not n:
        return []
    places = sorted({f for s in shares for f in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    holds = [(F.col("upto") > p) & (F.col("upto") - F.col("k") <= p) for p in places]
    got = ranked.agg(*[F.min(F.when(h, F.col("v"))) for h in holds]).first()
    at = dict(zip(places, got, strict=True))
    out = []
    for s in shares:
        low = math.floor(s * (n - 1))
        out.append(at[low] + (at[math.ceil(s * (n - 1))] - at[low]) * (s * (n - 1) - low))
    return out


def band_of(value: str, edges: list[float]):
    """The band of a value: half-open, the last one closed; null outside."""
    band = None
    for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        last = n == len(edges) - 2
        hit = (F.col(value) >= low) & ((F.col(value) <= high) if last else (F.col(value) < high))
        band = F.when(hit, n) if band is None else band.when(hit, n)
    return band if band is not None else F.lit(None).cast("int")
