"""Ordinal levels of a label score: fitted edges and their application."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep
from .ranking import running

LEVELS = ["none", "low", "medium", "high", "severe"]


def fit_edges(df: DataFrame, col: str, levels: int = 4, points: int = 100) -> list[float]:
    """Edges over the non-zero values: the values themselves if at most four differ; else the minima of a Gaussian density on a grid between 0 and 1; else quantiles.

    Distinct values are counted once; the density at every grid point is one
    sum over them, and quantiles come from their running counts.
    """
    v = df.where(F.col(col).isNotNull() & (F.col(col) != 0)).select(F.col(col).cast("double").alias("v"))
    counts = keep(v.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    few = sorted(r.v for r in counts.limit(5).collect())
    if len(few) <= 4:
        return few
    x, n = F.col("v"), F.col("n")
    total, mean, low, high = counts.agg(F.sum("n"), F.sum(x * n) / F.sum("n"), F.min("v"), F.max("v")).first()
    std = math.sqrt(counts.agg(F.sum(n * F.pow(x - mean, 2))).first()[0] / max(1, total - 1))
    if std > 0:
        width = std * total ** (-1 / 5)
        at = [i / (points - 1) for i in range(points)]
        density = counts.agg(F.array(*[F.sum(n * F.exp(-0.5 * F.pow((F.lit(a) - x) / width, 2))) for a in at])).first()[0]
        minima = [at[i] for i in range(1, points - 1) if density[i] < density[i - 1] and density[i] < density[i + 1]]
        if len(minima) >= levels - 1:
            return [0.0, *minima[: levels - 1], 1.0]
    span = (high - low) or 1.0
    ahead = running(counts, [], ["v"], F.floor((x - low) / span * 4095), {"n": "n"}).withColumn("upto", F.col("_before_n") + n)
    inner = ahead.agg(*[F.min(F.when(F.col("upto") >= q / levels * total, x)).alias(str(q)) for q in range(1, levels)]).first()
    return sorted({low, *inner, high})


def level(c: Column, edges: list[float]) -> Column:
    """0 for 0; else the interval (edge, edge] a value lies in, from 1, the lowest edge included; values outside go to the nearest."""
    if not edges:
        return F.when(c.isNotNull(), 0)
    out = F.lit(max(1, len(edges) - 1))
    for k in range(len(edges) - 2, 0, -1):
        out = F.when(c <= edges[k], k).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).when(c == 0, 0).otherwise(out).cast("int")


def distribution(df: DataFrame, col: str, edges: list[float], names: list[str] = LEVELS) -> DataFrame:
    """Rows and percentage of each level by name."""
    lv = level(F.col(col), edges)
    n = df.where(F.col(col).isNotNull()).groupBy(lv.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("_t", F.sum("n").over(Window.partitionBy()))  # over levels, not rows
    named = F.try_element_at(F.array(*[F.lit(x) for x in names]), F.col("level") + 1)
    return n.select("level", F.coalesce(named, F.lit("other")).alias("name"), "n", F.round(F.col("n") * 100.0 / F.col("_t"), 4).alias("pct"))
