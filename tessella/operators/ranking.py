"""Exact ranks and running totals within groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import draw

_BUCKETS = 4096


def ranked(df: DataFrame, by: list[str], order: list[Column | str], bucket: Column, name: str = "_rank") -> DataFrame:
    """`df` with the rank 1.. of each row of its group in an order.

    `bucket` must not decrease in that order.  Rows are counted per bucket,
    buckets get the number of rows before them from a window over counts, and
    rows are numbered within their bucket only.  Null groups are groups.
    """
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_ob"), before.alias("_before"))
    on = F.col("_bucket").eqNullSafe(F.col("_ob"))
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return cut.withColumn("_within", within).join(offsets, on).withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_within", "_before", "_bucket", "_ob", *[f"_o{i}" for i in range(len(by))])


def by_draw(df: DataFrame, by: list[str], key: str, seed: str = "42", name: str = "_rank") -> DataFrame:
    """Rank by the hash of the key: buckets are the hash's first three digits, equally full."""
    d = draw(F.col(key), seed)
    return ranked(df.withColumn("_draw", d), by, ["_draw", key], F.substring("_draw", 1, 3), name).drop("_draw")


def by_number(df: DataFrame, by: list[str], key: str, name: str = "_rank") -> DataFrame:
    """Rank by an integer key: buckets are equal ranges between its least and greatest value."""
    return ranked(df, by, [key], equal_ranges(df, key), name)


def running(df: DataFrame, by: list[str], order: list[Column | str], bucket: Column, sums: dict[str, str], name: str = "_before_") -> DataFrame:
    """`df` with, for each name of `sums`, the total of its column over the rows of the group that come before a row.

    `bucket` must not decrease in the order.  Totals per bucket carry over
    from bucket to bucket in a window over buckets; within a bucket a window
    runs over its own rows only.  Null groups are groups, null values count 0.
    """
    cut = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    offsets = totals.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_ob"), *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_c_{k}") for k in sums])
    on = F.col("_bucket").eqNullSafe(F.col("_ob"))
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    here = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({f"_w_{k}": F.coalesce(F.sum(c).over(here), F.lit(0)) for k, c in sums.items()}).join(offsets, on)
    out = out.withColumns({f"{name}{k}": F.col(f"_w_{k}") + F.col(f"_c_{k}") for k in sums})
    return out.drop("_bucket", "_ob", *[f"_o{i}" for i in range(len(by))], *[x for k in sums for x in (f"_w_{k}", f"_c_{k}")])


def score_bucket(p: str) -> Column:
    """Buckets of a score: 4,096 equal cells between 0 and 1, what lies outside in the outermost."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p))) * _BUCKETS)


def equal_ranges(df: DataFrame, key: str) -> Column:
    """Buckets of an integer key: equal ranges between its least and greatest value."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // _BUCKETS))
    return F.floor((F.col(key) - F.lit(low or 0)) / width)
