"""Running and moving figures over an ordered log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import by_number


def running_mean(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_avg", F.round(F.avg(value).over(w), 10)).withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def moving_mean(df: DataFrame, value: str, by: list[str], order: list[str], last: int = 20) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)
    return df.withColumn("moving_avg", F.round(F.avg(value).over(w), 6))


def best_so_far(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """The best value up to a row, and whether the row improved on all before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", F.greatest(F.coalesce(before, F.col(value)), F.col(value))).withColumn("improved", F.coalesce(F.col(value) > before, F.lit(True)))


def exponential_mean(df: DataFrame, value: str, by: list[str], order: list[str], keep: float = 0.95, digits: int | None = 6) -> DataFrame:
    """s <- keep s + (1 - keep) x from 0, over all rows before; a null value counts as 0.

    In closed form: rows are numbered, blocks of rows summed with their decay,
    and the state at the end of each block carried over by the same means, so
    no task holds a group.  With one integer column as order, rows are
    numbered without sorting a group in one task either.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    if len(order) == 1 and df.schema[order[0]].dataType.simpleString() in ("int", "bigint"):
        placed = by_number(df, by, order[0], "_i")
    else:
        placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    placed = placed.withColumns({"_i": F.col("_i").cast("long") - 1, "_x": F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * (1 - keep)})
    most = (placed.agg(F.max("_i")).first()[0] or 0) + 1
    return _decayed(placed, by, keep, most).withColumn("ema", F.col("_s") if digits is None else F.round("_s", digits)).drop("_i", "_x", "_s")


def _decayed(df: DataFrame, by: list[str], keep: float, most: int) -> DataFrame:
    """`df` with `_s`, the sum of keep^(i - j) x over the rows j up to a row i of its group; `_i` numbers rows from 0, `_x` is x."""
    block = int(min(256, max(2, 500 / -math.log(keep))))  # keep^-block stays a finite number
    at = F.pmod(F.col("_i"), F.lit(block))
    here = df.withColumn("_block", F.floor(F.col("_i") / block))
    up, down = F.pow(F.lit(keep), -at), F.pow(F.lit(keep), at)
    w = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    here = here.withColumn("_s", down * F.sum(F.col("_x") * up).over(w))
    if most <= block:
        return here.drop("_block")
    ends = here.groupBy(*by, "_block").agg(F.sum(F.col("_x") * F.pow(F.lit(keep), block - 1 - at)).alias("_x")).withColumnRenamed("_block", "_i")
    before = _decayed(ends, by, keep**block, -(-most // block)) if keep**block > 1e-300 else ends.withColumn("_s", F.col("_x"))
    before = before.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], (F.col("_i") + 1).alias("_after"), F.col("_s").alias("_carry"))
    on = F.col("_block") == F.col("_after")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = here.join(before, on, "left").withColumn("_s", F.col("_s") + F.coalesce(F.pow(F.lit(keep), at + 1) * F.col("_carry"), F.lit(0.0)))
    return j.drop("_block", "_after", "_carry", *[f"_g{i}" for i in range(len(by))])


def loss_figures(df: DataFrame, loss: str, epoch: str, *by: str) -> DataFrame:
    """Mean, population deviation, least, greatest, the epoch of the least, and the linear trend."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.round(F.avg(loss), 6).alias("mean"), F.round(F.stddev_pop(loss), 6).alias("std"), F.min(loss).alias("least"), F.max(loss).alias("greatest"),
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.round(F.regr_slope(F.col(loss), F.col(epoch)), 6).alias("slope"), F.round(F.regr_intercept(F.col(loss), F.col(epoch)), 6).alias("intercept"),
    )


def global_step(epoch: Column, step: Column, steps: Column | int) -> Column:
    """The number of a step over all epochs."""
    return epoch * steps + step


def remaining(df: DataFrame, seconds: str, order: str, epochs: int) -> DataFrame:
    """Of each epoch of a run (as few rows as epochs) the mean duration so far and the seconds that the epochs left will take."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.row_number().over(Window.orderBy(order))
    return df.withColumns({"mean_seconds": F.round(F.avg(seconds).over(w), 6), "eta_seconds": F.round(F.avg(seconds).over(w) * F.greatest(F.lit(0), F.lit(epochs) - done), 4)})
