"""Sampling, balancing and splitting by the order of a hash: the same rows on every run and every cluster."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import noisy, uniform
from .ranking import by_draw, equal_ranges, running


def stratum_offsets(df: DataFrame, stratum: str) -> DataFrame:
    """Rows before each stratum when strata stand in order; a window over counts only."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(stratum, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def folds(df: DataFrame, stratum: str, k: int, key: str = "row_id", seed: str = "42", name: str = "fold", at: str | None = None) -> DataFrame:
    """Stratified folds 0..k-1: position in the list ordered by stratum and hash, modulo k.

    Positions are counted within each stratum and shifted by the strata before
    it, so no task sorts the whole table.  `at` names a column for the position.
    """
    placed = by_draw(df, [stratum], key, seed, "_rank").withColumn("_at", F.col("_rank") - 1).drop("_rank")
    placed = placed.join(stratum_offsets(df, stratum), stratum).withColumn("_at", F.col("_at") + F.col("_before"))
    placed = placed.withColumn(name, F.pmod("_at", F.lit(k)).cast("int")).drop("_before")
    return placed.withColumnRenamed("_at", at) if at else placed.drop("_at")


def three_way(df: DataFrame, stratum: str, key: str = "row_id", seed: str = "42") -> DataFrame:
    """80/10/10: the first of five folds is held out, and its two halves are validation and test."""
    f = folds(df, stratum, 5, key, seed, "_f")
    held = folds(f.where("_f = 0"), stratum, 2, key, seed + "b", "_g").withColumn("part", F.when(F.col("_g") == 0, "val").otherwise("test")).drop("_g")
    return f.where("_f <> 0").withColumn("part", F.lit("train")).unionByName(held).drop("_f")


def two_way(df: DataFrame, stratum: str, key: str = "row_id", seed: str = "42") -> DataFrame:
    """90/10: the first of ten folds is validation."""
    return folds(df, stratum, 10, key, seed, "_f").withColumn("part", F.when(F.col("_f") == 0, "val").otherwise("train")).drop("_f")


def take(df: DataFrame, n: Column | int, by: list[str], key: str = "row_id", seed: str = "42") -> DataFrame:
    """Up to `n` rows of each group, the first by hash."""
    return by_draw(df, by, key, seed, "_r").where(F.col("_r") <= n).drop("_r")


def capped(df: DataFrame, n: int, key: str = "row_id", seed: str = "42") -> DataFrame:
    """At most `n` rows in all, the first by hash."""
    return take(df, n, [], key, seed)


def balanced(df: DataFrame, positive: str, by: str, key: str = "row_id", seed: str = "42") -> DataFrame:
    """All positive rows of each group and as many others; where others are short, all of them, repeated in hash order.

    `copy` numbers repeated rows from 0.
    """
    counts = df.groupBy(by).agg(F.sum(F.col(positive).cast("long")).alias("_p"), F.sum((~F.col(positive)).cast("long")).alias("_q"))
    pos = df.where(F.col(positive)).withColumn("copy", F.lit(0))
    counts = counts.withColumnRenamed(by, "_by")
    rest = by_draw(df.where(~F.col(positive)), [by], key, seed, "_r").join(counts.where("_p > 0"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    times = F.floor((F.col("_p") - F.col("_r")) / F.col("_q")).cast("int")  # how often this row comes again
    rest = rest.where("_r <= _p").withColumn("copy", F.explode(F.sequence(F.lit(0), times)))
    return pos.unionByName(rest.drop("_r", "_p", "_q"))


def reduced_to_ratio(df: DataFrame, label: str, ratio: DataFrame, key: str = "row_id", seed: str = "42") -> DataFrame:
    """Positive rows removed, first by hash, until int(rows x target) are left; nothing if the share is not above the target.

    `ratio` has one row with the column `target`.
    """
    n, p = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    target = ratio.first()["target"]
    out = p - math.floor(n * target) if p / max(n, 1) > target else 0
    goes = by_draw(df.where(F.col(label)), [], key, seed, "_r").where(F.col("_r") <= out).select(key)
    return df.join(goes, key, "left_anti")


def removed(df: DataFrame, condition: Column, n: int, key: str = "row_id", seed: str = "42") -> DataFrame:
    """`df` without the first `n` rows by hash that meet a condition; all of them if there are fewer."""
    goes = take(df.where(condition), n, [], key, seed).select(key)
    return df.join(goes, key, "left_anti")


def with_replacement(df: DataFrame, need: DataFrame, by: list[str], key: str = "row_id", seed: str = "42") -> DataFrame:
    """`_need` draws with replacement from each group: draw i takes the row whose place is a hash of i.

    `need` has the group and `_need`; the result has `draw` and the row.  Draws
    and rows meet in an equi-join on group and place.
    """
    places = by_draw(df, by, key, seed, "_place")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    draws = need.join(sizes, by).where("_need > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_need").cast("int"))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "draw"), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    picks = draws.withColumn("_place", (F.pmod(h, F.col("_size")) + 1).cast("long")).select(*by, "_place", "draw")
    return picks.join(places, [*by, "_place"]).drop("_place")


def quota(df: DataFrame, reference: str, labels: list[str], lang: str = "lang") -> DataFrame:
    """Rows language `reference` lacks to the largest language, and per label the positives among them at its rate there, rounded down."""
    per = df.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce((F.col(x) > 0).cast("long"), F.lit(0))).alias(x) for x in labels])
    every = Window.partitionBy()  # over as many rows as there are languages
    per = per.withColumn("need", F.max("n").over(every) - F.coalesce(F.max(F.when(F.col(lang) == reference, F.col("n"))).over(every), F.lit(0)))
    long = per.where(F.col(lang) == reference).unpivot(["n", "need"], labels, "label", "pos")
    return long.select("label", "need", F.floor(F.try_divide("pos", "n") * F.col("need")).cast("long").alias("target"))


def trimmed_to_total(df: DataFrame, amount: str, most: int, by: list[str], order: str) -> DataFrame:
    """Rows of each group, in order of an integer key, while their running total stays within `most`."""
    out = running(df, by, [order], equal_ranges(df, order), {"amount": amount}, "_")
    return out.withColumn("running", F.col("_amount") + F.coalesce(F.col(amount), F.lit(0))).drop("_amount").where(F.col("running") <= most)


def poisson_edges() -> list[float]:
    """Edges of a uniform draw between 0, 1, 2 ... occurrences at mean 1, as far as a draw of 52 bits resolves them."""
    edges, total, term = [], 0.0, math.exp(-1)
    for k in range(19):
        total += term
        edges.append(total)
        term /= k + 1
    return edges


def bootstrap_counts(df: DataFrame, replicates: int, key: str = "row_id", seed: int = 7) -> DataFrame:
    """For each replicate how often a row is drawn: Poisson(1), the bootstrap that needs no common count; rows drawn 0 times are left out."""
    edges = poisson_edges()
    times = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        times = F.when(F.col("_u") < edges[k], k).otherwise(times)
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_u", uniform(str(seed), key, "replicate"))
    return each.withColumn("times", times.cast("int")).where("times > 0").drop("_u")


def appended_rare(df: DataFrame, rare: list[str], others: list[str], least: int, key: str = "row_id", lang: str = "lang", deviation: float = 0.1, seed: str = "42") -> DataFrame:
    """`df` and, for each language and rare label of fewer than `least` positive rows, draws of those rows up to `least`, their other labels with noise.

    The result has `key`, `lang`, all labels as numbers, and `rare` and `draw`
    (null for the rows of `df` themselves).  Rows without a language are not drawn.
    """
    labels = [*rare, *others]
    rows = df.select(key, lang, *[F.col(x).cast("double").alias(x) for x in labels])
    pos = rows.where(F.col(lang).isNotNull()).unpivot([key, lang], rare, "rare", "_v").where("_v > 0").drop("_v")
    need = pos.groupBy(lang, "rare").agg((least - F.count(F.lit(1))).alias("_need"))
    drawn = with_replacement(pos, need, [lang, "rare"], key, seed).select(key, "rare", "draw").join(rows, key)
    drawn = drawn.withColumns({x: noisy(x, key, "rare", "draw", deviation=deviation, seed=seed) for x in others})
    own = rows.withColumns({"rare": F.lit(None).cast("string"), "draw": F.lit(None).cast("int")})
    return own.unionByName(drawn.select(*own.columns))


def sample_appended(df: DataFrame, pool: DataFrame, n: int, text: str, translate: Callable[[Column], Column] = lambda c: c, key: str = "row_id", seed: str = "42") -> DataFrame:
    """`df` and `n` draws with replacement from `pool`, their texts passed through `translate` (back-translation; the text itself by default).

    `draw` numbers the draws; it is null for the rows of `df`.
    """
    need = pool.groupBy().agg(F.lit(n).alias("_need")).withColumn("_all", F.lit(1))
    picks = with_replacement(pool.withColumn("_all", F.lit(1)), need, ["_all"], key, seed).drop("_all")
    back = translate(F.col(text))
    picks = picks.withColumn(text, F.coalesce(back, F.col(text)))
    return df.withColumn("draw", F.lit(None).cast("int")).unionByName(picks.select(*df.columns, F.col("draw").cast("int").alias("draw")))


def batches(df: DataFrame, size: int, group: str, key: str = "row_id", seed: str = "42") -> DataFrame:
    """Batches of rows drawn with replacement: a group in proportion to its size, then a row of it; as many whole batches as the rows make, one at least.

    `batch` and `place` number the draws.  A draw is a place in the list of
    rows that stands group by group, so a group is met in proportion to its
    size and each of its rows alike.  Draws meet rows in an equi-join.
    """
    placed = folds(df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(""))), "_g", 1, key, seed, "_f", at="_place").drop("_f", "_g")
    total = df.count()
    many = max(1, total // size) * size if total else 0
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "batch"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(many).select(F.floor(F.col("id") / size).cast("int").alias("batch"), (F.col("id") % size).cast("int").alias("place"), F.pmod(h, F.lit(max(1, total))).alias("_place"))
    return draws.join(placed, "_place").drop("_place")


def filled(df: DataFrame, pool: DataFrame, need: int, key: str, seed: str = "42") -> DataFrame:
    """`df` and the first `need` rows of `pool` by hash: a category brought up to its quota with generated rows."""
    return df.withColumn("generated", F.lit(False)).unionByName(take(pool, need, [], key, seed).withColumn("generated", F.lit(True)))
