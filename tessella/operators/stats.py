"""Distribution statistics over label columns and languages."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import long_labels, positives
from ..schema import LABELS, is_pos

Z95 = 1.959963984540054


def null_counts(df: DataFrame) -> DataFrame:
    """One row a column: type and number of nulls; one pass."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return counts.unpivot([], df.columns, "column_name", "nulls").select("column_name", types[F.col("column_name")].alias("kind"), F.coalesce("nulls", F.lit(0)).alias("nulls"))


def rates(df: DataFrame, *by: str, labels: list[str] = LABELS) -> DataFrame:
    """Per group and label: rows with a value, positives, negatives, rate."""
    long = long_labels(df, *by, labels=labels).where("v is not null")
    return long.groupBy(*by, "label").agg(F.count("v").alias("n"), F.sum((F.col("v") > 0).cast("long")).alias("pos")).select(*by, "label", "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.round(F.try_divide("pos", "n"), 6).alias("rate"))


def rates_grouping_sets(df: DataFrame, by: str = "lang") -> DataFrame:
    """Rates per (group, label) and per label in one pass; `total` marks the latter."""
    long = long_labels(df, by).where("v is not null")
    g = long.groupingSets([[F.col(by), F.col("label")], [F.col("label")]], F.col(by), F.col("label")).agg(F.grouping(by).cast("int").alias("total"), F.count("v").alias("n"), F.sum((F.col("v") > 0).cast("long")).alias("pos"))
    return g.select(by, "label", "total", "n", "pos", F.round(F.try_divide("pos", "n"), 6).alias("rate"))


def wald(df: DataFrame, z: float = Z95) -> DataFrame:
    """Rates with their normal confidence interval: columns `low`, `high`."""
    p, n = F.col("pos") / F.col("n"), F.col("n")
    half = z * F.sqrt(p * (1 - p) / n)
    return df.withColumn("low", F.round(p - half, 6)).withColumn("high", F.round(p + half, 6))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Count and share of each value."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over groups, not rows


def label_histogram(df: DataFrame) -> DataFrame:
    return long_labels(df).groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """For each pair of labels the rows positive in both, and their share; one pass."""
    pairs = list(combinations(labels, 2))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum((is_pos(a) & is_pos(b)).cast("long")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot(["n"], [f"{a}|{b}" for a, b in pairs], "pair", "both")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("label_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("label_b"), F.coalesce("both", F.lit(0)).alias("both"), F.round(F.try_divide(F.coalesce("both", F.lit(0)), F.col("n")), 6).alias("share"))


def cardinality(df: DataFrame, *by: str) -> DataFrame:
    """Rows by the number of positive labels."""
    return df.groupBy(*by, positives().alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def toxic_or_clean(df: DataFrame, *by: str) -> DataFrame:
    any_ = (positives() > 0).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(any_).alias("any_positive"), F.sum(1 - any_).alias("clean"), F.round(F.avg(any_) * 100, 4).alias("pct"))


def label_correlation(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Pearson correlation of every pair of labels, and the mean of each label's row by which a heat map is ordered; rows with a null label are left out."""
    full = df.select(*[F.col(x).cast("double").alias(x) for x in labels]).dropna()
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i:]]
    # sums and sums of products: a third of the work of one correlation a pair
    sums = full.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(x) for x in labels], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])

    def r(a: str, b: str) -> Column:
        ab = F.col(f"{a}|{b}") if (a, b) in pairs else F.col(f"{b}|{a}")
        n, c = F.col("_n").cast("double"), lambda x: F.col("_n") * F.col(f"{x}|{x}") - F.col(x) * F.col(x)
        return F.try_divide(n * ab - F.col(a) * F.col(b), F.sqrt(c(a)) * F.sqrt(c(b)))

    cells = F.array(*[F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), r(a, b).alias("r")) for a in labels for b in labels])
    long = sums.select(F.explode(cells).alias("x")).select("x.*")
    return long.withColumn("mean_r", F.round(F.avg("r").over(Window.partitionBy("label_a")), 6)).withColumn("r", F.round("r", 6))


def crosstab(df: DataFrame, row: str, col: Column, values: list) -> DataFrame:
    """Counts of `row` by the values of `col`, missing cells 0."""
    return df.withColumn("_c", col).groupBy(row).pivot("_c", values).count().na.fill(0)


def chi_square(counts: DataFrame, row: str, col: str, n: str, *by: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of a table of counts, over the full grid; groups `by` are tables of their own.

    Cells without a row add their expectation; as expectations add up to the
    total, they need not be listed.  Windows run over counts, not rows.
    """
    total = lambda *keys: F.sum(n).over(Window.partitionBy(*by, *keys))
    cells = counts.withColumns({"_r": total(row), "_k": total(col), "_n": total()})
    e = F.col("_r") * F.col("_k") / F.col("_n")
    cells = cells.withColumn("_e", e)
    stat = F.sum(F.try_divide(F.pow(F.col(n) - F.col("_e"), 2), F.col("_e"))) + F.max("_n") - F.sum("_e")
    return cells.groupBy(*by).agg(F.round(stat, 4).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)).alias("dof"))


def p_value(chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution, by the incomplete gamma function."""
    import math

    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def with_p_value(tests: DataFrame) -> DataFrame:
    """`chi2` and `dof` with the probability `p` of a statistic as large by chance."""

    @F.pandas_udf("double")
    def upper(chi2: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([p_value(x, int(k)) if k > 0 else 1.0 for x, k in zip(chi2, dof)], dtype="float64")

    return tests.withColumn("p", upper("chi2", F.col("dof").cast("double")))


def success(df: DataFrame, ok: Column, *by: str) -> DataFrame:
    """Attempts, valid ones and the percentage of those."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("valid"))
    return n.withColumn("success_pct", F.round(F.col("valid") * 100.0 / F.col("attempts"), 4))


def norms(df: DataFrame, step: str, name: str, norm: str) -> DataFrame:
    """Of each step the largest, least and mean norm and the name that holds the largest (the first by name where several do)."""
    return df.groupBy(step).agg(F.max(norm).alias("largest"), F.min(norm).alias("least"), F.round(F.avg(norm), 6).alias("mean"), F.min(F.struct((-F.col(norm)).alias("a"), F.col(name).alias("b"))).alias("_m")).select(step, "largest", "least", "mean", F.col("_m.b").alias("largest_name"))


def stacked_shares(df: DataFrame, by: str, labels: list[str]) -> DataFrame:
    """Per group the percentage of rows without a positive label, and of each label."""
    pos = {x: F.coalesce((F.col(x) > 0).cast("int"), F.lit(0)) for x in labels}
    none = sum(pos.values(), F.lit(0)) == 0
    pct = lambda c: F.round(F.sum(c) * 100.0 / F.count(F.lit(1)), 4)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), pct(none.cast("int")).alias("non_toxic"), *[pct(c).alias(x) for x, c in pos.items()])


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least and greatest of each column, nulls left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "v").where("v is not null")
    return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def variation(df: DataFrame, by: str, most: float = 0.15) -> DataFrame:
    """Coefficient of variation of the groups' sizes, and whether it is above `most`."""
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.try_divide(F.stddev_samp("n"), F.avg("n")), 6).alias("cv")).withColumn("imbalanced", F.col("cv") > most)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins of the non-zero values; the last holds its upper edge too."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins))).cast("int")
    return df.where(F.col(value).between(low, high) & (F.col(value) != 0)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
