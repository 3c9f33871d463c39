"""Label and language columns: binarising, bit patterns, ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS, LANG_IDS, LANG_NAMES, is_pos, lookup


def binarised(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Fractions of votes to 0 or 1: rounded up, kept within 0 and 1; null stays null."""
    up = lambda x: F.greatest(F.lit(0), F.least(F.lit(1), F.ceil(F.col(x)))).cast("int")
    return df.withColumns({x: F.when(F.col(x).isNotNull(), up(x)) for x in labels})


def bit_pattern(labels: list[str] = LABELS) -> Column:
    """'1' for each positive label, '0' for the others, in label order."""
    return F.concat(*[F.when(is_pos(x), "1").otherwise("0") for x in labels])


def lang_id(lang: str | Column) -> Column:
    """Number of a language code, 0 for unknown ones and null."""
    return lookup(LANG_IDS, F.lower(F.col(lang) if isinstance(lang, str) else lang), 0)


def lang_id_of_name(name: str | Column) -> Column:
    """Number of a language given as code or English name, in any case; 0 for unknown ones."""
    return lookup(LANG_IDS | LANG_NAMES, F.lower(F.trim(F.col(name) if isinstance(name, str) else name)), 0)


def clamped_lang_ids(df: DataFrame, col: str = "lang_id", most_invalid: float = 0.1) -> DataFrame:
    """Ids outside 0..6 moved to the nearest; all 0 if more than `most_invalid` of the rows are outside."""
    bad = F.coalesce(~F.col(col).between(0, 6), F.lit(True))
    if (df.agg(F.avg(bad.cast("double"))).first()[0] or 0) > most_invalid:
        return df.withColumn(col, F.lit(0))
    return df.withColumn(col, F.coalesce(F.greatest(F.lit(0), F.least(F.lit(6), F.col(col))), F.lit(0)))


def positives(labels: list[str] = LABELS) -> Column:
    """Number of positive labels of a row."""
    return sum((is_pos(x).cast("int") for x in labels[1:]), is_pos(labels[0]).cast("int"))


def any_positive(labels: list[str] = LABELS) -> Column:
    return positives(labels) > 0


def title(c: str | Column) -> Column:
    """A label name for display: spaces for underscores, words capitalised."""
    return F.initcap(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("_"), F.lit(" ")))


def one_hot(label: Column, labels: list[str] = LABELS) -> list[Column]:
    return [(label == F.lit(x)).cast("int").alias(x) for x in labels]


def as_percent(p: str | Column) -> Column:
    """To one place, halves up."""
    return F.floor((F.col(p) if isinstance(p, str) else p) * 1000 + 0.5) / 10


def violations(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """`label`, `value`, `n` of values that are neither 0, 1 nor null (not a number counts as null)."""
    long = df.select(*[F.col(x).cast("double").alias(x) for x in labels]).unpivot([], labels, "label", "value")
    return long.where(~F.isnan("value") & ~F.col("value").isin(0.0, 1.0)).groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))


def checked(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """`df` itself; an error names labels that hold other values than 0, 1 and null."""
    bad = violations(df, labels).select("label").distinct().limit(len(labels)).collect()
    if bad:
        raise ValueError("values other than 0, 1 and null in " + ", ".join(sorted(r[0] for r in bad)))
    return df


def uniform(seed: str, *key: str) -> Column:
    """A number in (0, 1) fixed by a seed and columns."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def noisy(c: str, *key: str, deviation: float = 0.1, seed: str = "42") -> Column:
    """The value with normal noise, fixed by the columns `key`, kept within 0 and 1; null stays null."""
    u, v = uniform(f"{seed}{c}u", *key), uniform(f"{seed}{c}v", *key)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + deviation * z)))


def thousands(n: str | Column) -> Column:
    """A count with commas."""
    return F.format_number(F.col(n) if isinstance(n, str) else n, 0)


def percent_text(share: str | Column) -> Column:
    """A share as text with two places, halves up, and a percent sign."""
    return F.format_string("%.2f%%", F.floor((F.col(share) if isinstance(share, str) else share) * 10_000 + 0.5) / 100)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def long_labels(df: DataFrame, *keep: str, labels: list[str] = LABELS) -> DataFrame:
    """One row per row and label: the kept columns, `label`, `v` (double, null kept)."""
    wide = df.select(*keep, *[F.col(x).cast("double").alias(x) for x in labels])
    return wide.unpivot(list(keep), labels, "label", "v")
