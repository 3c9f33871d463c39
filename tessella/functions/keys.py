"""Content-derived keys: hashes, ids, strata, and the order by hash that stands for every random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import bit_pattern
from .text import collapse_spaces


def text_hash(c: Column) -> Column:
    """SHA-256 of the text in lower case with single spaces; null counts as the empty text."""
    return F.sha2(collapse_spaces(F.lower(F.coalesce(c, F.lit("")))), 256)


def light_key(c: Column) -> Column:
    """Lower case, blanks at the ends cut: the key of the contamination check."""
    return F.trim(F.lower(F.coalesce(c, F.lit(""))))


def comment_id(lang: Column, text: Column) -> Column:
    """`{lang}_{label bits}_{six digits of the text's MD5}`; null language and text count as empty."""
    return F.concat_ws("_", F.coalesce(lang, F.lit("")), bit_pattern(), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 6))


def unique_ids(df: DataFrame, id: str, order: str) -> DataFrame:
    """If any id repeats, every id gets the number of its earlier occurrences as prefix; else none does.  `order` is an integer key."""
    if not df.agg(F.count_distinct(id) < F.count(id)).first()[0]:
        return df
    from ..operators.ranking import by_number

    return by_number(df, [id], order, "_n").withColumn("_n", F.col("_n") - 1).withColumn(id, F.concat_ws("_", F.col("_n").cast("string"), F.col(id))).drop("_n")


def stratum() -> Column:
    """`{lang}_{label bits}`."""
    return F.concat_ws("_", F.coalesce(F.col("lang"), F.lit("")), bit_pattern())


def draw(key: Column, seed: str = "42") -> Column:
    """A fixed pseudo-random key of a row: the order by it stands for a shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))
