"""Duplicates, set operations between splits, and merging of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import light_key, text_hash
from ..schema import LABELS


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; null is a key.  One aggregation finds the rows, so a key of many rows is no burden."""
    firsts = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def duplicate_groups(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of two or more rows: how many, the first and the last row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row"), F.max(order).alias("last_row")).where("n > 1")


def duplicate_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row of a repeated key with the key's first row: group membership, one row a row."""
    groups = duplicate_groups(df, key, order)
    return df.select(order, key).join(groups.select(key, "n", "first_row"), key)


def summary(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, rows removed by deduplication and their share."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("unique_rows")).select(
        "total", "unique_rows", (F.col("total") - F.col("unique_rows")).alias("removed"), F.round(F.try_divide(F.col("total") - F.col("unique_rows"), F.col("total")), 6).alias("rate")
    )


def aligned_union(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL by name; labels that a part lacks become 0, other columns null."""
    out = None
    for df in parts:
        missing = [c for c in columns if c not in df.columns]
        df = df.withColumns({c: F.lit(0) if c in LABELS else F.lit(None) for c in missing}).select(*columns)
        out = df if out is None else out.unionByName(df)
    return out


def merge_new(main: DataFrame, new: DataFrame, text: str, order: str) -> DataFrame:
    """Rows of `new` whose text neither `main` nor an earlier new row has; main's own repeats are not touched."""
    return keep_first(new, text, order).join(main.select(text).distinct(), new[text].eqNullSafe(main[text]), "left_anti")


def hashes(df: DataFrame, text: str = "comment_text", split: str = "split", key: Column | None = None) -> DataFrame:
    """Distinct (split, hash) pairs."""
    return df.select(F.col(split).alias("split"), (key if key is not None else text_hash(F.col(text))).alias("h")).distinct()


def without_leakage(df: DataFrame, text: str = "comment_text", split: str = "split") -> DataFrame:
    """Train whole; validation without texts of train; test without texts of train and of the validation split as it was."""
    keyed = df.withColumn("_h", text_hash(F.col(text)))
    seen = keyed.select(F.col(split).alias("_s"), "_h").where("_s in ('train', 'val')").groupBy("_h").agg(F.max((F.col("_s") == "train")).alias("_in_train"), F.max((F.col("_s") == "val")).alias("_in_val"))
    j = keyed.join(seen, "_h", "left")
    leak = F.when(F.col(split) == "val", F.col("_in_train")).when(F.col(split) == "test", F.col("_in_train") | F.col("_in_val")).otherwise(False)
    return j.where(~F.coalesce(leak, F.lit(False))).drop("_h", "_in_train", "_in_val")


def split_overlaps(h: DataFrame) -> DataFrame:
    """For each pair of splits, in order of name, the number of hashes both hold."""
    per = h.groupBy("h").agg(F.sort_array(F.collect_set("split")).alias("in_splits"))  # at most as many as there are splits
    i = per.where("size(in_splits) > 1").select(F.explode("in_splits").alias("split_a"), "in_splits")
    return i.select("split_a", F.explode("in_splits").alias("split_b")).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def contamination(df: DataFrame, text: str = "comment_text") -> DataFrame:
    """Keys shared by two splits over the rows of the first, for train-val, train-test and val-test."""
    key = light_key(F.col(text))
    per = df.select(key.alias("k"), "split").groupBy("k").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    rows = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    shared = per.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))])
    long = shared.unpivot([], ["train_val", "train_test", "val_test"], "pair", "shared")
    return long.join(rows, F.substring_index("pair", "_", 1) == F.col("split")).select("pair", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.round(F.try_divide(F.coalesce("shared", F.lit(0)), F.col("n")), 6).alias("ratio"))


def compare_counts(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Counts by a column in two tables, their difference and its percentage; null where the old count is 0."""
    a = old.groupBy(by).agg(F.count(F.lit(1)).alias("old_n")).where(F.col(by).isNotNull())
    b = new.groupBy(by).agg(F.count(F.lit(1)).alias("new_n")).where(F.col(by).isNotNull())
    j = a.join(b, by, "full_outer").select(by, F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))
    return j.withColumn("diff", F.col("new_n") - F.col("old_n")).withColumn("pct", F.round(F.try_divide(F.col("diff") * 100.0, F.col("old_n")), 4))
