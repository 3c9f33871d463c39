"""Problem 4: texts that look alike but are written with different characters."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep
from .textforms import skeleton


def normalised(df: DataFrame, text: str = "comment_text", into: str = "look") -> DataFrame:
    """`df` with the look of `text` added in column `into`.

    Null stays null, the empty text stays empty.  A column called `into` is replaced; all others are kept.
    """

    @F.pandas_udf("string")
    def look(s: pd.Series) -> pd.Series:
        return s.map(skeleton, na_action="ignore")

    return df.withColumn(into, look(F.col(text)))


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text with a letter or digit: its key, the 128-bit hash of its look and the 64-bit hash of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, looks, own = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and any(map(str.isalnum, t)):
                    raw = t.encode("utf-8", "surrogatepass")
                    s = skeleton(t)
                    ids.append(i)
                    own.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    looks.append(xxhash.xxh3_128_digest(raw if s == t else s.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(own, pa.int64())], ["id", "look", "own"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, look binary, own long")


_BLOCK = 1000  # rows of a look that meet others of it in one place


def _looks(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the texts, kept, and per look its `class_id` (least key), `members` and whether it holds `several` strings."""
    keys = keep(_keys(df, key, text))
    # partial aggregation keeps hot looks small
    per = keys.groupBy("look").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), (F.min("own") != F.max("own")).alias("several"))
    return keys, per


def look_pairs(df: DataFrame, key: str = "row_id", text: str = "comment_text") -> DataFrame:
    """Pairs (`{key}_a` < `{key}_b`) of rows whose texts have the same look but are not the same string.

    Rows are grouped by the hash of the skeleton; texts are read once and 32
    bytes a row kept.  Groups of one string are dropped before the join, so
    exact copies cost nothing unless a differently written twin exists.  A
    large group is cut into blocks of about a thousand rows and pairs of blocks
    are joined, so that no task holds more.  Null texts and texts without a
    letter or digit are in no pair; repeated rows count each; an empty table
    gives no row.  `look_classes` is the same without pairs.
    """
    keys, per = _looks(df, key, text)
    mixed = per.where("several").select("look", "class_id", F.ceil(F.col("members") / _BLOCK).cast("int").alias("g"))
    rows = keys.join(mixed, "look").select("class_id", "id", "own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int").alias("s"))
    blocks = lambda g, name: F.explode(F.sequence(F.lit(0), F.col(g) - 1)).alias(name)
    met = mixed.select("class_id", "g", blocks("g", "sa")).select("class_id", "sa", blocks("g", "sb")).where("sa <= sb")
    x = rows.select("class_id", F.col("s").alias("sa"), F.col("id").alias("x"), F.col("own").alias("ox"))
    y = rows.select("class_id", F.col("s").alias("sb"), F.col("id").alias("y"), F.col("own").alias("oy"))
    pairs = met.join(x, ["class_id", "sa"]).join(y, ["class_id", "sb"]).where("ox <> oy and (sa < sb or x < y)")
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def look_classes(df: DataFrame, key: str = "row_id", text: str = "comment_text") -> DataFrame:
    """One row per row of `df`: `key`, the `class_id` of its look (its least key), the `members` of the class and how many different strings (`forms`) it holds.

    Null texts and texts without a letter or digit are classes of their own.
    """
    keys, per = _looks(df, key, text)
    forms = keys.groupBy("look", "own").agg(F.lit(1).alias("one")).groupBy("look").agg(F.count(F.lit(1)).alias("forms"))
    named = keys.join(per.join(forms, "look"), "look").select(F.col("id").alias("_id"), "class_id", "members", "forms")
    rows = df.select(key)
    own = rows[key].cast("long")
    return rows.join(named, own == named["_id"], "left").select(key, F.coalesce("class_id", own).alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("forms", F.lit(1)).alias("forms"))
