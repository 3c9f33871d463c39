"""The corpus build as one lazy plan: raw comments and augmented ones to a deduplicated, stratified, leak-free split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import labels as L
from ..functions import text as X
from ..operators import dedup as D
from ..operators import sampling as G
from ..operators import stats as S
from ..schema import LABELS


@dataclass
class Corpus:
    """The stages of a build; nothing runs before a stage is used."""

    merged: DataFrame
    deduplicated: DataFrame
    split: DataFrame
    summary: DataFrame
    rates: DataFrame


def cleaned(raw: DataFrame, key: str = "raw_id") -> DataFrame:
    """Texts cleaned, blank ones dropped, labels binarised; rows with a null label are dropped."""
    c = raw.withColumn("comment_text", X.clean_text(F.col("comment_text"))).where("length(trim(comment_text)) > 0")
    return L.binarised(c.dropna(subset=LABELS)).withColumn("row_id", F.col(key).cast("long"))


def augmented_rows(augmented: DataFrame, offset: int) -> DataFrame:
    """Augmented texts as toxic English threats, numbered after the others."""
    a = augmented.where("length(trim(text)) > 0").select((F.col("aug_id") + offset).alias("row_id"), X.clean_text(F.col("text")).alias("comment_text"))
    return a.withColumns({x: F.lit(int(x in ("toxic", "threat"))) for x in LABELS}).withColumn("lang", F.lit("en"))


def build(raw: DataFrame, augmented: DataFrame | None = None, offset: int = 1 << 40) -> Corpus:
    """Clean, merge, give ids, deduplicate by hash keeping the first row, split 80/10/10 by language and label pattern."""
    columns = ["row_id", "comment_text", *LABELS, "lang"]
    merged = cleaned(raw).select(*columns)
    if augmented is not None:
        extra = D.merge_new(merged, augmented_rows(augmented, offset), "comment_text", "row_id")
        merged = D.aligned_union([merged, extra], columns)
    merged = merged.withColumn("id", K.comment_id(F.col("lang"), F.col("comment_text"))).withColumn("h", K.text_hash(F.col("comment_text")))
    kept = D.keep_first(merged, "h", "row_id")
    split = G.three_way(kept.withColumn("stratum", K.stratum()), "stratum").withColumnRenamed("part", "split")
    return Corpus(merged, kept, split, D.summary(merged, "h"), S.rates(split, "split", "lang"))


def write(corpus: Corpus, path: str, mode: str = "errorifexists") -> None:
    """The split, one folder a part, so that a reader of one part reads no other."""
    corpus.split.drop("h", "stratum").write.mode(mode).partitionBy("split").parquet(path)
