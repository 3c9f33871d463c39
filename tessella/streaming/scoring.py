"""Scoring a stream of comments as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.inference import lexicon_scorer, results, scored
from ..schema import LABELS, SERVING_THRESHOLDS
from .events import run_to_table


def stream_scores(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of every comment of a file, produced by the same transform as in batch."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out = results(scored(stream, lexicon_scorer), SERVING_THRESHOLDS)
    return run_to_table(out.select("row_id", *LABELS, "toxic_categories", "is_toxic"))
