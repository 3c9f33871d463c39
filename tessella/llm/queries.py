"""Queries of the training-data problems and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.tables import keep, spread, table
from . import language, lookalikes, overlaps, packing, proportions, similar, tokens, truncation

_CATEGORY = ["lang", "threat", "identity_hate"]


def _split(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "split"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split").where("split = 'train'")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return language.segments(spark, split, language.fitted(language.labelled_sample(split)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_split(spark, d), _segments(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.expanded(*similar.similar(spark, _split(spark, d)))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return similar.groups(split, *similar.similar(spark, split))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_report(spark, d).where("deficit > 0").select("plan_id", *_CATEGORY)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(_train(spark, d), table(spark, d, "target_mix"), _CATEGORY)


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample(_train(spark, d), table(spark, d, "target_mix"), _CATEGORY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_pairs(_split(spark, d))


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalised(_split(spark, d).select("row_id", "comment_text")).select("row_id", "look")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(_split(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.found(spark, _split(spark, d))


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlaps(spark, _split(spark, d))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.linked(spark, _split(spark, d))[0]


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.linked(spark, _split(spark, d))[1]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return overlaps.report(split, overlaps.overlaps(spark, split))


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return overlaps.by_sources(split, *overlaps.linked(spark, split))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(spark, _documents(spark, d))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, d, "pack_spec")
    names = [r[0] for r in specs.select("tokenizer").distinct().collect() if r[0]]  # names of installed vocabularies
    sizes = keep(tokens.lengths(spark, _documents(spark, d), names))
    return sizes, specs


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(spark, *_items(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return packing.fill(packing.packed(spark, *items), packing.packed(spark, *items, shares=(1.0,)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(_documents(spark, d)).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(truncation.judged(_documents(spark, d)))


_QUERIES = [p1_found, p1_segments, p2_found, p2_groups, p3_found, p3_report, p3_sample, p4_found, p4_normalised, p4_classes, p5_found, p5_overlaps, p5_members, p5_links, p5_report, p5_sources, p6_ids, p7_packed, p7_fill, p8_found, p8_sources]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
