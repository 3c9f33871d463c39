"""Files: CSV with embedded line breaks, encodings, profiles, JSON trees, latest files."""

from __future__ import annotations

import glob
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8", "latin1", "iso-8859-1", "cp1252")
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "utf-8") -> DataFrame:
    return spark.read.schema(schema).options(**_CSV, encoding=encoding).csv(path)


def write_csv(df: DataFrame, path: str, rows_a_file: int = 0, mode: str = "errorifexists") -> None:
    """Header, quoted, UTF-8; files of at most `rows_a_file` rows, written in parallel."""
    df.write.mode(mode).options(**_CSV, quoteAll="true", maxRecordsPerFile=str(rows_a_file)).csv(path)


def encoding_of(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that decodes every file of a path; checked on the executors."""
    def fits(encoding: str):
        @F.pandas_udf(T.BooleanType())
        def f(s: pd.Series) -> pd.Series:
            def ok(b: bytes) -> bool:
                try:
                    b.decode(encoding)
                    return True
                except UnicodeDecodeError:
                    return False

            return s.map(ok)

        return f

    files = spark.read.format("binaryFile").load(path).select("content")
    for e in encodings:
        if files.where(~fits(e)(F.col("content"))).isEmpty():
            return e
    raise ValueError(f"none of {encodings} decodes {path}")


def text_column(df: DataFrame) -> str:
    """The first column whose name holds 'text' or 'comment'."""
    for c in df.columns:
        if "text" in c.lower() or "comment" in c.lower():
            return c
    raise ValueError("no text column among " + ", ".join(df.columns))


def latest(pattern: str, spark: SparkSession | None = None) -> str:
    """The last file of a pattern in order of name; with a session, on whatever file system the path names."""
    if spark is None:
        found = sorted(glob.glob(pattern))
    else:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        found = sorted(x.getPath().toString() for x in statuses or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found[-1]


def retained(names: DataFrame, name: str = "name", keep: int = 3) -> DataFrame:
    """The last `keep` names in order."""
    return names.orderBy(F.desc(name)).limit(keep)


def derived_path(path: str, suffix: str, extension: str | None = None) -> str:
    """`a/b.csv` with `_cleaned` gives `a/b_cleaned.csv`."""
    root, ext = os.path.splitext(path)
    return f"{root}_{suffix}{extension or ext}"


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path: name, megabytes to two places, time of change."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.round(F.col("length") / 1048576, 2).alias("mb"), "modificationTime")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines."""
    df.write.mode("append").json(path)


def threshold_tree(thresholds: DataFrame) -> DataFrame:
    """Thresholds as one nested JSON text: language id, label, value; rows without a language or label are left out.  As small as languages times labels."""
    per = thresholds.where("lang_id is not null and label is not null").groupBy("lang_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "threshold")))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("lang_id").cast("string"), "m")))).alias("json"))


def thresholds_of_tree(trees: DataFrame, json: str = "json") -> DataFrame:
    """The rows of a nested JSON text of thresholds."""
    m = F.from_json(F.col(json), T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    return trees.select(F.explode(m).alias("lang_id", "m")).select(F.col("lang_id").cast("int").alias("lang_id"), F.explode("m").alias("label", "threshold"))


def weights_tree(weights: DataFrame) -> DataFrame:
    """Class weights as one nested JSON text: language, label, figures; rows without a language or label are left out.  As small as languages times labels."""
    figures = [c for c in weights.columns if c not in ("lang", "label")]
    per = weights.where("lang is not null and label is not null").groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.struct(*figures).alias("figures"))))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "m")))).alias("json"))


def weights_of_tree(trees: DataFrame, figures: str = "weight_0 double, weight_1 double, support_0 bigint, support_1 bigint, raw_weight_1 double", json: str = "json") -> DataFrame:
    """The rows of a nested JSON text of class weights."""
    kind = "map<string,map<string,struct<" + ", ".join(f"{n}:{t}" for n, t in (x.strip().split(" ") for x in figures.split(","))) + ">>>"
    return trees.select(F.explode(F.from_json(json, kind)).alias("lang", "m")).select("lang", F.explode("m").alias("label", "f")).select("lang", "label", "f.*")


def evaluation_tree(figures: DataFrame) -> DataFrame:
    """An evaluation in long form (`threshold_set`, `scope`, `lang_id`, `label`, `metric`, `value`) as one nested JSON text: set, scope, key, metric."""
    key = F.coalesce(F.col("label"), F.col("lang_id").cast("string"), F.lit("all"))
    per = figures.groupBy("threshold_set", "scope", key.alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    per = per.groupBy("threshold_set", "scope").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.to_json("m").alias("m"))))).alias("m"))
    per = per.groupBy("threshold_set").agg(F.map_from_entries(F.collect_list(F.struct("scope", "m"))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("threshold_set", "m")))).alias("json"))


def evaluation_of_tree(trees: DataFrame, json: str = "json") -> DataFrame:
    """The long form of a nested JSON text of an evaluation."""
    m = trees.select(F.explode(F.from_json(json, "map<string,map<string,map<string,string>>>")).alias("threshold_set", "m"))
    m = m.select("threshold_set", F.explode("m").alias("scope", "m")).select("threshold_set", "scope", F.explode("m").alias("key", "m"))
    m = m.select("threshold_set", "scope", "key", F.explode(F.from_json("m", "map<string,double>")).alias("metric", "value"))
    lang = F.when(F.col("scope") == "per_language", F.col("key").cast("int"))
    return m.select("threshold_set", "scope", lang.alias("lang_id"), F.when(F.col("scope") == "per_class", F.col("key")).alias("label"), "metric", "value")


def prediction_matrix(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """One row a record: `row_id`, `lang_id`, and arrays `y` and `p` in label order; the form predictions are kept in."""
    of = lambda c: F.array(*[F.max(F.when(F.col("label") == x, F.col(c))) for x in labels])
    return predictions.groupBy("row_id", "lang_id").agg(of("y").alias("y"), of("p").alias("p"))


def predictions_of_matrix(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """The long form of a prediction matrix, missing cells left out."""
    each = matrix.select("row_id", "lang_id", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), "y", "p")).alias("c"))
    return each.select("row_id", "lang_id", "c.label", "c.y", "c.p").where("y is not null and p is not null")


def cards(df: DataFrame, *, group: Column | None = None, lang: str = "lang", labels: list[str] | None = None) -> DataFrame:
    """A card of each file (or of each `group`) in long form: `file`, `section`, `name`, `value`.

    Sections: `rows`, `nulls` of each column, `languages` and `labels` (rows
    of a language, positives of a label).  Types are those of `df.dtypes`.
    """
    file = (F.col("_metadata.file_path") if group is None else group).alias("file")
    labels = [x for x in (labels or []) if x in df.columns]
    rows = df.select(file, *[F.col(c).isNull().cast("long").alias(f"n_{k}") for k, c in enumerate(df.columns)], *([F.col(lang).alias("_lang")] if lang in df.columns else []), *[(F.col(x) > 0).cast("long").alias(f"p_{x}") for x in labels])
    one = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(len(df.columns))], *[F.coalesce(F.sum(f"p_{x}"), F.lit(0)).alias(f"p_{x}") for x in labels])
    entries = [("rows", "rows", "rows"), *[("nulls", c, f"n_{k}") for k, c in enumerate(df.columns)], *[("labels", x, f"p_{x}") for x in labels]]
    out = one.select("file", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for s, n, c in entries])).alias("e")).select("file", "e.*")
    if lang in df.columns:
        per = rows.where("_lang is not null").groupBy("file", F.col("_lang").alias("name")).agg(F.count(F.lit(1)).alias("value"))
        out = out.unionByName(per.select("file", F.lit("languages").alias("section"), "name", "value"))
    return out


def latest_run(names: DataFrame, name: str = "name", prefix: str = "eval_") -> DataFrame:
    """The last of the names that begin with `prefix`, in order of name: the latest evaluation."""
    return names.where(F.startswith(F.col(name), F.lit(prefix))).agg(F.max(name).alias("latest"))


def resolved_checkpoint(names: DataFrame, name: str = "name", base: str = "base") -> DataFrame:
    """The name `latest` if it is there, else the `checkpoint_epoch` of the greatest number, else `base`."""
    number = F.regexp_extract(name, r"^checkpoint_epoch_?(\d+)$", 1)
    best = F.max_by(F.col(name), number.try_cast("long")) if hasattr(number, "try_cast") else F.max_by(F.col(name), F.nullif(number, F.lit("")).cast("long"))
    found = names.agg(F.max(F.col(name) == "latest").alias("l"), best.alias("c"))
    return found.select(F.when(F.coalesce("l", F.lit(False)), "latest").otherwise(F.coalesce("c", F.lit(base))).alias("checkpoint"))


def logged(df: DataFrame, path: str, rows_a_file: int = 100) -> None:
    """Rows appended to a folder of JSON lines in buffers of `rows_a_file`; the last buffer is what is left."""
    df.write.mode("append").option("maxRecordsPerFile", rows_a_file).json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
