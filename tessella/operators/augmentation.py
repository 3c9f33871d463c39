"""The data side of augmentation: prompts, extraction and filters of generated texts, a text classifier."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

# Pieces that a generated text must not hold.
BANNED = ["generate", "requirements:", "reference", "[inst]", "example"]
ACCEPT = {"toxic": 0.3}
ACCEPT_OTHERS = 0.2


def prompt(template: str, **columns: Column) -> Column:
    """A template with {names} replaced by columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def response(c: Column, start: str = "[/INST]", end: str = "</s>") -> Column:
    """What stands after the last start mark and before the end mark, blanks and double quotes trimmed."""
    c = F.substring_index(c, start, -1)
    return F.trim(F.btrim(F.trim(F.substring_index(c, end, 1)), F.lit('"')))


def acceptable(c: Column, least: int = 3, most: int = 50, banned: list[str] = BANNED) -> Column:
    """3 to 50 words and none of the banned pieces; null is not acceptable."""
    n = F.size(tokens(c))
    clean = F.lit(True)
    for w in banned:
        clean = clean & ~F.contains(F.lower(c), F.lit(w))
    return F.coalesce((n >= least) & (n <= most) & clean, F.lit(False))


def long_enough(c: Column, least: int = 10) -> Column:
    return F.coalesce(F.length(F.trim(c)) >= least, F.lit(False))


def passes(p: Column, label: Column) -> Column:
    """Whether a classifier's probability suffices for the label asked for."""
    out = F.lit(ACCEPT_OTHERS)
    for x, t in ACCEPT.items():
        out = F.when(label == x, t).otherwise(out)
    return p >= out


def classifier(features: int = 10_000, least_documents: int = 2, iterations: int = 200, regularisation: float = 1e-4) -> Pipeline:
    """TF-IDF over words and pairs of words and a logistic regression, classes weighted by `w`."""
    cut = RegexTokenizer(inputCol="text", outputCol="one", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="one", outputCol="two")
    both = SQLTransformer(statement="SELECT *, concat(one, two) AS terms FROM __THIS__")
    count = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features, minDF=least_documents)
    return Pipeline(stages=[cut, pairs, both, count, IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="w", maxIter=iterations, regParam=regularisation)])


def fit_classifier(df: DataFrame, text: str, label: Column, **options) -> PipelineModel:
    """A classifier of a 0/1 label; null texts count as empty, rows of a null label are left out."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), label.cast("double").alias("label")).where("label is not null")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        raise ValueError("rows of both classes are needed")
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
    return classifier(**options).fit(rows.withColumn("w", weight))


def probability(model: PipelineModel, df: DataFrame, text: str, into: str = "probability_1") -> DataFrame:
    out = model.transform(df.withColumn("text", F.coalesce(F.col(text), F.lit(""))).withColumn("w", F.lit(1.0)))
    return out.withColumn(into, vector_to_array("probability")[1]).select(*df.columns, into)


def unaccented(c: Column) -> Column:
    """Lower case, compatibility forms decomposed and combining marks dropped; null counts as empty."""

    @F.arrow_udf("string")
    def strip(x: pa.Array) -> pa.Array:
        return pa.array(["".join(k for k in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(k)) for t in x.to_pylist()], pa.string())

    return strip(F.coalesce(c, F.lit("")))


def fit_classifiers(df: DataFrame, text: str, labels: list[str], **options) -> tuple[PipelineModel | None, dict[str, LogisticRegressionModel | None]]:
    """(features, a model per 0/1 label column): terms are counted once over all rows, then each label is fitted on the rows where it is not null.

    A label without rows of both classes has no model.  Where no term occurs
    in enough texts there are neither features nor models.
    """
    stages = classifier(**options).getStages()
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *labels)
    if rows.isEmpty():
        return None, dict.fromkeys(labels)
    counted = Pipeline(stages=stages[:-2]).fit(rows)
    if not counted.stages[-1].vocabulary:
        return None, dict.fromkeys(labels)
    features = PipelineModel([counted, stages[-2].fit(counted.transform(rows))])
    ready = features.transform(rows).select("features", *labels).persist()
    n = ready.agg(*[F.count_if(F.col(x) == v).alias(f"{x}_{v}") for x in labels for v in (0, 1)]).first()
    models: dict[str, LogisticRegressionModel | None] = {}
    for x in labels:
        a, b = n[f"{x}_0"], n[f"{x}_1"]
        weight = F.when(F.col(x) == 1, (a + b) / (2 * max(1, b))).otherwise((a + b) / (2 * max(1, a)))
        models[x] = stages[-1].fit(ready.where(F.col(x).isNotNull()).select("features", F.col(x).cast("double").alias("label"), weight.alias("w"))) if a and b else None
    ready.unpersist()
    return features, models


def probabilities(features: PipelineModel | None, models: dict[str, LogisticRegressionModel | None], df: DataFrame, text: str, key: str = "row_id") -> DataFrame:
    """`key` and the probability of each label; null where it has no model."""
    if features is None:
        return df.select(key, *[F.lit(None).cast("double").alias(x) for x in models])
    out = features.transform(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))).select(key, "features")
    for x, m in models.items():
        if m is None:
            out = out.withColumn(x, F.lit(None).cast("double"))
        else:
            m = m.copy().setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_h")
            out = m.transform(out).withColumn(x, vector_to_array("_p")[1]).drop("_p", "_r", "_h")
    return out.drop("features")


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted classifier kept in a folder of the shared file system; what was there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def in_language(c: Column, wanted: str, detect) -> Column:
    """Whether a text's language, by the rule `detect`, is the one wanted; null and blank texts are not valid."""
    return F.coalesce((F.length(F.trim(c)) > 0) & (detect(c) == wanted), F.lit(False))
