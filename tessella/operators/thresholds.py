"""Searching, raising and applying decision thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABELS, LOGIT_OFFSETS, SERVING_THRESHOLDS, lookup
from .ranking import by_number

LOW, HIGH, STEPS, STEPS_PER_LANGUAGE, FOLDS = 0.3, 0.7, 50, 30, 5


def contiguous_folds(df: DataFrame, by: list[str], key: str = "row_id", k: int = FOLDS) -> DataFrame:
    """`fold` of each row as unshuffled stratified folds deal them: per class, in order of the key, in blocks whose sizes follow the strided allocation of the classes in order of first appearance."""
    placed = by_number(df, [*by, "y"], key, "_r").withColumn("_r", F.col("_r") - 1)
    sizes = df.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
    other = sizes.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("y").alias("_oy"), F.col("_n").alias("_on"), F.col("_first").alias("_of"))
    on = F.col("y") != F.col("_oy")
    for i, c in enumerate(by):
        on = on & (F.col(c) == F.col(f"_b{i}"))
    sizes = sizes.join(other, on, "left")
    shift = F.when(F.col("_of") < F.col("_first"), F.pmod(F.col("_on"), F.lit(k))).otherwise(0)
    sizes = sizes.select(*by, "y", "_n", shift.alias("_shift"))
    q, m = F.floor(F.col("_n") / k), F.pmod(F.col("_n"), F.lit(k))
    edge, fold = F.lit(0), F.lit(0)
    for i in range(k - 1):
        edge = edge + q + (F.pmod(F.lit(i) - F.col("_shift"), F.lit(k)) < m).cast("long")
        fold = fold + (F.col("_r") >= edge).cast("int")
    return placed.join(sizes, [*by, "y"]).withColumn("fold", fold).drop("_r", "_n", "_shift")


def grid(steps: int = STEPS, low: float = LOW, high: float = HIGH) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def search(df: DataFrame, *by: str, steps: int = STEPS) -> DataFrame:
    """Best threshold per group and label by the mean F1 of five folds; the lowest of equals; 0.5 with score 1 without a positive record.

    Rows are counted by the grid cell of their score, and cells are added up
    from the top: the grid is never multiplied with the rows.
    """
    keys = [*by, "label"]
    ts = grid(steps)
    value = lambda i: F.element_at(F.array(*[F.lit(t) for t in ts]), i + 1)
    # cell c: the score is greater than thresholds 0 .. c-1; guessed by division, made exact by the two thresholds around
    guess = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((F.col("p") - LOW) / ((HIGH - LOW) / (steps - 1))))).cast("int")
    df = df.withColumn("_g", guess)
    below, above = (F.col("p") > value(F.col("_g"))).cast("int"), ((F.col("_g") + 1 < steps) & (F.col("p") > value(F.least(F.col("_g") + 1, F.lit(steps - 1))))).cast("int")
    cell = F.col("_g") + below + above
    f = contiguous_folds(df, keys)
    counts = f.groupBy(*keys, "fold", cell.alias("cell")).agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.sum((F.col("y") != 1).cast("long")).alias("b"))
    totals = counts.groupBy(*keys, "fold").agg(F.sum("a").alias("pos"))
    # at most steps + 1 cells a fold: small whatever the rows
    per = counts.where("cell > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cell") - 1))).groupBy(*keys, "fold", "i").agg(F.sum("a").alias("tp"), F.sum("b").alias("fp"))
    grid_ = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("threshold", value(F.col("i")))
    all_ = grid_.join(per, [*keys, "fold", "i"], "left").na.fill(0, ["tp", "fp"])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(1.0))
    means = all_.groupBy(*keys, "i", "threshold").agg(F.round(F.avg(f1), 9).alias("score"), F.sum("pos").alias("positives"))
    best = means.groupBy(*keys).agg(F.max_by(F.struct("threshold", "score"), F.struct(F.col("score"), -F.col("i"))).alias("m"), F.max("positives").alias("positives"))
    none = F.col("positives") == 0
    return best.select(*keys, F.when(none, 0.5).otherwise(F.round("m.threshold", 6)).alias("threshold"), F.when(none, 1.0).otherwise(F.round("m.score", 6)).alias("score"), "positives")


def with_fallback(per_language: DataFrame, overall: DataFrame, least: int = 100) -> DataFrame:
    """The language's threshold where it has at least `least` positive records, else the overall one."""
    j = per_language.join(overall.select("label", F.col("threshold").alias("_t")), "label")
    own = F.col("positives") >= least
    return j.select("lang_id", "label", F.when(own, F.col("threshold")).otherwise(F.col("_t")).alias("threshold"), own.alias("own"))


def raised(thresholds: DataFrame, floors: DataFrame) -> DataFrame:
    """The greater of a threshold and its recommended floor."""
    return thresholds.join(floors.withColumnRenamed("threshold", "_f"), ["lang_id", "label"], "left").withColumn("threshold", F.greatest("threshold", F.coalesce("_f", "threshold"))).drop("_f")


def applied(df: DataFrame, thresholds: DataFrame, inclusive: bool = False) -> DataFrame:
    """`hat`: whether the score passes the threshold of its language and label; strictly unless `inclusive`."""
    j = df.join(thresholds, ["lang_id", "label"])
    return j.withColumn("hat", (F.col("p") >= F.col("threshold")) if inclusive else (F.col("p") > F.col("threshold")))


def verdicts(df: DataFrame, thresholds: dict[str, float] = SERVING_THRESHOLDS, inclusive: bool = True) -> DataFrame:
    """Per record: the labels that pass in label order, whether there is any, and the ranking of all by score.

    Ties in the ranking keep label order.
    """
    t = lookup(thresholds, F.col("label"))
    at = lookup({x: i for i, x in enumerate(LABELS)}, F.col("label"))
    hit = (F.col("p") >= t) if inclusive else (F.col("p") > t)
    items = df.select("row_id", F.struct(at.alias("i"), "label", "p", hit.alias("hit")).alias("x"))
    g = items.groupBy("row_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # six labels a record
    ranked = F.transform(F.sort_array(F.transform("xs", lambda x: F.struct((-x["p"]).alias("p"), x["i"].alias("i"), x["label"].alias("label")))), lambda x: x["label"])
    return g.select("row_id", F.transform(F.filter("xs", lambda x: x["hit"]), lambda x: x["label"]).alias("categories"), ranked.alias("ranking")).withColumn("is_toxic", F.size("categories") > 0)


def offset_probability(p: Column, label: Column, lang_id: Column) -> Column:
    """A served probability after the logit offset that every language but English gets."""
    x = F.log(p / (1 - p)) + F.when(lang_id != 0, lookup(LOGIT_OFFSETS, label)).otherwise(0.0)
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(1 / (1 + F.exp(-x)))


def tidy(spark: SparkSession, thresholds: dict[str, float], langs: range = range(7)) -> DataFrame:
    return spark.createDataFrame([(i, x, t) for i in langs for x, t in thresholds.items()], "lang_id int, label string, threshold double")
