"""Classification metrics on the long form: one row per record and label with `y` (0/1) and `p`.

A prediction is positive if p is greater than the threshold, strictly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep
from .ranking import running, score_bucket


def usable(predictions: DataFrame) -> DataFrame:
    """Rows with finite `y` and `p`, each (row, language, label) once."""
    ok = F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p")
    return predictions.where(ok).select("row_id", "lang_id", "label", "y", "p").distinct()


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(1.0))


def confusion(df: DataFrame, *by: str, threshold: Column | float = 0.5) -> DataFrame:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    hat = F.col("p") > t
    y = F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*by).agg(n(y & hat).alias("tp"), n(~y & hat).alias("fp"), n(~y & ~hat).alias("tn"), n(y & ~hat).alias("fn"))


def prf(conf: DataFrame) -> DataFrame:
    """Precision, recall and F1, 1 where undefined; without a positive record precision and F1 are 1 if nothing was predicted, else 0, recall 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fn) == 0
    special = F.when(tp + fp == 0, 1.0).otherwise(0.0)
    return (
        conf.withColumn("support", tp + fn)
        .withColumn("precision", F.when(none, special).otherwise(F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0))))
        .withColumn("recall", F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(1.0))))
        .withColumn("f1", F.when(none, special).otherwise(_f1(tp, fp, fn)))
    )


def auc(df: DataFrame, *by: str) -> DataFrame:
    """Exact ROC-AUC with ties at half, over distinct scores; 0 if a class is missing."""
    counts = df.groupBy(*by, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.sum((F.col("y") != 1).cast("long")).alias("b"))
    wins = F.sum(F.col("a") * (F.col("_before_b") + F.col("b") / 2.0))
    return running(counts, list(by), ["p"], score_bucket("p"), {"b": "b"}).groupBy(*by).agg(F.coalesce(F.try_divide(wins, F.sum("a").cast("double") * F.sum("b")), F.lit(0.0)).alias("auc"))


def brier(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def per_class(df: DataFrame, *by: str, threshold: Column | float = 0.5) -> DataFrame:
    """Everything per label (and group): confusion, precision, recall, F1, AUC, Brier score, support."""
    keys = [*by, "label"]
    return prf(confusion(df, *keys, threshold=threshold)).join(auc(df, *keys), keys).join(brier(df, *keys), keys)


def averaged(classes: DataFrame, *by: str) -> DataFrame:
    """Macro means and means weighted by support of the per-class figures; AUC means are 0 if any class lacks one."""
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    whole = F.min((F.col("support") > 0) & (F.col("fp") + F.col("tn") > 0))
    return classes.groupBy(*by).agg(
        F.when(whole, F.avg("auc")).otherwise(0.0).alias("auc_macro"), F.when(whole, w("auc")).otherwise(0.0).alias("auc_weighted"),
        *[x for c in ("precision", "recall", "f1") for x in (F.avg(c).alias(f"{c}_macro"), w(c).alias(f"{c}_weighted"))],
    )


def row_figures(df: DataFrame, *by: str, threshold: Column | float = 0.5) -> DataFrame:
    """Hamming loss, exact match and number of records."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    wrong = (F.col("y") == 1) != (F.col("p") > t)
    rows = df.groupBy(*by, "row_id").agg(F.sum(wrong.cast("long")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return rows.groupBy(*by).agg((F.sum("_w") / F.sum("_n")).alias("hamming"), F.avg((F.col("_w") == 0).cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("records"))


def tree(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The whole evaluation in long form: `threshold_set`, `scope`, `lang_id`, `label`, `metric`, `value`.

    `thresholds` holds (`threshold_set`, `lang_id`, `label`, `threshold`), a
    table as small as labels times languages.
    """
    j = keep(df).join(thresholds, ["lang_id", "label"]).withColumnRenamed("threshold", "_t")
    names = ["auc", "precision", "recall", "f1", "brier", "support"]
    wide = ["auc_macro", "auc_weighted", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted", "hamming", "exact_match", "records"]
    s = "threshold_set"
    t = F.col("_t")

    def long(x: DataFrame, scope: str, cols: list[str]) -> DataFrame:
        x = x.withColumns({c: F.lit(None).cast(k) for c, k in (("lang_id", "int"), ("label", "string")) if c not in x.columns})
        x = x.select(s, F.lit(scope).alias("scope"), "lang_id", "label", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in cols])
        return x.unpivot([s, "scope", "lang_id", "label"], cols, "metric", "value")

    classes = per_class(j, s, threshold=t)
    by_lang = per_class(j, s, "lang_id", threshold=t)
    overall = averaged(classes, s).join(row_figures(j, s, threshold=t), s)
    langs = averaged(by_lang, s, "lang_id").join(row_figures(j, s, "lang_id", threshold=t), [s, "lang_id"])
    return long(overall, "overall", wide).unionByName(long(langs, "per_language", wide)).unionByName(long(classes, "per_class", names))


def roc(df: DataFrame, *by: str) -> DataFrame:
    """Points of the ROC curve, one a distinct score, from the greatest down; groups of one class are left out.

    `roc_corners` drops points within straight stretches and adds the start (0, 0).
    """
    counts = df.groupBy(*by, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.sum((F.col("y") != 1).cast("long")).alias("b"))
    counts = keep(counts)
    totals = counts.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.sum("a").alias("_p"), F.sum("b").alias("_n")).where("_p > 0 and _n > 0")
    c = running(counts, list(by), [F.desc("p")], -score_bucket("p"), {"a": "a", "b": "b"})
    on = F.lit(True)
    for i, x in enumerate(by):
        on = on & F.col(x).eqNullSafe(F.col(f"_g{i}"))
    c = c.join(totals, on).withColumns({"tp": F.col("_before_a") + F.col("a"), "fp": F.col("_before_b") + F.col("b")})
    return c.select(*by, "p", F.round(F.col("fp") / F.col("_n"), 6).alias("fpr"), F.round(F.col("tp") / F.col("_p"), 6).alias("tpr"))


def roc_corners(points: DataFrame, *by: str) -> DataFrame:
    """The points of `roc` where the curve turns, with its start and end: neighbours on one straight line are dropped.

    The neighbours of a point come from windows over buckets of the score and
    from the last point of the bucket before and the first of the one after.
    """
    cut = points.withColumn("_b", -score_bucket("p"))
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("p"))
    xy = F.struct("fpr", "tpr")
    cut = cut.withColumns({"_l": F.lag(xy).over(w), "_r": F.lead(xy).over(w)})
    ends = cut.groupBy(*by, "_b").agg(F.max_by(xy, "p").alias("_first"), F.min_by(xy, "p").alias("_last"))
    o = Window.partitionBy(*by).orderBy("_b")  # over buckets, not points
    ends = ends.select(*by, "_b", F.lag("_last").over(o).alias("_pl"), F.lead("_first").over(o).alias("_nf"))
    j = cut.join(ends, [*by, "_b"])
    j = j.withColumns({"_l": F.coalesce("_l", "_pl", F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))), "_r": F.coalesce("_r", "_nf")})
    turn = (F.col("fpr") - F.col("_l.fpr")) * (F.col("_r.tpr") - F.col("tpr")) - (F.col("_r.fpr") - F.col("fpr")) * (F.col("tpr") - F.col("_l.tpr"))
    kept = j.where(F.col("_r").isNull() | (F.abs(turn) > 1e-12)).select(*by, "p", "fpr", "tpr")
    start = points.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.unionByName(start)


def bootstrap_auc(df: DataFrame, *by: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Mean and population deviation of the AUC over Poisson bootstrap replicates."""
    from .sampling import bootstrap_counts

    drawn = bootstrap_counts(df, replicates, "row_id", seed)
    keys = [*by, "replicate"]
    counts = drawn.groupBy(*keys, "p").agg(F.sum(F.when(F.col("y") == 1, F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") != 1, F.col("times")).otherwise(0)).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = counts.withColumn("_below", below).groupBy(*keys).agg(F.try_divide(F.sum(F.col("a") * (F.col("_below") + F.col("b") / 2.0)), F.sum("a").cast("double") * F.sum("b")).alias("auc"))
    return one.groupBy(*by).agg(F.round(F.avg("auc"), 6).alias("auc_mean"), F.round(F.stddev_pop("auc"), 6).alias("auc_std"), F.count("auc").alias("replicates"))


def roc_band(df: DataFrame, *by: str, replicates: int = 1000, points: int = 100, seed: int = 7) -> DataFrame:
    """Mean true-positive rate on a grid of false-positive rates over bootstrap replicates, with one deviation below and above, within 0 and 1.  Replicates without rows of both classes do not count."""
    from .sampling import bootstrap_counts

    keys = [*by, "replicate"]
    drawn = bootstrap_counts(df, replicates, "row_id", seed)
    c = drawn.groupBy(*keys, "p").agg(F.sum(F.when(F.col("y") == 1, F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") != 1, F.col("times")).otherwise(0)).alias("b"))
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    c = c.withColumns({"x1": F.try_divide(F.sum("b").over(w), F.sum("b").over(all_)), "y1": F.try_divide(F.sum("a").over(w), F.sum("a").over(all_))}).where("x1 is not null and y1 is not null")
    o = Window.partitionBy(*keys).orderBy(F.desc("p"))
    c = c.withColumns({"x0": F.coalesce(F.lag("x1").over(o), F.lit(0.0)), "y0": F.coalesce(F.lag("y1").over(o), F.lit(0.0))})
    first, last = F.ceil(F.col("x0") * (points - 1)), F.floor(F.col("x1") * (points - 1))
    g = c.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("x", F.col("k") / (points - 1))
    tpr = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    at = g.withColumn("tpr", F.when(F.col("k") == 0, 0.0).otherwise(tpr)).groupBy(*keys, "k").agg(F.max("tpr").alias("tpr"))
    m, d = F.avg("tpr"), F.stddev_pop("tpr")
    return at.groupBy(*by, "k").agg(F.round(m, 6).alias("tpr"), F.round(F.greatest(F.lit(0.0), m - d), 6).alias("low"), F.round(F.least(F.lit(1.0), m + d), 6).alias("high"))


def focal_loss(x: Column, y: Column, alpha: float | None = 0.25, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """Focal loss of a logit: alpha (1 - exp(-bce))^gamma bce; without alpha the plain modulation; null for a logit that is not finite."""
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    loss = F.pow(1 - F.exp(-bce), gamma) * bce
    if alpha is not None:
        loss = loss * alpha
    if weight is not None:
        loss = loss * weight
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), loss)
