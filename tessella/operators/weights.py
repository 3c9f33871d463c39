"""Class weights from label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import long_labels
from ..schema import lookup

# Defaults of the weight formula.
DEFAULTS = {"max_weight": 15.0, "min_weight": 0.5, "gamma": 2.0, "alpha": 0.25, "boost_factor": 1.0}
SEVERE = ("threat", "identity_hate")


def supports(df: DataFrame, *by: str) -> DataFrame:
    """Negatives and positives per group and label; null labels are in neither."""
    long = long_labels(df, *by).where("v is not null")
    return long.groupBy(*by, "label").agg(F.sum((F.col("v") <= 0).cast("long")).alias("support_0"), F.sum((F.col("v") > 0).cast("long")).alias("support_1"))


def balanced(s: DataFrame) -> DataFrame:
    """N / (2 positives) and N / (2 negatives), 0 where there are none."""
    n = (F.col("support_0") + F.col("support_1")).cast("double")
    w = lambda c: F.coalesce(F.try_divide(n, 2 * F.col(c)), F.lit(0.0))
    return s.withColumn("weight_1", w("support_1")).withColumn("weight_0", w("support_0")).withColumn("ratio", F.coalesce(F.try_divide(F.col("support_1"), n), F.lit(0.0)))


def normalised(w: DataFrame, baseline: str = "obscene", first_lang: str | None = None) -> DataFrame:
    """Positive weights over that of the baseline label: of the same language, or of `first_lang` for all."""
    own = Window.partitionBy("lang") if first_lang is None else Window.partitionBy()
    pick = F.col("label") == baseline
    if first_lang is not None:
        pick = pick & (F.col("lang") == first_lang)
    base = F.max(F.when(pick, F.col("weight_1"))).over(own)
    return w.withColumn("normalised", F.try_divide("weight_1", base))


def parameters(spark: SparkSession, langs: list[str], labels: list[str], overrides: dict[tuple[str, str], dict[str, float]] | None = None) -> DataFrame:
    """Parameters of every language and label: the defaults, replaced by overrides; dangerous values raise ValueError."""
    rows = []
    for x in langs:
        for y in labels:
            p = DEFAULTS | (overrides or {}).get((x, y), {})
            if p["boost_factor"] * p["max_weight"] > 30:
                raise ValueError(f"boost times greatest weight is over 30 for {x} {y}")
            if not 0 < p["gamma"] <= 5:
                raise ValueError(f"gamma must lie in (0, 5] for {x} {y}")
            if not 0 < p["alpha"] < 1:
                raise ValueError(f"alpha must lie in (0, 1) for {x} {y}")
            rows.append((x, y, *[float(p[k]) for k in DEFAULTS]))
    return spark.createDataFrame(rows, "lang string, label string, " + ", ".join(f"{k} double" for k in DEFAULTS))


def focal(s: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """The focal weight of each (lang, label): `raw_weight_1`, `weight_1` within its limits and rounded to 3 places, `weight_0` = 1, and the constraints applied."""
    if params is None:
        s = s.withColumns({k: F.lit(v) for k, v in DEFAULTS.items()})
    else:
        s = s.join(params, ["lang", "label"])
    eps = 1e-7
    total = F.col("support_0") + F.col("support_1") + eps
    pt = F.col("support_1") / total + eps
    top = F.when((F.col("lang") == "en") & (F.col("label") == "threat"), F.least(F.col("max_weight"), F.lit(15.0))).when(F.col("label") == "identity_hate", F.least(F.col("max_weight"), F.lit(10.0))).otherwise(F.col("max_weight"))
    alpha = F.col("alpha") / (F.col("alpha") + (1 - F.col("alpha")) * (1 - pt))
    raw = alpha * F.pow(1 - pt, F.col("gamma")) / (pt + eps)
    severity = (1 + F.try_divide(F.log1p(total), F.log1p(F.col("support_1")))) / 2
    raw = F.when(F.col("label").isin(*SEVERE), raw * severity).otherwise(raw) * F.col("boost_factor")
    none, empty = F.col("support_1") == 0, (F.col("support_0") + F.col("support_1")) == 0
    return s.withColumn("effective_max", top).withColumn("raw_weight_1", F.when(empty, 1.0).when(none, F.col("max_weight")).otherwise(raw)).withColumn(
        "weight_1", F.when(empty, 1.0).when(none, F.col("max_weight")).otherwise(F.round(F.least(F.col("effective_max"), F.greatest(F.col("min_weight"), F.col("raw_weight_1"))), 3))
    ).withColumn("weight_0", F.lit(1.0)).withColumn(
        "constraints", F.when(empty, F.array(F.lit("empty"))).when(none, F.array(F.lit("no_positives"))).otherwise(F.array_compact(F.array(F.when(F.col("raw_weight_1") > F.col("effective_max"), "max"), F.when(F.col("raw_weight_1") < F.col("min_weight"), "min"))))
    )


def rescaled(w: DataFrame, top: float = 15.0) -> DataFrame:
    """Each label's weights scaled so that the greatest over the languages is `top`, to 3 places; the true raw weight is kept."""
    return w.withColumn("scaled_1", F.round(F.col("weight_1") / F.max("weight_1").over(Window.partitionBy("label")) * top, 3))


def warnings(w: DataFrame) -> DataFrame:
    """Rows whose weight ratio or parameters are risky: `lang`, `label`, `rule`, `grade`."""
    ratio = F.try_divide("weight_1", "weight_0")
    gamma = F.col("gamma") if "gamma" in w.columns else F.lit(DEFAULTS["gamma"])
    alpha = F.col("alpha") if "alpha" in w.columns else F.lit(DEFAULTS["alpha"])
    rule = lambda c, name, grade: F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(grade).alias("grade")))
    rules = F.array(
        rule(ratio > 30, "ratio", "error"), rule((ratio > 20) & (ratio <= 30), "ratio", "warning"),
        rule(gamma > 5, "gamma", "error"), rule((gamma > 4) & (gamma <= 5), "gamma", "warning"),
        rule(alpha > 0.9, "alpha", "error"), rule((alpha > 0.7) & (alpha <= 0.9), "alpha", "warning"),
        rule((gamma > 3) & (ratio > 15), "gamma_and_ratio", "warning"),
    )
    return w.select("lang", "label", F.explode(F.array_compact(rules)).alias("x")).select("lang", "label", "x.*")


def inconsistent(w: DataFrame, reference: str = "en", low: float = 0.67, high: float = 1.5) -> DataFrame:
    """Severe labels whose weight is far from that of the reference language."""
    base = w.where((F.col("lang") == reference) & F.col("label").isin(*SEVERE)).select("label", F.col("weight_1").alias("_b"))
    j = w.where(F.col("lang") != reference).join(base, "label").withColumn("ratio", F.round(F.try_divide("weight_1", "_b"), 6))
    return j.where((F.col("ratio") < low) | (F.col("ratio") > high)).select("lang", "label", "weight_1", "ratio")


def language_scale(w: DataFrame) -> DataFrame:
    """Mean positive weight of each language."""
    return w.groupBy("lang").agg(F.round(F.avg("weight_1"), 6).alias("scale"))


def log_ratio_weight(history: Column, batch: Column) -> Column:
    """The dynamic weight of a label from its historical and batch share: exp of log(1 + 1/share) kept within 2."""
    share = 0.7 * history + 0.3 * batch
    return F.exp(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log1p(1 / (share + 1e-7)))))


# Per-label adjustments of the dynamic weights, in label order.
ADJUSTMENTS = {
    "en": (1.0, 1.0, 0.9, 0.85, 1.1, 1.0), "ru": (1.0, 1.0, 1.0, 1.0, 0.9, 1.0), "tr": (1.0, 1.0, 1.0, 1.0, 0.9, 0.95), "es": (1.0, 1.0, 1.0, 1.0, 0.9, 1.0),
    "fr": (1.0, 1.0, 1.0, 1.0, 0.9, 1.0), "it": (1.0, 1.0, 1.0, 1.0, 0.9, 1.0), "pt": (1.0, 1.0, 1.0, 1.0, 0.9, 1.0),
}


def _shares(df: DataFrame, batch: str, order: str, labels: list[str], decay: float) -> DataFrame:
    """Per batch, language and label: `n`, `pos` and the running counts `_hp`, `_hn`."""
    from .windows import exponential_mean

    counts = df.groupBy(batch, "lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.coalesce(F.col(x), F.lit(0)) > 0).cast("long")).alias(x) for x in labels])
    long = counts.unpivot([batch, "lang", "n"], labels, "label", "pos")
    run = exponential_mean(long, "pos", ["lang", "label"], [order], decay, None).withColumnRenamed("ema", "_hp")
    return exponential_mean(run, "n", ["lang", "label"], [order], decay, None).withColumnRenamed("ema", "_hn")


def dynamic_focal(df: DataFrame, batch: str, order: str, labels: list[str], decay: float = 0.95) -> DataFrame:
    """`alpha` and `gamma` of the focal loss of each batch and label: means over the batch's languages, weighted by their rows.

    Of a language: alpha is 1 over its share of positives, kept within 0.05
    and 0.95; gamma the log of (1 + 1 / share), kept within 1 and 4.
    """
    share = 0.7 * F.col("_hp") / (F.col("_hn") + 1e-7) + 0.3 * F.col("pos") / F.col("n") + 1e-7
    run = _shares(df, batch, order, labels, decay).withColumns({"_a": 1 / F.greatest(F.lit(0.05), F.least(F.lit(0.95), share)), "_g": F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.log1p(1 / share)))})
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)
    return run.groupBy(batch, "label").agg(mean("_a").alias("alpha"), mean("_g").alias("gamma"))


def dynamic(df: DataFrame, batch: str, order: str, labels: list[str], scale: DataFrame | None = None, decay: float = 0.95) -> DataFrame:
    """Weights of each batch, language and label from running and batch shares.

    Running counts decay by `decay` a batch of the language; weights are
    divided by their mean over the batch's rows and kept within 0.1 and 10.
    """
    run = _shares(df, batch, order, labels, decay)
    adjust = {f"{x}|{y}": v for x, vs in ADJUSTMENTS.items() for y, v in zip(labels, vs)}
    w = log_ratio_weight(F.col("_hp") / (F.col("_hn") + 1e-7), F.col("pos") / F.col("n")) * lookup(adjust, F.concat_ws("|", "lang", "label"), 1.0)
    if scale is not None:
        run, w = run.join(scale, "lang", "left"), w * F.coalesce(F.col("scale"), F.lit(1.0))
    run = run.withColumn("_w", w)
    mean = run.groupBy(F.col(batch).alias("_batch")).agg((F.sum(F.col("_w") * F.col("n")) / F.sum("n")).alias("_mean"))
    return run.join(mean, F.col(batch) == F.col("_batch")).select(batch, "lang", "label", "n", "pos", F.round(F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.col("_w") / F.col("_mean"))), 6).alias("weight"))
