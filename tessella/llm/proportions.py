"""Problem 3: a sample whose category shares match given targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep

_BUCKETS = 4096  # of the uniform draw; a boundary bucket holds about 1/4096 of a category


def _draw(plan: str, key: str, seed: int) -> Column:
    """A uniform draw in [0, 1) fixed by seed, plan and row: the same on every executor and after a retry."""
    return (F.xxhash64(F.lit(seed), F.col(plan), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def availability(rows: DataFrame, targets: DataFrame, category: list[str], plan: str = "plan_id") -> DataFrame:
    """Per row of `targets`: rows `available` and `needed`, and the `deficit` (0 where the target can be met).

    Needed is the larger of `min_rows` and `share` x `sample_rows` rounded half
    away from zero.  Category values are compared exactly as stored; a null in
    any of them is in no category, so a target with a null category finds no
    rows.  Null share, min_rows or sample_rows count as 0.  An empty `rows`
    gives every target as a deficit; repeated rows count each time.
    """
    counts = rows.groupBy(*category).agg(F.count(F.lit(1)).alias("_n"))
    t = targets.select(plan, *category, "share", "min_rows", "sample_rows")
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce("share", F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0))).cast("long"))
    joined = t.join(counts, category, "left").withColumn("needed", wanted).withColumn("available", F.coalesce("_n", F.lit(0)).cast("long"))
    return joined.select(plan, *category, "available", "needed", F.greatest(F.lit(0), F.col("needed") - F.col("available")).alias("deficit"))


def sample(rows: DataFrame, targets: DataFrame, category: list[str], key: str = "row_id", plan: str = "plan_id", seed: int = 17, oversampling: float = 0.05) -> DataFrame:
    """`plan`, the category and `key` of the rows sampled for every plan.

    Each row is drawn independently with the acceptance probability of its
    category (needed / available, raised by `oversampling` and three standard
    deviations); then counts are corrected exactly: buckets of the draw that
    lie wholly below the needed count are taken, only the boundary bucket is
    ranked.  A category short of rows gives all it has.  No task ever holds a
    whole category.  Should a draw fall short although rows exist, its category
    is drawn again with twice the probability.
    """
    have = keep(availability(rows, targets, category, plan))
    p0 = F.least(F.lit(1.0), F.col("needed") / F.col("available") * (1 + oversampling) + 3 * F.sqrt(F.col("needed").cast("double")) / F.col("available"))
    have = have.where("available > 0 and needed > 0").withColumn("p", p0)
    slim = rows.select(key, *category)
    while True:
        drawn = slim.join(have, category).withColumn("u", _draw(plan, key, seed)).where("u < p")
        bucket = F.floor(F.col("u") / F.col("p") * _BUCKETS).cast("int")
        drawn = drawn.withColumn("bucket", bucket)
        per_bucket = drawn.groupBy(plan, *category, "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"), F.first("available").alias("available"), F.first("p").alias("p"))
        per_bucket = keep(per_bucket)
        # at most _BUCKETS rows a category: a window over counts, not over rows
        w = Window.partitionBy(plan, *category).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bounds = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < needed")
        got = per_bucket.groupBy(plan, *category).agg(F.sum("n").alias("n"), F.first("needed").alias("needed"), F.first("available").alias("available"))
        short = have.join(got.select(plan, *category, F.col("n").alias("_got")), [plan, *category], "left").where("coalesce(_got, 0) < least(needed, available) and p < 1")
        if short.isEmpty():
            break
        again = short.select(plan, *category, F.lit(True).alias("_again"))
        have = keep(have.join(again, [plan, *category], "left").withColumn("p", F.when(F.col("_again"), F.least(F.lit(1.0), F.col("p") * 2)).otherwise(F.col("p"))).drop("_again"))
    marked = drawn.join(bounds.select(plan, *category, "bucket", "before", "n"), [plan, *category, "bucket"])
    whole = marked.where("before + n <= needed").select(plan, *category, key)
    edge = marked.where("before + n > needed").withColumn("_r", F.row_number().over(Window.partitionBy(plan, *category, "bucket").orderBy("u", key)))
    return whole.unionByName(edge.where("before + _r <= needed").select(plan, *category, key))


def report(rows: DataFrame, targets: DataFrame, category: list[str], key: str = "row_id", plan: str = "plan_id") -> DataFrame:
    """Per row of `targets`: rows `available`, `needed` and `sampled`, and the `deficit` of the sample drawn (0 where the target was met)."""
    drawn = sample(rows, targets, category, key, plan).groupBy(plan, *category).agg(F.count(F.lit(1)).alias("_s"))
    j = availability(rows, targets, category, plan).drop("deficit").join(drawn, [plan, *category], "left").withColumn("sampled", F.coalesce("_s", F.lit(0)).cast("long"))
    return j.select(plan, *category, "available", "needed", "sampled", (F.col("needed") - F.col("sampled")).alias("deficit"))
