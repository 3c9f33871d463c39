from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import binning as B
from tessella.operators import dedup as D
from tessella.operators import explain as E
from tessella.operators import metrics as M
from tessella.operators import ranking as R
from tessella.operators import sampling as G
from tessella.operators import stats as S
from tessella.operators import thresholds as T
from tessella.operators import weights as W
from tessella.operators import windows as V
from tessella.schema import LABELS


def test_keep_first_and_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "row_id long, k string")
    assert sorted(r.row_id for r in D.keep_first(df, "k", "row_id").collect()) == [1, 2, 4]
    assert {(r.k, r.n) for r in D.duplicate_groups(df, "k", "row_id").collect()} == {("a", 2), (None, 2)}
    again = D.keep_first(D.keep_first(df, "k", "row_id"), "k", "row_id")
    assert again.count() == 3


def test_leakage(spark):
    rows = [(1, "train", "a"), (2, "val", "A "), (3, "val", "b"), (4, "test", "b"), (5, "test", "c"), (6, "train", "a")]
    df = spark.createDataFrame(rows, "row_id long, split string, comment_text string")
    assert sorted(r.row_id for r in D.without_leakage(df).collect()) == [1, 3, 5, 6]
    assert {tuple(r) for r in D.split_overlaps(D.hashes(df)).collect()} == {("train", "val", 1), ("test", "val", 1)}
    assert {(r.pair, r.shared) for r in D.contamination(df).collect()} == {("train_val", 1), ("train_test", 0), ("val_test", 1)}


def test_merge_new(spark):
    main = spark.createDataFrame([("a",), (None,)], "text string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "aug_id long, text string")
    assert [r.aug_id for r in D.merge_new(main, new, "text", "aug_id").collect()] == [2]


def test_ranks_equal_sort(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("g"))
    got = {r.row_id: r._rank for r in R.by_draw(df, ["g"], "row_id").collect()}
    from pyspark.sql import Window

    from tessella.functions.keys import draw

    want = {r.row_id: r.w for r in df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(draw(F.col("row_id")), "row_id"))).collect()}
    assert got == want
    assert {r.row_id: r._rank for r in R.by_number(df, [], "row_id").collect()} == {i: i + 1 for i in range(500)}


def test_folds_follow_strided_allocation(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("s"))
    f = G.folds(df, "s", 10)
    per = {(r.s, r.fold): r.n for r in f.groupBy("s", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(f"s{i % 4}" for i in range(103))
    for k in range(10):
        for s in ("s0", "s1", "s2", "s3"):
            assert per.get((s, k), 0) == order[k::10].count(s)
    parts = G.three_way(df, "s").groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 103 and {r.part for r in parts} == {"train", "val", "test"}


def test_balance_and_replacement(spark):
    df = spark.createDataFrame([(i, "x" if i < 8 else "y", i % 8 < 6) for i in range(12)], "row_id long, lang string, pos boolean")
    got = G.balanced(df, "pos", "lang")
    n = {(r.lang, r.pos): r.n for r in got.groupBy("lang", "pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {("x", True): 6, ("x", False): 6, ("y", True): 4}
    need = spark.createDataFrame([("x", 20), ("y", 0)], "lang string, _need int")
    drawn = G.with_replacement(df, need, ["lang"])
    assert drawn.count() == 20 and {r.lang for r in drawn.collect()} == {"x"}
    assert [r.row_id for r in G.with_replacement(df, need, ["lang"]).orderBy("draw").collect()] == [r.row_id for r in drawn.orderBy("draw").collect()]


def test_reduced_and_removed(spark):
    df = spark.createDataFrame([(i, i < 50) for i in range(100)], "row_id long, pos boolean")
    ratio = spark.createDataFrame([(0.2,)], "target double")
    assert G.reduced_to_ratio(df, "pos", ratio).where("pos").count() == 20
    assert G.reduced_to_ratio(df, "pos", spark.createDataFrame([(0.7,)], "target double")).count() == 100
    assert G.removed(df, F.col("pos"), 150).count() == 50


# counts of a published table: rows of each language by the number of positive labels are not at hand, so a small one is checked by hand
def test_chi_square_and_p(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("b", 0, 30), ("b", 1, 5)], "r string, c int, n long")
    x = S.chi_square(df, "r", "c", "n").first()
    e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    want = sum((o - y) ** 2 / y for o, y in zip((10, 20, 30, 5), e))
    assert abs(x.chi2 - want) < 1e-3 and x.dof == 1
    assert abs(S.p_value(3.841458820694124, 1) - 0.05) < 1e-9 and abs(S.p_value(124.342, 100) - 0.05) < 1e-4 and S.p_value(0, 3) == 1


def _auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics(spark):
    random.seed(4)
    rows = [(i, 0, "toxic", int(random.random() < 0.4), round(random.random(), 1)) for i in range(60)] + [(i, 0, "threat", 0, 0.2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, lang_id int, label string, y int, p double")
    c = {r.label: r for r in M.per_class(df).collect()}
    assert abs(c["toxic"].auc - _auc([(y, p) for _, _, x, y, p in rows if x == "toxic"])) < 1e-12
    assert (c["threat"].auc, c["threat"].precision, c["threat"].recall, c["threat"].f1, c["threat"].support) == (0, 1, 1, 1, 0)
    a = M.averaged(M.per_class(df)).first()
    assert a.auc_macro == 0 and abs(a.f1_weighted - c["toxic"].f1) < 1e-12
    r = M.row_figures(df).first()
    wrong = sum((y == 1) != (p > 0.5) for *_, y, p in rows)
    assert abs(r.hamming - wrong / 120) < 1e-12 and r.records == 60
    assert M.roc(df, "label").where("label = 'threat'").count() == 0
    same = M.per_class(df.repartition(7)).where("label = 'toxic'").first()
    assert same.auc == c["toxic"].auc


def test_usable_drops_nulls_and_repeats(spark):
    rows = [(1, 0, "toxic", 1, 0.5), (1, 0, "toxic", 1, 0.5), (2, 0, "toxic", None, 0.1), (3, 0, "toxic", 0, None), (4, 0, "toxic", 0, float("nan"))]
    assert M.usable(spark.createDataFrame(rows, "row_id long, lang_id int, label string, y int, p double")).count() == 1


def test_focal_loss(spark):
    x = spark.range(1).select(M.focal_loss(F.lit(0.3), F.lit(1)).alias("a"), M.focal_loss(F.lit(float("inf")), F.lit(1)).alias("b")).first()
    bce = -math.log(1 / (1 + math.exp(-0.3)))
    assert abs(x.a - 0.25 * (1 - math.exp(-bce)) ** 2 * bce) < 1e-12 and x.b is None


def test_threshold_search_against_brute_force(spark):
    random.seed(9)
    rows = [(i, 0, "toxic", int(random.random() < 0.5), round(random.random(), 3)) for i in range(57)]
    df = spark.createDataFrame(rows, "row_id long, lang_id int, label string, y int, p double")
    got = T.search(df).first()
    ys = [y for *_, y, _ in rows]
    first = ys[0]
    order = sorted(range(57), key=lambda i: (ys[i] != first))
    fold = {}
    alloc = [[sum(ys[order[j]] == c for j in range(k, 57, 5)) for c in (0, 1)] for k in range(5)]
    for c in (0, 1):
        at = [i for i in range(57) if ys[i] == c]
        for k in range(5):
            for i in at[: alloc[k][c]]:
                fold[i] = k
            at = at[alloc[k][c] :]
    best = (-1, None)
    for t in T.grid():
        fs = []
        for k in range(5):
            tp = sum(ys[i] and rows[i][4] > t for i in fold if fold[i] == k)
            hat = sum(rows[i][4] > t for i in fold if fold[i] == k)
            pos = sum(ys[i] for i in fold if fold[i] == k)
            fs.append(2 * tp / (hat + pos) if hat + pos else 1)
        s = round(sum(fs) / 5, 9)
        if s > best[0]:
            best = (s, t)
    assert abs(got.score - best[0]) < 1e-6 and abs(got.threshold - best[1]) < 1e-6
    none = T.search(df.withColumn("y", F.lit(0))).first()
    assert (none.threshold, none.score) == (0.5, 1.0)


def test_verdicts(spark):
    df = spark.createDataFrame([(1, x, p) for x, p in zip(LABELS, (0.6, 0.1, 0.1, 0.48, 0.1, 0.9))], "row_id long, label string, p double")
    v = T.verdicts(df).first()
    assert v.categories == ["toxic", "threat", "identity_hate"] and v.is_toxic and v.ranking == ["identity_hate", "toxic", "threat", "severe_toxic", "obscene", "insult"]
    assert T.verdicts(df, inclusive=False).first().categories == ["identity_hate"]


def test_weights(spark):
    s = spark.createDataFrame([("en", "toxic", 90, 10), ("en", "threat", 99, 1), ("fr", "toxic", 0, 0), ("fr", "threat", 5, 0), ("fr", "identity_hate", 9999, 1)], "lang string, label string, support_0 long, support_1 long")
    w = {(r.lang, r.label): r for r in W.focal(s).collect()}
    assert w["fr", "toxic"].weight_1 == 1 and w["fr", "threat"].weight_1 == 15 and w["fr", "identity_hate"].weight_1 == 10
    pt = 10 / (100 + 1e-7) + 1e-7
    raw = 0.25 / (0.25 + 0.75 * (1 - pt)) * (1 - pt) ** 2 / (pt + 1e-7)
    assert abs(w["en", "toxic"].raw_weight_1 - raw) < 1e-9
    b = {(r.lang, r.label): r.weight_1 for r in W.balanced(s).collect()}
    assert b["en", "toxic"] == 5 and b["fr", "threat"] == 0
    with pytest.raises(ValueError):
        W.parameters(spark, ["en"], ["toxic"], {("en", "toxic"): {"gamma": 6.0}})
    with pytest.raises(ValueError):
        W.parameters(spark, ["en"], ["toxic"], {("en", "toxic"): {"boost_factor": 3.0}})


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, None)], "v double")
    e = B.fit_edges(df, "v")
    assert e == [1.0]
    assert [r[0] for r in df.select(B.level(F.col("v"), e)).collect()] == [0, 1, 1, None]
    cut = [0.1, 0.5, 1.0]
    got = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.5, 0.51, 1.0, 2.0)], "v double").select(B.level(F.col("v"), cut)).collect()
    assert [r[0] for r in got] == [1, 1, 1, 2, 2, 2]


def test_windows(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "i int, v double").withColumn("g", F.lit(1))
    e = {r.i: r.ema for r in V.exponential_mean(df, "v", ["g"], ["i"]).collect()}
    s = 0.0
    for i in range(30):
        s = 0.95 * s + 0.05 * (i % 3)
        assert abs(e[i] - s) < 1e-6
    b = V.best_so_far(df, "v", ["g"], ["i"]).orderBy("i").collect()
    assert [r.improved for r in b][:5] == [True, True, True, False, False] and b[-1].best == 2


def test_importance(spark):
    df = spark.createDataFrame([(1, "You idiot , die")], "row_id long, t string")
    rows = E.token_importance(df, "t", {x: F.lit(0.5) for x in LABELS}).orderBy("pos").collect()
    assert [r.insult for r in rows] == [0, 0.5, 0, 0] and [r.threat for r in rows] == [0, 0, 0, 0.5]
    low = E.token_importance(df, "t", {x: F.lit(0.01) for x in LABELS})
    assert low.agg(F.sum("insult")).first()[0] == 0


def test_classifiers_of_all_labels(spark):
    from tessella.operators import augmentation as A

    rows = [(i, ("d\u00e9j\u00e0 VU" if i % 2 else "deja vu") + (" bad" if i % 3 == 0 else " good"), int(i % 3 == 0), None if i < 4 else int(i % 2), 0) for i in range(60)] + [(99, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "row_id long, t string, toxic int, insult int, threat int").withColumn("t", A.unaccented(F.col("t")))
    assert {r.t for r in df.where("toxic = 1").collect()} == {"deja vu bad"}
    features, models = A.fit_classifiers(df, "t", ["toxic", "insult", "threat"])
    p = {r.row_id: r for r in A.probabilities(features, models, df, "t").collect()}
    assert len(p) == 61 and p[0].toxic > 0.9 > 0.1 > p[1].toxic and p[0].threat is None and p[99].insult is not None
    assert models["toxic"].getMaxIter() == 200 and models["threat"] is None


def test_bootstrap_means_one(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id")
    n = G.bootstrap_counts(df, 2).agg(F.sum("times")).first()[0] / 8000
    assert abs(n - 1) < 0.05


def test_bootstraps_take_1000_replicates(spark):
    import inspect

    from tessella.plans import queries as Q

    rows = [(i, "toxic", i % 2, i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, label string, y int, p double")
    assert M.bootstrap_auc(df, "label").first().replicates > 950  # those that draw both classes
    assert inspect.signature(M.roc_band).parameters["replicates"].default == 1000
    assert ", 1000)" in inspect.getsource(Q.bootstrap_sample)


def test_exponential_mean_of_a_long_hot_group(spark):
    from tessella.operators import windows as V

    for keep, n in ((0.999, 1500), (0.95, 12_000), (0.02, 700)):
        rows = [(0, i, None if i % 17 == 3 else float(i % 7)) for i in range(n)] + [(1, i, 1.0) for i in range(3)]
        got = {(r.g, r.i): r.ema for r in V.exponential_mean(spark.createDataFrame(rows, "g int, i long, v double"), "v", ["g"], ["i"], keep).collect()}
        s = {0: 0.0, 1: 0.0}
        for g, i, v in rows:
            s[g] = keep * s[g] + (1 - keep) * (v or 0.0)
            assert abs(got[g, i] - s[g]) < 2e-6, (keep, g, i)
    assert V.exponential_mean(spark.createDataFrame([], "g int, i long, v double"), "v", ["g"], ["i"]).count() == 0


def test_running_totals_of_one_hot_key(spark):
    from tessella.operators import ranking as R

    rows = [("hot", i, i % 5) for i in range(3000)] + [(None, i, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(7)
    out = R.running(df, ["g"], ["i"], R.equal_ranges(df, "i"), {"v": "v"})
    assert out.columns == ["g", "i", "v", "_before_v"]
    got = {(r.g, r.i): r._before_v for r in out.collect()}
    total = 0
    for g, i, v in rows[:3000]:
        assert got[g, i] == total
        total += v
    assert [got[None, i] for i in range(4)] == [0, 1, 2, 3]


def test_ids_of_one_hot_key(spark):
    from tessella.functions import keys as K

    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 900)], "x string, i long").repartition(5)
    got = {r.i: r.x for r in K.unique_ids(df, "x", "i").collect()}
    assert all(got[i] == f"{i}_a" for i in range(500)) and got[900] == "0_b"


def test_edges_of_many_values(spark):
    import numpy as np

    from tessella.operators import binning as B

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0.2, 0.02, 6000), rng.normal(0.5, 0.02, 6000), rng.normal(0.7, 0.02, 6000), rng.normal(0.95, 0.01, 6000)])
    e = B.fit_edges(spark.createDataFrame([(float(x),) for x in v], "v double"), "v")
    width = v.std(ddof=1) * len(v) ** -0.2
    at = np.linspace(0, 1, 100)
    d = np.exp(-0.5 * ((at[:, None] - v) / width) ** 2).sum(1)
    minima = [at[i] for i in range(1, 99) if d[i] < d[i - 1] and d[i] < d[i + 1]]
    assert len(minima) >= 3 and np.allclose(e, [0.0, *minima[:3], 1.0])
    u = np.arange(1, 20_001) / 7.0
    assert np.allclose(B.fit_edges(spark.createDataFrame([(float(x),) for x in u], "v double"), "v"), [u[0], u[4999], u[9999], u[14999], u[-1]])


def test_corners_of_a_roc_curve(spark):
    from tessella.operators import metrics as M

    rows = [(i, 0, "a", y, p) for i, (y, p) in enumerate([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (1, 0.5), (0, 0.4), (0, 0.3)])]
    df = spark.createDataFrame(rows, "row_id long, lang_id int, label string, y int, p double")
    got = sorted((r.fpr, r.tpr) for r in M.roc_corners(M.roc(df, "label"), "label").collect())
    assert [(round(x, 3), round(y, 3)) for x, y in got] == [(0.0, 0.0), (0.0, 0.667), (0.5, 0.667), (0.5, 1.0), (1.0, 1.0)]
