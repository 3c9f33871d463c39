from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.functions import text as X
from tessella.operators import augmentation as A
from tessella.operators import explain as E
from tessella.operators import inference as N
from tessella.operators import sampling as G
from tessella.operators import stats as S
from tessella.operators import windows as V
from tessella.schema import LABELS
from tessella.sources import files as FS


def test_labels_are_checked(spark):
    good = spark.createDataFrame([(0.0, 1.0), (None, float("nan"))], "toxic double, insult double")
    assert L.checked(good, ["toxic", "insult"]) is good and L.violations(good.limit(0), ["toxic"]).count() == 0
    bad = spark.createDataFrame([(0.5, 1), (0.5, 0), (2.0, None)], "toxic double, insult int")
    assert {tuple(r) for r in L.violations(bad, ["toxic", "insult"]).collect()} == {("toxic", 0.5, 2), ("toxic", 2.0, 1)}
    with pytest.raises(ValueError, match="toxic"):
        L.checked(bad, ["toxic", "insult"])


def test_noise(spark):
    df = spark.range(4000).select(F.col("id"), F.lit(0.5).alias("v"), F.lit(None).cast("double").alias("w"), F.lit(1.0).alias("x"))
    out = df.select(L.noisy("v", "id").alias("v"), L.noisy("w", "id").alias("w"), L.noisy("x", "id").alias("x"))
    m = out.agg(F.avg("v"), F.stddev("v"), F.min("v"), F.max("v"), F.count("w"), F.max("x"), F.min("x")).first()
    assert abs(m[0] - 0.5) < 0.01 and abs(m[1] - 0.1) < 0.01 and 0 <= m[2] < m[3] <= 1 and m[4] == 0 and m[5] == 1.0 and m[6] < 0.9
    assert out.collect() == df.repartition(5).orderBy("id").select(L.noisy("v", "id").alias("v"), L.noisy("w", "id").alias("w"), L.noisy("x", "id").alias("x")).collect()


def test_sequences(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), (None,), ([9] * 10,)], "ids array<int>")
    got = [r.s.asDict() for r in df.select(X.sequence(F.col("ids"), 6).alias("s")).collect()]
    assert got[0] == {"input_ids": [0, 5, 6, 7, 2, 1], "attention_mask": [1, 1, 1, 1, 1, 0], "cut": 0}
    assert got[1] == got[2] == {"input_ids": [0, 2, 1, 1, 1, 1], "attention_mask": [1, 1, 0, 0, 0, 0], "cut": 0}
    assert got[3] == {"input_ids": [0, 9, 9, 9, 9, 2], "attention_mask": [1] * 6, "cut": 6}
    ids = spark.createDataFrame([(["a", "b", "a"],)], "w array<string>").select(X.word_ids(F.col("w"))).first()[0]
    assert ids[0] == ids[2] != ids[1] and all(4 <= i < 250_004 for i in ids)


def test_p_values(spark):
    df = spark.createDataFrame([(3.841459, 1), (12.591587, 6), (0.0, 3), (5.0, 0)], "chi2 double, dof long")
    p = [r.p for r in S.with_p_value(df).collect()]
    assert abs(p[0] - 0.05) < 1e-6 and abs(p[1] - 0.05) < 1e-6 and p[2] == 1.0 and p[3] == 1.0


def test_appended_rows(spark):
    df = spark.createDataFrame([(i, "en", int(i < 3), 0, i % 2) for i in range(20)] + [(50, None, 1, 1, 0)], "row_id long, lang string, threat int, identity_hate int, toxic int")
    out = G.appended_rare(df, ["threat", "identity_hate"], ["toxic"], 10)
    extra = out.where("draw is not null").collect()
    assert out.count() == 21 + 7 and {r.rare for r in extra} == {"threat"} and {r.row_id for r in extra} <= {0, 1, 2} and sorted(r.draw for r in extra) == list(range(1, 8))
    assert all(r.threat == 1 and 0 <= r.toxic <= 1 for r in extra) and any(r.toxic not in (0.0, 1.0) for r in extra)
    assert G.appended_rare(df.limit(0), ["threat"], ["toxic"], 10).count() == 0
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, comment_text string")
    both = G.sample_appended(texts, texts.where("row_id = 2"), 3, "comment_text", lambda c: F.concat(c, F.lit("!"))).collect()
    assert [r.comment_text for r in both if r.draw] == ["b!"] * 3 and len(both) == 5
    kept = G.sample_appended(texts, texts.where("row_id = 2"), 1, "comment_text", lambda c: F.lit(None).cast("string")).where("draw = 1").first()
    assert kept.comment_text == "b"  # a failed translation leaves the text
    assert G.sample_appended(texts, texts.limit(0), 3, "comment_text").count() == 2


def test_batches(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else None) for i in range(1000)], "row_id long, g string")
    b = G.batches(df, 32, "g")
    assert b.count() == 31 * 32 and b.select("batch", "place").distinct().count() == 31 * 32
    assert abs(b.where("g is null").count() / b.count() - 0.25) < 0.05
    assert G.batches(df.limit(5), 32, "g").count() == 32 and G.batches(df.limit(0), 32, "g").count() == 0


def test_names_of_runs(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = lambda df: df.first()[0]
    assert got(FS.latest_run(names("eval_20240101_1", "eval_20250101_1", "x", None))) == "eval_20250101_1" and got(FS.latest_run(names("x"))) is None
    assert got(FS.resolved_checkpoint(names("checkpoint_epoch9", "checkpoint_epoch10", "other"))) == "checkpoint_epoch10"
    assert got(FS.resolved_checkpoint(names("checkpoint_epoch9", "latest"))) == "latest" and got(FS.resolved_checkpoint(names("other"))) == "base"


def test_cards_and_logs(spark, tmp_path):
    for k, rows in enumerate(([("a", "en", 1), (None, "tr", 0)], [("c", None, None)])):
        FS.write_csv(spark.createDataFrame(rows, "comment_text string, lang string, toxic int").coalesce(1), f"{tmp_path}/in{k}")
    df = FS.read_csv(spark, f"{tmp_path}/in*", "comment_text string, lang string, toxic int")
    cards = {(r.file.rsplit("/", 2)[1], r.section, r.name): r.value for r in FS.cards(df, labels=LABELS).collect()}
    assert cards["in0", "rows", "rows"] == 2 and cards["in0", "nulls", "comment_text"] == 1 and cards["in0", "labels", "toxic"] == 1 and cards["in0", "languages", "tr"] == 1
    assert cards["in1", "rows", "rows"] == 1 and cards["in1", "nulls", "lang"] == 1 and ("in1", "languages", "en") not in cards
    log = spark.range(250).coalesce(1)
    FS.logged(log, f"{tmp_path}/log")
    FS.logged(log.limit(7), f"{tmp_path}/log")
    assert FS.read_log(spark, f"{tmp_path}/log", "id long").count() == 257
    import glob

    assert len(glob.glob(f"{tmp_path}/log/*.json")) == 4


def test_trees(spark):
    w = spark.createDataFrame([("en", "toxic", 0.5, 2.0, 7, 3, 2.1)], "lang string, label string, weight_0 double, weight_1 double, support_0 long, support_1 long, raw_weight_1 double")
    assert [tuple(r) for r in FS.weights_of_tree(FS.weights_tree(w)).collect()] == [tuple(w.first())]
    p = spark.createDataFrame([(1, 0, "toxic", 1, 0.5), (1, 0, "threat", 0, 0.25)], "row_id long, lang_id int, label string, y int, p double")
    m = FS.prediction_matrix(p, LABELS)
    assert m.first().p == [0.5, None, None, 0.25, None, None]
    assert {tuple(r) for r in FS.predictions_of_matrix(m, LABELS).collect()} == {tuple(r) for r in p.collect()}


def test_results(spark):
    r = N.predicted(spark, ["you idiot", "", None], ["en", None, None]).orderBy("row_id").collect()
    assert r[0].lang == "en" and r[1].lang == "en" and r[1].is_toxic is False and len(r) == 3 and set(r[0].probabilities) == set(LABELS)
    one = spark.createDataFrame([(0.1, 0.2), (0.3, 0.3), (None, 0.9), (None, None)], "a double, b double")
    assert [x[0] for x in one.select(N.top_category({"a": F.col("a"), "b": F.col("b")})).collect()] == ["toxic", "a", "b", "toxic"]
    t = spark.createDataFrame([("hello there",), ("привет",), (" ",), (None,)], "t string")
    assert [x[0] for x in t.select(A.in_language(F.col("t"), "en", N.detect_by_rules)).collect()] == [True, False, False, False]


def test_matrix_without_special_pieces(spark):
    df = spark.createDataFrame([(["<s>", "a", "b", "</s>"], [[float(10 * i + j) for j in range(4)] for i in range(4)]), (["<s>"], [[1.0]])], "p array<string>, m array<array<double>>")
    assert [r[0] for r in df.select(E.shown_matrix(F.col("p"), F.col("m"))).collect()] == [[[11.0, 12.0], [21.0, 22.0]], []]


def test_run_figures(spark):
    e = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "epoch int, s double")
    assert [(r.mean_seconds, r.eta_seconds) for r in V.remaining(e, "s", "epoch", 4).orderBy("epoch").collect()] == [(10.0, 30.0), (15.0, 30.0), (20.0, 20.0)]
    n = spark.createDataFrame([(1, "b", 3.0), (1, "a", 3.0), (1, "c", 1.0)], "step int, name string, norm double")
    assert tuple(S.norms(n, "step", "name", "norm").first()) == (1, 3.0, 1.0, round(7 / 3, 6), "a")
    f = spark.createDataFrame([(12345, 0.12345)], "n long, s double").select(L.thousands("n"), L.percent_text("s"), L.as_percent("s")).first()
    assert tuple(f) == ("12,345", "12.35%", 12.3)
    assert math.isclose(spark.range(1).select(L.sigmoid(F.lit(0.0))).first()[0], 0.5)


def test_saved_classifier(spark, tmp_path):
    rows = [("good fine nice", 0), ("good nice day", 0), ("bad awful day", 1), ("awful bad thing", 1)] * 3
    df = spark.createDataFrame(rows, "text string, label int")
    m = A.fit_classifier(df, "text", F.col("label"), features=50, iterations=20)
    A.save_model(m, f"{tmp_path}/model")
    A.save_model(m, f"{tmp_path}/model")
    a, b = ([r.probability_1 for r in A.probability(x, df, "text").collect()] for x in (m, A.load_model(f"{tmp_path}/model")))
    assert a == b and a[0] < 0.5 < a[2]


def test_language_by_stop_words(spark):
    df = spark.createDataFrame([("this is not what the rules say",), ("esto no es lo que dicen las reglas",), ("это не то что мы хотели",), ("zzz qqq",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(N.detect_by_stop_words(F.col("t"), X.stop_words(spark))).collect()]
    assert got == ["en", "es", "ru", None, None, None]


def test_hours_of_several_files_with_late_events(spark, tmp_path):
    from tessella.streaming.events import hourly

    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate(([(1, at(9, 0), 1.0), (1, at(9, 30), None)], [(1, at(20, 0), 5.0)], [(1, at(9, 45), 4.0), (2, at(9, 1), None)])):
        spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = {(r.user_id, r.hour.hour): (r.n, r["mean"]) for r in hourly(spark, str(tmp_path / "events" / "*.parquet")).collect()}
    assert got == {(1, 9): (3, 2.5), (1, 20): (1, 5.0), (2, 9): (1, None)}


def test_classifiers_without_terms(spark):
    df = spark.createDataFrame([(1, "...", 1), (2, None, 0), (3, "a", 1)], "row_id long, text string, toxic int")
    for rows in (df, df.limit(0)):
        features, models = A.fit_classifiers(rows, "text", ["toxic"])
        assert features is None and models == {"toxic": None}
        assert [r.toxic for r in A.probabilities(features, models, df, "text").collect()] == [None] * 3
