from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language as L

TEXTS = {
    "en": ["the committee reads like a school essay and the picture was removed", "you should check the history first because nobody cares about this", "this is a very bad page and you never read the rules of the project", "the old version was better before the change in the first chapter"],
    "es": ["el comité parece una redacción escolar y la imagen fue eliminada", "deberías mirar el historial primero porque a nadie le importa esto", "esta es una página muy mala y nunca lees las normas del proyecto", "la versión antigua era mejor antes del cambio en el primer capítulo"],
    "fr": ["le comité se lit comme une rédaction et la photo a été supprimée", "tu devrais d'abord vérifier l'historique parce que personne ne regarde", "cette page est très mauvaise et tu ne lis jamais les règles du projet", "l'ancienne version était bien avant le changement dans le premier chapitre"],
    "ru": ["комитет напоминает школьное сочинение и картинка была удалена", "вам стоит сначала проверить историю потому что всем всё равно", "это очень плохая страница и вы никогда не читаете правила проекта", "старая версия была лучше до правки в первой главе"],
    "tr": ["kurul okul ödevi gibi okunuyor ve resim kaldırıldı bu yüzden", "önce geçmişe bakman lazım çünkü kimse bununla ilgilenmiyor", "bu çok kötü bir sayfa ve projenin kurallarını hiç okumuyorsun", "eski sürüm ilk bölümdeki değişiklikten önce daha iyiydi"],
}


@pytest.fixture(scope="module")
def model():
    return L.fit([(x, ". ".join(t[i:] + t[:i])) for x, t in TEXTS.items() for i in range(4)])


def run(spark, model, texts, langs=None):
    df = spark.createDataFrame([(i, t, (langs or {}).get(i)) for i, t in enumerate(texts)], "row_id long, comment_text string, lang string")
    return df, L.segments(spark, df, model)


def test_languages_and_segments(spark, model):
    df, s = run(spark, model, ["you never read the rules of this project", "вы никогда не читаете правила. you never read the rules of the page!", None, "  ", "...", "vy nikogda ne chitaete pravila proekta"])
    got = {}
    for r in s.orderBy("row_id", "segment").collect():
        got.setdefault(r.row_id, []).append((r.language, r.confidence))
    assert [x for x, _ in got[0]] == ["en"] and [x for x, _ in got[1]] == ["ru", "en"] and [x for x, _ in got[5]] == ["ru"]
    assert got[2] == got[3] == got[4] == [(None, None)]
    assert all(0 < c <= 1 for k in (0, 1, 5) for _, c in got[k])


def test_family_first():
    m = L.Model({}, np.zeros((0, 0), np.float32), np.zeros(0, np.float32), list(L.LANGUAGES))
    out = np.full((1, len(m.families) + len(m.pairs)), -1.0, np.float32)
    out[0, m.families.index("Slavic")], out[0, m.families.index("Romance")] = 0.9, 0.3
    for k, (a, b) in enumerate(m.pairs):
        out[0, len(m.families) + k] = 2.0 if a == "es" else -2.0 if b == "es" else 0.0
    s = m.scores(out)[0]
    assert m.languages[s.argmax()] == "ru"
    out[0, m.families.index("Romance")] = 1.0
    s = m.scores(out)[0]
    assert m.languages[s.argmax()] == "es" and abs(s.max() - 1.0) < 1e-6 and abs(m.confidence(s[None]).sum() - 1) < 1e-6


def test_switch_within_a_sentence(spark, model):
    t = f"{TEXTS['en'][1]} {TEXTS['ru'][3]}"
    _, s = run(spark, model, [t, TEXTS["en"][1] + " and also " + TEXTS["en"][2]])
    got = {}
    for r in s.orderBy("row_id", "segment").collect():
        got.setdefault(r.row_id, []).append((r.language, r.words, r.longest))
    assert [x[0] for x in got[0]] == ["en", "ru"] and sum(x[1] for x in got[0]) == len(t.split()) and [x[2] for x in got[0]] == [0, 0]
    assert [x[0] for x in got[1]] == ["en"]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, TEXTS["en"][0], None), (2, None, "en")], "row_id long, comment_text string, lang string")
    s = L.segments(spark, df, L.fitted(L.labelled_sample(df)))
    assert [(r.language, r.confidence) for r in s.collect()] == [(None, None)] * 2 and L.mislabelled(df, s).count() == 0
    assert L.mislabelled(df.limit(0), L.segments(spark, df.limit(0), None)).count() == 0


def test_mislabelled(spark, model):
    en, es = TEXTS["en"][1], TEXTS["es"][1]
    texts = [en, en, en, en, en, f"{en}. {es}", "hola", en + ". a la page", None]
    df, s = run(spark, model, texts, {0: "en", 1: "EN-US", 2: " en ", 3: "fr", 4: None, 5: "en", 6: "en", 7: "en", 8: "en"})
    got = {(r.row_id, r.true_lang) for r in L.mislabelled(df, s).collect()}
    assert got == {(3, "en"), (4, "en"), (5, "en"), (5, "es")}


def test_held_out(spark):
    train = [(x, ". ".join(t[:3])) for x, t in TEXTS.items() for _ in range(3)]
    m = L.fit(train)
    df, s = run(spark, m, [t[3] for t in TEXTS.values()])
    right = sum(r.language == list(TEXTS)[r.row_id] for r in s.collect())
    assert right >= 4


def test_codes(spark):
    df = spark.createDataFrame([("en",), ("PT-BR",), (" tr ",), ("tr_TR",), ("",), ("??",), (None,), ("unknown",)], "x string")
    assert [r[0] for r in df.select(L.base_code(F.col("x"))).collect()] == ["en", "pt", "tr", "tr", "", "", None, ""]


def test_dirt(spark, dirty, nothing, model):
    assert L.segments(spark, nothing, model).count() == 0
    s = L.segments(spark, dirty, model)
    assert s.select("row_id").distinct().count() == dirty.count()
    assert L.mislabelled(dirty.withColumn("lang", F.lit(None).cast("string")), s).where("row_id = 1").count() == 0
    assert L.labelled_sample(nothing.withColumn("lang", F.lit("en"))) == []
    with pytest.raises(ValueError):
        L.fit([])
