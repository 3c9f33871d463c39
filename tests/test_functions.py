from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import keys as K
from tessella.functions import labels as L
from tessella.functions import text as X
from tessella.functions.stemming import english, stem, stemmed
from tessella.operators import augmentation as A
from tessella.operators import inference as N
from tessella.schema import LABELS


def one(spark, text, f, **more):
    cols = {"t": text} | more
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(f(F.col("t"), *[F.col(c) for c in more]).alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("Éàç İstanbul x  привет ё straße", "Éàç İstanbul x привет ё straße"),
    ("http://a.b<c> tail", "tail"),
    ("don't...!! ok ,yes", "don t.! ok,yes"),
    ("<p>a &amp; b</p><script>x()</script>", "a b"),
    ("", ""), ("   ", ""), (None, ""),
])
def test_clean_text(spark, text, want):
    assert one(spark, text, X.clean_text) == want


@pytest.mark.parametrize("text, lang, want", [
    ("Mail me: a@b.example or @you #tag 123 http://x.y ok", "en", "mail"),
    ("I can't, you're", "en", "cannot you are"),
    ("Привет ёж мир", "ru", "привет мир"),
    ("Çok GÜZEL iş", "tr", "çok güzel"),
    (None, "en", ""), ("  ", "fr", ""), ("word here", None, "word here"),
])
def test_preprocess(spark, text, lang, want):
    got = one(spark, text, lambda c, x: X.preprocess(c, x), lang=lang)
    assert got == want.replace(" me", "")


def test_hash_equals_python(spark):
    for t in ("A  b", " a b ", "Ünï\tcode", ""):
        assert one(spark, t, K.text_hash) == hashlib.sha256(" ".join(t.lower().split()).encode()).hexdigest()
    assert one(spark, None, K.text_hash) == hashlib.sha256(b"").hexdigest()


def test_ids(spark):
    rows = [(1, "en", "a", 1), (2, "en", "a", 1), (3, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, lang string, t string, v int").withColumns({x: F.col("v") for x in LABELS})
    ids = df.select("row_id", K.comment_id(F.col("lang"), F.col("t")).alias("i"))
    got = [r.i for r in K.unique_ids(ids, "i", "row_id").orderBy("row_id").collect()]
    md5 = hashlib.md5(b"a").hexdigest()[:6]
    assert got[0] == f"0_en_111111_{md5}" and got[1] == f"1_en_111111_{md5}" and got[2].startswith("0__000000_")
    single = [r.i for r in K.unique_ids(ids.where("row_id > 1"), "i", "row_id").collect()]
    assert not any(x.startswith("0_en") for x in single)


def test_binarised(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.1667, 1.0, None)], "toxic double")
    assert [r.toxic for r in L.binarised(df, ["toxic"]).collect()] == [0, 1, 1, 1, None]


def test_languages(spark):
    df = spark.createDataFrame([("en",), ("PT",), ("de",), (None,), ("Turkish",)], "x string")
    assert [r[0] for r in df.select(L.lang_id("x")).collect()] == [0, 6, 0, 0, 0]
    assert [r[0] for r in df.select(L.lang_id_of_name("x")).collect()] == [0, 6, 0, 0, 2]
    assert one(spark, "flag French", N.code_of_name) == "fr" and one(spark, "x", N.code_of_name) == "en"
    ids = spark.createDataFrame([(i,) for i in (0, 9, 3, -1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2)], "lang_id int")
    assert [r[0] for r in L.clamped_lang_ids(ids).collect()][:4] == [0, 6, 3, 0]
    assert {r[0] for r in L.clamped_lang_ids(ids.limit(4)).collect()} == {0}


def test_rules(spark):
    assert one(spark, "!!!", N.detect_by_rules) == "en"
    assert one(spark, "plain words", N.detect_by_rules) == "en"
    assert one(spark, "Привет, мир", N.detect_by_rules) == "ru"
    assert one(spark, "ığş işte", N.detect_by_rules) == "tr"
    assert one(spark, "x", lambda c, d: N.detect_by_rules(c, d), d="fr") == "fr"


def test_markup():
    assert X.markup_text("<p>a &lt; b<style>q{}</style></p>") == "a < b"
    assert X.markup_text("plain") == "plain"


def test_stems():
    assert [english(w) for w in ("cats", "ponies", "hopping", "relational", "agreed", "is")] == ["cat", "poni", "hop", "relat", "agre", "is"]
    assert stem("casas", "es") == "cas" and stem("word", None) == "word"


# Words and stems of the published sample vocabularies.
SAMPLES = {
    "en": "consign consign consigned consign consigning consign consignment consign consistency consist consistent consist consistently consist consolation consol consolatory consolatori console consol knackeries knackeri knave knave knaves knave kneaded knead knees knee knife knife knightly knight knitted knit knitting knit knives knive knocker knocker generously generous dying die news news skies sky cries cri ties tie gas gas this this kiwis kiwi hopping hop hoping hope national nation relational relat happy happi saying say by by say say communication communic university univers",
    "ru": "в в вавиловка вавиловк вагнера вагнер вагонов вагон вагоном вагон важная важн важнее важн важнейшие важн важничал важнича важности важност важностью важност важный важн вазах ваз валандался валанда валериановых валерианов валетами валет павел павел павильонам павильон павлиньим павлин павловной павловн падает пада падал пада падаль падал падающего пада падение паден падет падет падучая падуч падчерицей падчериц падших падш",
    "es": "cheque chequ chequeo cheque cheques chequ chesca chesc chetumaleños chetumaleñ chía chi chiapaneca chiapanec chica chic chicharrones chicharron torá tor tórax torax torcer torc toreado tor toreándolo tor torear tor toreó tore torero torer tormentas torment tornado torn torneo torne tornillos tornill torniquete torniquet torpedearon torped torpeza torpez torrenciales torrencial torreón torreon torrescano torrescan",
    "fr": "continu continu continuait continu continuation continu continué continu continuelle continuel continuellement continuel continueront continu continuité continu contorsions contors contournait contourn contractions contract contradictoirement contradictoir contraindre contraindr contraires contrair contraria contrari mains main maintenaient mainten maintenue maintenu maires mair mairie mair maïs maï maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeure majeur majordomes majordom majorité major",
    "it": "abbandonata abbandon abbandonerà abbandon abbandono abband abbaruffato abbaruff abbassamento abbass abbassandola abbass abbassarsi abbass abbassassero abbass abbastanza abbast abbatté abbatt abbattere abbatt abbattesse abbattess abbattimento abbatt abbattuta abbatt abbellita abbell abbenché abbenc pronto pront pronuncerà pronunc pronunciamento pronunc pronunziano pronunz propaganda propagand propagazione propag propende prop propensione propension propone propon",
    "pt": "boa boa bôas bôas boataria boat boates boat bobagem bobag bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bocadas boc bocado boc bocarra bocarr bodoque bodoqu boemia boem boêmios boêmi boiando boi quiabo quiab quicaram quic quietos quiet quilates quilat quilométricas quilométr quilômetro quilômetr",
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_published_stems(lang):
    w = SAMPLES[lang].split()
    assert {a: stem(a, lang) for a in w[::2]} == dict(zip(w[::2], w[1::2]))


def test_stems_of_odd_words(spark):
    for lang in ("en", "ru", "es", "fr", "it", "pt", "tr", "xx", None):
        for w in ("", "a", "y", "'", "ё", "ж", "s", "ss", "qu", "é", "ь", "123", "a" * 5000, "ı", "x" * 5000 + "ing"):
            assert isinstance(stem(w, lang), str)
    df = spark.createDataFrame([(["running", ""], "en"), (None, "ru"), (["дома"], "ru"), (["evlerden"], "tr")], "w array<string>, l string")
    assert [r[0] for r in df.select(stemmed(F.col("w"), F.col("l"))).collect()] == [["run", ""], None, ["дом"], ["evler"]]


def test_generated(spark):
    t = '<s>[INST] q [/INST] "hello you there"</s> rest'
    assert one(spark, t, A.response) == "hello you there"
    df = spark.createDataFrame([("one two",), ("one two three",), ("for example this one",), (None,), (" ".join("w" * 51),)], "t string")
    assert [r[0] for r in df.select(A.acceptable(F.col("t"))).collect()] == [False, True, False, False, False]


def test_titles_and_percent(spark):
    assert one(spark, "severe_toxic", L.title) == "Severe Toxic"
    assert spark.range(1).select(L.as_percent(F.lit(0.1234))).first()[0] == 12.3
    assert one(spark, "x" * 120, X.preview) == "x" * 100 + "..."
