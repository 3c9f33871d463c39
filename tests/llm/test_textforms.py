from __future__ import annotations

import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import lookalikes as LK
from tessella.llm.lookalikes import look_pairs, normalised
from tessella.llm.textforms import _PROTOTYPE, skeleton, words


def test_equal_looks():
    for a, b in (("full width", "ｆｕｌｌ　ｗｉｄｔｈ"), ("café", "café"), ("site", "sit​e"), ("a b", "a b"), ("scope", "ѕсоре"), ("ё", "ë"), ("ОК", "OK"), ("soft", "so­ft"), ("pkuy", "ρκυү"), ("lWC", "ӏԜϹ"), ("fine flag", "ﬁne ﬂag"), ("Bold 9", "𝐁𝐨𝐥𝐝 𝟗"), ("group", "ɡroup"), ("óíú", "όίύ"), ("ℎ", "h"), ("ⅷ", "viii"), ("o", "ᴏ"), ("𝛂", "a")):
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in (("a", "A"), ("e", "é"), ("a.", "a"), ("a  b", "a b"), ("a\tb", "a b"), ("...", "…"), ("a\nb", "a b"), ("ı", "i"), ("к", "k"), ("и", "u"), ("½", "1/2")):
        assert skeleton(a) != skeleton(b), (a, b)


@given(st.text(alphabet=st.sampled_from("aeоёеà́̈ＡA ​ .ıİйи"), max_size=12))
def test_skeleton_is_decompose_replace_decompose(t):
    d = unicodedata.normalize("NFD", t.translate(_PROTOTYPE))
    want = unicodedata.normalize("NFD", d.translate(_PROTOTYPE))
    assert unicodedata.normalize("NFD", skeleton(t)) == want
    assert skeleton(skeleton(t)) == skeleton(t)


def test_words():
    assert words("Саrаѕауеr, а тесты мы") == ["carasayer", "а", "тесты", "мы"]
    assert words("ВOOK is а bооk") == ["book", "is", "a", "book"]
    assert words("İstanbul'da 2024_x") == ["istanbul", "da", "2024", "x"]
    assert words("ｆｕｌｌ wi­dth café") == ["full", "width", "café"]
    assert words("КАК ДЕЛА") == ["как", "дела"]
    assert words("") == words("!? ...") == []


def test_pairs_against_brute_force(spark):
    texts = ["abc", "аbc", "abc", "a​bc", None, "", "...", "…", "é1", "é1", "Abc", " abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, comment_text string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and any(c.isalnum() for c in a) and a != b and skeleton(a) == skeleton(b)}
    got = [tuple(r) for r in look_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_large_looks_and_classes(spark, monkeypatch):
    monkeypatch.setattr(LK, "_BLOCK", 4)
    texts = ["abc", "аbc"] * 9 + ["аbс", "x", "x", None, "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, comment_text string")
    got = [tuple(r) for r in look_pairs(df).collect()]
    want = {(i, j) for i in range(19) for j in range(i + 1, 19) if texts[i] != texts[j]}
    assert len(got) == len(want) and set(got) == want
    classes = {r.row_id: tuple(r)[1:] for r in LK.look_classes(df).collect()}
    assert classes[18] == (0, 19, 3) and classes[20] == (19, 2, 1) and classes[21] == (21, 1, 1) and classes[22] == (22, 1, 1) and len(classes) == 23


def test_dirt(spark, dirty, nothing):
    assert look_pairs(dirty).count() == 0 and look_pairs(nothing).count() == 0
    out = normalised(dirty)
    assert out.count() == dirty.count() and out.columns == [*dirty.columns, "look"]
    assert out.where("comment_text is null and look is not null").count() == 0
