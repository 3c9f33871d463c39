from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import packing as P
from tessella.llm import proportions as Q
from tessella.llm import tokens as T
from tessella.llm import truncation as C

NAME = "byte_bpe_50k"
needs_files = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZERS}/{NAME}.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.model_of(NAME))


@pytest.fixture(scope="module")
def other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.ranks(f"{T.TOKENIZERS}/{NAME}.tiktoken"), special_tokens={})


@needs_files
@settings(deadline=None, max_examples=150)
@given(t=st.text(max_size=60))
def test_encoding_equals_another_library(encoder, other, t):
    ids = encoder.encode([t])[0]
    assert ids == other.encode_ordinary(t)
    assert encoder.decode(ids) == t


@needs_files
def test_encoded_table(spark, dirty, nothing, encoder, other):
    from tokenizers import Tokenizer

    third = Tokenizer.from_file(f"{T.TOKENIZERS}/{NAME}.json")
    third.encode_special_tokens = True
    rows = T.encoded(spark, dirty, key="row_id", text="comment_text").collect()
    texts = {r.row_id: r.comment_text for r in dirty.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.row_id]
        assert list(r.ids) == (other.encode_ordinary(t) if t else [])
        assert list(r.ids) == (third.encode(t, add_special_tokens=False).ids if t else [])
    assert T.encoded(spark, nothing, key="row_id", text="comment_text").count() == 0


def check(rows, sizes, capacity):
    used, cut = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
        assert 0 <= r.tokens <= r.container_size <= capacity
        cut.setdefault(r.k, []).append((r.start, r.tokens))
        assert used[r.container] <= r.container_size
    for k, n in sizes.items():
        parts = sorted(cut[k])
        assert sum(t for _, t in parts) == n and (len(parts) == 1 or n > capacity)
        at = 0
        for s, t in parts:
            assert s == at
            at += t
    return used


def test_packing(spark):
    rnd = random.Random(1)
    sizes = {i: rnd.choice([0, 1, 5, rnd.randint(1, 130), rnd.randint(100, 700)]) for i in range(900)}
    items = spark.createDataFrame([(k, "t", n) for k, n in sizes.items()], "k long, tokenizer string, tokens int").repartition(3)
    specs = spark.createDataFrame([(1, "t", 128), (2, "t", None), (3, "u", 64)], "spec_id int, tokenizer string, capacity int")
    out = P.packed(spark, items, specs, key="k", block_rows=400)
    rows = out.collect()
    assert {r.spec_id for r in rows} == {1}
    used = check(rows, sizes, 128)
    assert len(used) <= sum(sizes.values()) / 128 * 1.02 + 4
    f = P.fill(out).first()
    assert f.tokens == sum(sizes.values()) and f.used > 0.98
    both = P.fill(out, P.packed(spark, items, specs, key="k", block_rows=400, shares=(1.0,))).first()
    assert both.cost <= both.single_cost and both.sizes >= 1
    assert P.packed(spark, items.limit(0), specs, key="k").count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit(sizes):
    where, final = P.best_fit(sizes, 50)
    load = {}
    for s, w in zip(sizes, where):
        load[w] = load.get(w, 0) + s
    assert all(load.get(k, 0) <= c <= 50 for k, c in enumerate(final))
    allowed = P.permitted_sizes(50)
    for k, c in enumerate(final):
        assert c == min(a for a in allowed if a >= load.get(k, 0))


def cost(final, capacity):
    return sum(final) + P.OVERHEAD * capacity * len(final)


def test_two_sizes_beat_every_single_one():
    sizes = [70] * 100 + [45] * 100 + [30] * 30
    _, mixed = P.best_fit(sizes, 100, (1.0, 0.75))
    singles = []
    for c in (75, 100):
        _, opened, _ = P.placed(sizes, 100, [c])
        singles.append(cost(opened, 100))
    assert set(mixed) == {75, 100} and cost(mixed, 100) < min(singles)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_never_dearer_than_one_size(sizes):
    _, mixed = P.best_fit(sizes, 64)
    _, one = P.best_fit(sizes, 64, (1.0,))
    assert cost(mixed, 64) <= cost(one, 64) + 1e-6


def test_look_ahead_fills_from_the_histogram():
    left = {5: 2, 3: 1, 1: 0}
    assert P._filled(20, 6, left, (1 << 5) | (1 << 3)) == 19 and P._filled(6, 6, left, 1 << 5) == 6 and P._filled(9, 6, {}, 0) == 6


def test_proportions(spark):
    rows = [(i, "en" if i % 3 else "tr", int(i % 20 == 0), 0) for i in range(3000)] + [(9000 + i, None, 1, 0) for i in range(50)] + [(9900, "en", None, 0)]
    df = spark.createDataFrame(rows, "row_id long, lang string, threat int, identity_hate int")
    plans = [(1, "en", 0, 0, 0.5, 1, 1000), (1, "tr", 1, 0, 0.3, 400, 1000), (1, "xx", 0, 0, 0.2, 3, 1000), (2, "tr", 0, 0, 1.0, 0, 17), (2, None, 1, 0, 0.1, 5, 17), (3, "en", 1, 0, None, None, None)]
    targets = spark.createDataFrame(plans, "plan_id int, lang string, threat int, identity_hate int, share double, min_rows long, sample_rows long")
    cat = ["lang", "threat", "identity_hate"]
    rep = {(r.plan_id, r.lang, r.threat): r for r in Q.availability(df, targets, cat).collect()}
    n = {c: sum((r[1], r[2]) == c for r in rows) for c in (("en", 0), ("tr", 1), ("tr", 0))}
    assert rep[1, "en", 0].needed == 500 and rep[1, "en", 0].available == n["en", 0] and rep[1, "en", 0].deficit == 0
    assert rep[1, "tr", 1].deficit == 400 - n["tr", 1] and rep[1, "xx", 0].deficit == 200 and rep[2, None, 1].available == 0
    s = Q.sample(df, targets, cat)
    got = {(r.plan_id, r.lang, r.threat): r.n for r in s.groupBy("plan_id", "lang", "threat").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(1, "en", 0): 500, (1, "tr", 1): n["tr", 1], (2, "tr", 0): 17}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, Q.sample(df.repartition(7), targets, cat).collect()))
    assert s.dropDuplicates().count() == s.count()
    drawn = {(r.plan_id, r.lang, r.threat): (r.needed, r.sampled, r.deficit) for r in Q.report(df, targets, cat).collect()}
    assert drawn[1, "en", 0] == (500, 500, 0) and drawn[1, "tr", 1] == (400, n["tr", 1], 400 - n["tr", 1]) and drawn[1, "xx", 0] == (200, 0, 200) and drawn[2, None, 1] == (5, 0, 5) and drawn[3, "en", 1] == (0, 0, 0)
    assert Q.report(df.limit(0), targets, cat).where("sampled > 0").count() == 0
    assert Q.sample(df.limit(0), targets, cat).count() == 0 and Q.sample(df, targets.limit(0), cat).count() == 0


@pytest.mark.parametrize("text, found", [
    ("all is well.", ""), ("broken é�", "character"), ("see https://wiki", "link"), ("see https://wiki.example/Page?id=12", ""), ("an &am", "entity"), ("an &amp; b", ""),
    ("<b>bold</b> <i", "markup"), ("<b>x</b>", ""), ("a < b", ""), ("was here (as Fo", "bracket"), ("fine (really)", ""), ("smile :)", ""), ("sad :( but fine", ""), ("stops [...]", "mark"), ("stops […]", "mark"), ("cited [1]", ""),
    ("caf\\u00", "escape"), ("", ""), ("   ", ""), ("He said «this is not the end", "quote"), ('She wrote "we will not agree', "quote"), ("<b>bold never closed", "markup"), ("(he said «no» and then", "bracket"), ('he left (and said "no', "bracket"),
    ('he said "no" and left', ""), ('odd end"', ""), ("„so“ wird es", ""), ("He said «all is done.", ""), ("a <" + "x" * 300, "markup"), ("<br> fine", ""), ('5" wide', ""),
])
def test_open_at_end(text, found):
    assert C.open_at_end(text) == found


def test_truncated(spark):
    base = ["The old version was better before the change.", "You should check the history first!", "Nobody reads the rules of this project.", "The committee reads like a school essay."]
    rows = [(i, " ".join(base[(i + k) % 4] for k in range(1 + i % 3)), "a") for i in range(60)]
    cases = [(100, "You should check the history first! The commit", True), (101, "Nobody reads the rules of", True), (102, "The committee reads like a school essay", False), (103, None, False), (104, "  ", False), (105, "ok", False), (106, "Nobody reads the rules of this project...", False), (107, "You should check the hist…", True), (108, "The old version was better before the change. \U0001f600", False), (109, "The old version was better before the [...]", True)]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t, _ in cases] + [(110, "Nobody reads the rules of", None)], "doc_id long, text string, source string")
    j = {r.doc_id: r.cut for r in C.judged(df).collect()}
    assert {i: j[i] for i, _, _ in cases} == {i: c for i, _, c in cases}
    assert not any(j[i] for i in range(60)) and j[110]
    per = {r.source: r for r in C.by_source(C.judged(df)).collect()}
    assert per["a"].cut == 0 and per[""].documents == 11
    assert C.judged(df.limit(0)).count() == 0


def test_quotes_count_where_they_are_closed(spark):
    whole = [(i, 'They said "the change is fine" and left it' if s == "strict" else 'They said "the change is fine and left it', s) for s in ("strict", "loose") for i in range(20)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(whole)] + [(100, 'They wrote "the change is fine', "strict"), (101, 'They wrote "the change is fine', "loose")], "doc_id long, text string, source string")
    got = {r.doc_id: r.reason for r in C.judged(df).collect()}
    assert got[100] == "quote" and got[101] != "quote" and not any(got[i] == "quote" for i in range(20))


def test_facts_by_hand():
    f = C._facts(["The end. He saw Anna today.", None, "", "Stop here...", "he saw"])
    assert f["end"] == [1, 1, 0] and f["saw"] == [1, 0, 1] and f["saw <n>"] == [1, 0, 0] and f["today"] == [1, 1, 0] and f["<n> today"] == [1, 1, 0]
    assert f["stop"] == [1, 0, 0] and "here" not in f and f["he"] == [2, 0, 0]


def test_field_limit(spark):
    words = "The old version was better before the change in spring. You should check it first!".split(" ")
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(40)]
    rows = [(i, t[:100] if i % 2 else t[: 60 + 3 * i] + " in spring.", "sms") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = C.field_limits(C._read_texts(df, "doc_id", "text", "source").where("word is null")).collect()
    assert {(r.unit, r.size) for r in limits} >= {("chars", 100)}


def test_dirt(spark, dirty, nothing):
    df = dirty.withColumnRenamed("comment_text", "text").withColumnRenamed("row_id", "doc_id").withColumnRenamed("key", "source")
    assert C.judged(df).count() == df.count()
    n = T.lengths(spark, dirty, [NAME], "row_id", "comment_text") if os.path.exists(f"{T.TOKENIZERS}/{NAME}.tiktoken") else None
    if n is not None:
        assert n.where("tokens = 0").count() == 4 and n.count() == dirty.count()
