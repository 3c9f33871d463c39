from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import overlaps as O
from tessella.llm import similar as S
from tessella.llm.textforms import words


def corpus(n=240, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"name{i}" for i in range(200)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = list(rnd.choice(out))
            for _ in range(rnd.randint(0, 5)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] if rnd.random() < 0.7 else []
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = w[k:] + w[:k]
        else:
            w = [rnd.choice(vocabulary[:60] if rnd.random() < 0.85 else vocabulary) for _ in range(rnd.randint(8, 50))]
        out.append(w)
    return [" ".join(w) for w in out]


def brute(texts, least=12):
    sets = [set(words(t)) if t else set() for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if min(len(sets[i]), len(sets[j])) >= least and S.overlap(sets[i], sets[j]) >= 0.8 - 1e-12}


def test_similar_against_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, comment_text string").repartition(5)
    want = brute(texts)
    for short in (50, 5, 0):  # few long lists, many, all
        monkeypatch.setattr(S, "SHORT", short or 1)
        got = [tuple(r) for r in S.expanded(*S.similar(spark, df)).collect()]
        assert set(got) == want and len(got) == len(want)
    assert len(want) > 30


def test_every_similar_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for trial in range(400):
        n = int(rng.integers(12, 160))
        a = rng.choice(10_000, n, replace=False)
        b = a.copy()
        while True:
            c = b.copy()
            c[rng.integers(len(c))] = rng.integers(10_000, 20_000)
            if rng.random() < 0.4:
                c = c[1:]
            if S.overlap(set(a.tolist()), set(c.tolist())) < 0.8:
                break
            b = c
        a, b = (np.unique(S._mix(np.unique(x).astype(np.uint64)) >> np.uint64(64 - S.HASH_BITS)) for x in (a, b))
        every = np.unique(np.r_[a, b])
        frequent = every[rng.random(len(every)) < rng.choice([0.0, 0.3, 0.9, 1.0])]
        long = S.Long((frequent >> np.uint64(S.HASH_BITS - S.SLOT_BITS)).astype(np.int64), rng.integers(1, 256, len(frequent)).astype(np.uint8))
        rows, keys, sketch = S.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), np.array([len(a), len(b)]), long, 0.8)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
        differ = sum(int(np.bitwise_count(s[0] ^ s[1])) for s in sketch)
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_occurrences_are_those_of_sets():
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(5000)] for _ in range(2))
    lists = [S.sorted_lists(np.concatenate(x).astype(np.uint64), [len(y) for y in x]) for x in (a, b)]
    both, na, nb = S.occurrences(*lists)
    assert both.tolist() == [len(set(x.tolist()) & set(y.tolist())) for x, y in zip(a, b)]
    assert na.tolist() == [len(x) for x in a] and nb.tolist() == [len(x) for x in b]


def test_blocks_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 7)
    members = spark.createDataFrame([(i, 0) for i in range(40)] + [(i, 40) for i in range(40, 61)] + [(70, 70)], "id long, rep long")
    links = spark.createDataFrame([(0, 40), (40, 70)], "a long, b long")
    got = [tuple(r) for r in S.expanded(members, links).collect()]
    want = {(i, j) for i in range(40) for j in range(i + 1, 61)} | {(i, j) for i in range(40, 61) for j in range(i + 1, 61)} | {(i, 70) for i in range(40, 61)}
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_stay_one_class(spark):
    t = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i in range(30)] + [(99, t + " more"), (100, None), (101, "few words")], "row_id long, comment_text string")
    members, links = S.similar(spark, df)
    assert links.count() == 1 and members.select("rep").distinct().count() == 2
    g = {r.row_id: r for r in S.groups(df, members, links).collect()}
    assert g[3].class_id == 0 and g[3].members == 30 and g[3].links == 1 and g[99].members == 1
    assert g[100] == (100, 100, 1, 0) and g[101].class_id == 101 and len(g) == 33
    assert S.expanded(members, links).count() == 30 * 29 // 2 + 30


def test_overlaps_against_brute_force(spark):
    texts = corpus(300, 8) + ["short one", "Short, one!", "one short", "", None, "...", "solo"]
    rnd = random.Random(2)
    split = [rnd.choice(["train", "train", "val", "test", None]) for _ in texts]
    split[300], split[301], split[302] = "train", "val", "test"
    df = spark.createDataFrame([(i, t, s, "src") for i, (t, s) in enumerate(zip(texts, split))], "row_id long, comment_text string, split string, source string").repartition(4)
    near = brute(texts)
    seq = {tuple(words(t)) for t, s in zip(texts, split) if t and s == "train" and words(t)}
    want = {i for i, (t, s) in enumerate(zip(texts, split)) if s in ("val", "test") and t and tuple(words(t)) in seq}
    want |= {x for a, b in near for x, y in ((a, b), (b, a)) if split[x] in ("val", "test") and split[y] == "train"}
    o = O.overlaps(spark, df)
    got = [r.row_id for r in o.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 301 in got and 302 not in got
    rep = O.report(df, o).collect()
    assert sum(r.records for r in rep) == sum(s in ("val", "test") for s in split) and sum(r.exact + r.near for r in rep) == len(got)


def test_overlaps_of_frequent_words_only(spark):
    vocabulary = [f"w{i}" for i in range(33)]
    a = vocabulary[:30]
    b = list(a)
    b[7], b[15], b[23] = vocabulary[30:]  # similarity 27/33, clean stretches of 7 words at most
    rows = [(k * 60 + i, " ".join(vocabulary[k * 9 : k * 9 + 9]), "train") for k in range(4) for i in range(60)]  # makes all words frequent
    rows += [(900, " ".join(a), "train"), (901, " ".join(b), "val")]
    got = O.overlaps(spark, spark.createDataFrame(rows, "row_id long, comment_text string, split string")).collect()
    assert [(r.row_id, r.train_id, r.exact) for r in got] == [(901, 900, False)]
    assert abs(got[0].similarity - 27 / 33) < 1e-12 and got[0].coverage == 0.9


def test_overlaps_of_a_hot_template(spark):
    template = " ".join(f"w{i}" for i in range(16))  # 16 of 20 words shared, the rest differ
    rows = [(i, f"{template} a{i} b{i}", "val") for i in range(230)] + [(900 + i, f"{template} c{i} d{i}", "train") for i in range(3)]
    got = O.overlaps(spark, spark.createDataFrame(rows, "row_id long, comment_text string, split string")).collect()
    assert sorted(r.row_id for r in got) == list(range(230)) and {r.train_id for r in got} == {900}


def test_all_partners_of_an_overlap(spark):
    t = " ".join(f"w{i}" for i in range(15))
    rows = [(1, t, "train"), (2, t.upper(), "train"), (3, t + " more", "train"), (4, t + " most", "train"), (5, t, "val"), (6, t + " other", "test"), (7, t, "test")]
    df = spark.createDataFrame(rows, "row_id long, comment_text string, split string")
    members, links = O.linked(spark, df)
    assert {(r.e, r.t, r.exact) for r in links.collect()} == {(5, 1, True), (5, 3, False), (5, 4, False), (6, 1, False), (6, 3, False), (6, 4, False)}
    assert {(r.id, r.rep) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 5)}
    got = {r.row_id: (r.train_id, r.exact, r.exact_partners, r.near_partners) for r in O.overlaps(spark, df).collect()}
    assert got == {5: (1, True, 2, 2), 7: (1, True, 2, 2), 6: (1, False, 0, 4)}
    assert sorted(r.row_id for r in O.found(spark, df).collect()) == [5, 6, 7]


def test_no_overlap_is_lost(spark, monkeypatch):
    for seed, least in ((8, 50), (21, 5)):  # few frequent words, then many
        monkeypatch.setattr(S, "SHORT", least)
        texts = corpus(300, seed)
        rnd = random.Random(seed)
        split = [rnd.choice(["train", "train", "val", "test"]) for _ in texts]
        seq = {tuple(words(t)) for t, s in zip(texts, split) if s == "train"}
        want = {i for i, (t, s) in enumerate(zip(texts, split)) if s != "train" and tuple(words(t)) in seq}
        want |= {x for a, b in brute(texts) for x, y in ((a, b), (b, a)) if split[x] != "train" and split[y] == "train"}
        df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, split))], "row_id long, comment_text string, split string").repartition(4)
        assert {r.row_id for r in O.overlaps(spark, df).collect()} == want


def test_chain_and_coverage():
    assert O.chained([(0, 5), (1, 6), (2, 1), (3, 8)]) == [(0, 5), (1, 6), (3, 8)]
    assert O.chained([]) == []
    a = "a b c d e f".split()
    assert O.coverage(a, "x a b c y d e f".split(), [(0, 1), (4, 6)]) == 1.0
    assert O.coverage(a, "a b q r s t".split(), [(0, 0)]) == 2 / 6


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(40):
        run = rng.integers(0, 1000, O.RUN + O.WINDOW - 1)
        texts = [np.r_[rng.integers(1000, 2000, rng.integers(0, 9)), run, rng.integers(2000, 3000, rng.integers(0, 9))].astype(np.uint64) for _ in range(2)]
        prints = [set(O.fingerprints(t, np.array([0, len(t)]))[1].tolist()) for t in texts]
        assert prints[0] & prints[1]


def test_sources_of_both_sides(spark):
    t = " ".join(f"w{i}" for i in range(15))
    rows = [(1, t, "train", "A"), (2, t, "train", "B"), (3, t + " more", "train", None), (5, t, "val", "C"), (6, t + " other", "test", "C"), (7, t, "val", "C"), (8, "else", "val", "C")]
    df = spark.createDataFrame(rows, "row_id long, comment_text string, split string, source string")
    got = {tuple(r) for r in O.by_sources(df, *O.linked(spark, df)).collect()}
    assert got == {("val", "C", "A", 2, 2, 0), ("val", "C", "B", 2, 2, 0), ("val", "C", None, 2, 0, 2), ("test", "C", "A", 1, 0, 1), ("test", "C", "B", 1, 0, 1), ("test", "C", None, 1, 0, 1)}


def test_dirt(spark, dirty, nothing):
    members, links = S.similar(spark, dirty)
    assert members.count() == 0 and links.count() == 0 and S.expanded(members, links).count() == 0
    assert S.groups(nothing, *S.similar(spark, nothing)).count() == 0
    o = O.overlaps(spark, dirty)
    assert o.count() == 0 or o.columns[0] == "row_id"
    assert O.overlaps(spark, nothing).count() == 0
    assert O.report(nothing.withColumn("source", F.lit("x")), O.overlaps(spark, nothing)).count() == 0
