from __future__ import annotations

import random
from collections import Counter
from math import log, sqrt

from tessella.operators import neardup as N


def slow(a, b, train=None):
    x, y = (Counter(t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)) for t in (a, b))
    if train:
        different = set(train)
        rarity = {g: log((1 + len(different)) / (1 + sum(g in t for t in different))) + 1 for g in {*x, *y}}
        x, y = (Counter({g: v * rarity[g] for g, v in z.items()}) for z in (x, y))
    dot = sum(v * y[g] for g, v in x.items())
    return dot / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_cosine_and_recall(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    train = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 60))) for _ in range(150)]
    val = []
    for t in train:
        w = t.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        val.append(" ".join(w))
    for a, b in zip(train[:20], val[:20]):
        assert abs(N.cosine(N.profile(a), N.profile(b)) - slow(a, b)) < 1e-9
    assert N.cosine(N.profile(""), N.profile("abc")) == 0
    rows = [(i, "train", t) for i, t in enumerate(train)] + [(1000 + i, "val", t) for i, t in enumerate(val)] + [(5000, "val", None), (5001, "val", ""), (5002, "test", train[0])]
    df = spark.createDataFrame(rows, "row_id long, split string, comment_text string")
    weighted_want = {1000 + i for i, (a, b) in enumerate(zip(train, val)) if slow(a, b, train) >= 0.9}
    best = {r.row_id: r for r in N.leaking(df).collect()}
    assert set(best) <= {1000 + i for i in range(150)} and len(weighted_want & set(best)) >= 0.95 * len(weighted_want)
    for i in range(0, 150, 10):
        if 1000 + i in best and best[1000 + i].train_id == i:
            assert abs(best[1000 + i].cosine - slow(train[i], val[i], train)) < 5e-3  # n-grams that share a cell
    got = {r.row_id: r for r in N.leaking(df, idf=False).collect()}
    want = {1000 + i for i, (a, b) in enumerate(zip(train, val)) if slow(a, b) >= 0.9}
    assert set(got) <= {1000 + i for i in range(150)} and len(want & set(got)) >= 0.95 * len(want)
    assert all(r.cosine >= 0.9 for r in got.values())
