"""Problem 5: the same or nearly the same records across splits.

Winnowing: of each record's rolling hashes over runs of five words, the minima
of sliding windows are selected as fingerprints, and evaluation records are
joined with training records on them.  Fingerprints that stand in many
evaluation records (phrases of the house) are left out of the join, and a pair may share no run of
words at all (its words reordered, or edits all over); for these the exact way
is problem 2's search: the lists of `similar.signatures` go into the same join,
and every pair that reaches the threshold shares one of those.  What the join
brings together is read and compared exactly, its equal fingerprints are the
seeds, collinear seeds are chained and extended to an alignment, and coverage
is reported per record, split and source.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import keep
from .similar import _ODD, HASH_BITS, WordHashes, _mix, keyed, list_partitions, long_lists, met, only, overlap, sorted_lists
from .textforms import words

RUN, WINDOW = 5, 16
SEED_RUN = 3  # words of a seed where two records share no fingerprint
#: A fingerprint that two texts repeat so often (product of both numbers) seeds them in order only.
_REPEATS = 256
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_runs(df: DataFrame, key: str, text: str, split: str, train: str, evaluation: list[str], least: int) -> DataFrame:
    """Rows with a word: `id`, `side` (0 train, 1 evaluation), `n` distinct words, `lo`, `hi` (hash of the sequence), and for rows of `least` distinct words `tokens` (their sorted hashes) and `prints` (the fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, side, n, held, lens, flat, distinct = [], [], [], [], [], [], []
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t and (w := words(t)):
                    ids.append(i)
                    side.append(int(s != train))
                    h = hashes(w)
                    own = set(h)
                    n.append(len(own))
                    lens.append(len(w))
                    flat += h
                    if len(own) < least:
                        own = ()
                    held.append(len(own))
                    distinct += own
            h = np.array(flat, np.uint64)
            starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            place = _mix(np.arange(len(h), dtype=np.uint64) - np.repeat(starts[:-1], lens).astype(np.uint64) + _ODD)
            lo = np.add.reduceat(_mix(h ^ place), starts[:-1]) if ids else h
            hi = np.add.reduceat(_mix(h + place), starts[:-1]) if ids else h
            pos, prints = fingerprints(h, starts)
            owner = np.searchsorted(starts, pos, "right") - 1
            used = np.array(held, np.int64)[owner] > 0 if len(pos) else np.zeros(0, bool)
            owner, prints = owner[used], prints[used] >> np.uint64(64 - HASH_BITS)
            once = np.lexsort((prints, owner))
            owner, prints = owner[once], prints[once]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1])] if len(owner) else np.zeros(0, bool)
            per = np.bincount(owner[new], minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(side, pa.int32()), pa.array(n, pa.int32()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), sorted_lists(np.array(distinct, np.uint64), held), sorted_lists(prints[new], per.tolist())],
                ["id", "side", "n", "lo", "hi", "tokens", "prints"],
            )

    rows = df.where(F.col(split).isin(train, *evaluation)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.col(split).alias("s"))
    return rows.mapInArrow(run, "id long, side int, n int, lo long, hi long, tokens array<long>, prints array<long>")


def _minima(v: np.ndarray, room: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which values are the least of some window of `window` values within their record.

    `room` is the number of values from a position to the end of its record,
    `first` whether a position starts a record.
    """
    low = v.copy()
    for k in range(1, window):
        ok = np.flatnonzero(room > k)
        low[ok] = np.minimum(low[ok], v[ok + k])
    # a window starts where it fits, or at the start of a record shorter than it
    starts = (room >= window) | first
    sel = starts & (low == v)
    for k in range(1, window):
        i = np.flatnonzero(starts & (room > k))
        hit = i[low[i] == v[i + k]]
        sel[hit + k] = True
    return sel


def fingerprints(tokens: np.ndarray, starts: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected fingerprints of records laid end to end.  Two records share one if they share run + window - 1 words in a row."""
    lens = np.diff(starts)
    room = np.repeat(starts[1:], lens) - np.arange(len(tokens)) - (run - 1)  # runs from here to the end of the record
    first = np.zeros(len(tokens), bool)
    first[starts[:-1][lens > 0]] = True
    h = _mix(tokens + _ODD)
    roll = np.zeros(len(tokens), np.uint64)
    good = room > 0
    i = np.flatnonzero(good)
    for k in range(run):
        roll[i] = roll[i] * np.uint64(0x100000001B3) + h[i + k]
    v = np.where(good, _mix(roll + np.uint64(run)), _MAX)
    pos = np.flatnonzero(_minima(v, room, first, window) & good)
    return pos, v[pos]


def chained(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds that advance in both records."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for k, (_, y) in enumerate(seeds):
        j = bisect_left(tails, y)
        if j == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[j] = y
            ends[j] = k
        back[k] = ends[j - 1] if j else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def coverage(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> float:
    """Share of the words of `a` that lie in runs equal in `b`, each chained seed extended both ways."""
    covered = bytearray(len(a))
    for x, y in chained(seeds):
        if x >= len(a) or y >= len(b) or a[x] != b[y]:
            continue
        i, j = x, y
        while i >= 0 and j >= 0 and a[i] == b[j] and not covered[i]:
            covered[i] = 1
            i, j = i - 1, j - 1
        i, j = x + 1, y + 1
        while i < len(a) and j < len(b) and a[i] == b[j] and not covered[i]:
            covered[i] = 1
            i, j = i + 1, j + 1
    return sum(covered) / max(1, len(a))


def winnowed(texts: list[list[str]], hashes: WordHashes) -> list[dict[int, list[int]]]:
    """Of each list of words its fingerprints and where they start."""
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    pos, keys = fingerprints(np.array([h for w in texts for h in hashes(w)], np.uint64), starts)
    own = np.searchsorted(starts, pos, "right") - 1
    for o, p, k in zip(own.tolist(), (pos - starts[own]).tolist(), keys.tolist()):
        out[o].setdefault(k, []).append(p)
    return out


def every_run(w: list[str]) -> dict[int, list[int]]:
    """As `winnowed` of one text, with nothing left out: all its short runs."""
    out: dict[int, list[int]] = {}
    for i in range(len(w) - SEED_RUN + 1):
        out.setdefault(hash(tuple(w[i : i + SEED_RUN])), []).append(i)
    return out


def seeds_of(a: dict[int, list[int]], b: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Where both hold the same fingerprint; of one that is repeated many times in both, occurrences meet in order."""
    out: list[tuple[int, int]] = []
    for k in a.keys() & b.keys():
        x, y = a[k], b[k]
        out += zip(x, y) if len(x) * len(y) > _REPEATS else [(i, j) for i in x for j in y]
    return out


def _aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                known: dict[str, tuple[list[str], set[str]]] = {}
                at, sims, both = [], [], []
                for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    for t in (x, y):
                        if t not in known:
                            known[t] = (w := words(t)), set(w)
                    sim = overlap(known[x][1], known[y][1])
                    if sim >= threshold - 1e-12:
                        at.append(k)
                        sims.append(sim)
                        both.append((x, y))
                need = list(dict.fromkeys(t for p in both for t in p))
                prints = dict(zip(need, winnowed([known[t][0] for t in need], hashes)))
                covers = []
                for x, y in both:
                    wx, wy = known[x][0], known[y][0]
                    covers.append(coverage(wx, wy, seeds_of(prints[x], prints[y]) or seeds_of(every_run(wx), every_run(wy))))
                ix = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(sims, pa.float64()), pa.array(covers, pa.float64())], ["e", "t", "similarity", "coverage"])

    j = pairs.join(texts.select(F.col("id").alias("e"), F.col("x").alias("ex")), "e").join(texts.select(F.col("id").alias("t"), F.col("x").alias("tx")), "t")
    return j.select("e", "t", "ex", "tx").mapInArrow(run, "e long, t long, similarity double, coverage double")


def linked(spark: SparkSession, df: DataFrame, key: str = "row_id", text: str = "comment_text", split: str = "split", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8, least: int = 12, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(membership, links): `id`, `side` (0 train, 1 evaluation), `rep` of every row with a word, and all overlaps of representatives: `e`, `t`, `exact`, `similarity`, `coverage`.

    Exact: the same words in the same order, any number of them, told by the
    hash of the whole sequence.  Near: the sets of words reach `threshold` and
    both hold at least `least` words.  Rows with the same sequence of words
    stand for one record on each side, so copies cost nothing.  Null, empty and
    wordless texts and rows of other or null splits are left out; an empty side
    gives no links.  Without `every`, what has an exact partner is not searched
    for near ones.
    """
    runs = keep(word_runs(df, key, text, split, train, list(evaluation), least))
    firsts = keep(runs.groupBy("lo", "hi", "side").agg(F.min("id").alias("rep")))
    here = firsts.where("side = 1").select("lo", "hi", F.col("rep").alias("e"))
    there = firsts.where("side = 0").select("lo", "hi", F.col("rep").alias("t"))
    exact = keep(here.join(there, ["lo", "hi"]).select("e", "t"))
    near = runs.where(F.col("n") >= least)
    # a fingerprint in over SHORT evaluation records is left to the other lists; one of few may stand in any number of training records
    long, hot = long_lists(near), long_lists(near.where("side = 1"), "prints")
    side = lambda x: keyed(spark, near.where(F.col("side") == x), long, threshold, hot)
    with list_partitions(spark, 30 * firsts.count()):
        pairs = met(side(1), side(0), threshold, same=False)
        named = pairs.join(here.select(F.col("lo").alias("a"), "e"), "a").join(there.select(F.col("lo").alias("b"), "t"), "b").select("e", "t")
        pairs = keep(named.join(exact if every else exact.select("e"), ["e", "t"] if every else "e", "left_anti"))
    texts = only(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("x")), pairs, ["e", "t"])
    aligned = _aligned(pairs, texts, threshold).dropDuplicates(["e", "t"])
    links = exact.select("e", "t", F.lit(True).alias("exact"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage")).unionByName(aligned.withColumn("exact", F.lit(False)).select("e", "t", "exact", "similarity", "coverage"))
    members = runs.select("id", "side", "lo", "hi").join(firsts, ["lo", "hi", "side"]).select("id", "side", "rep").distinct()
    return members, keep(links)


def found(spark: SparkSession, df: DataFrame, key: str = "row_id", **options) -> DataFrame:
    """The `key` of evaluation records that stand in training."""
    members, links = linked(spark, df, key, every=False, **options)
    return members.where("side = 1").join(links.select(F.col("e").alias("rep")), "rep", "left_semi").select(F.col("id").alias(key))


def overlaps(spark: SparkSession, df: DataFrame, key: str = "row_id", **options) -> DataFrame:
    """Evaluation records that stand in training, with their best partner and the numbers of all: `key`, `train_id`, `exact`, `similarity`, `coverage`, `exact_partners`, `near_partners`.

    An exact partner is better than a near one.  `linked` has every pair.
    """
    members, links = linked(spark, df, key, **options)
    copies = members.where("side = 0").groupBy(F.col("rep").alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    number = lambda c: F.sum(F.when(c, F.col("copies")).otherwise(0)).cast("long")
    best = F.max_by(F.struct("t", "exact", "similarity", "coverage"), F.struct("exact", "similarity", "coverage", -F.col("t")))
    per = links.join(copies, "t").groupBy("e").agg(best.alias("m"), number(F.col("exact")).alias("exact_partners"), number(~F.col("exact")).alias("near_partners")).select(F.col("e").alias("rep"), "m.*", "exact_partners", "near_partners")
    return members.where("side = 1").join(per, "rep").select(F.col("id").alias(key), F.col("t").alias("train_id"), "exact", "similarity", "coverage", "exact_partners", "near_partners")


def by_sources(df: DataFrame, members: DataFrame, links: DataFrame, key: str = "row_id", split: str = "split", source: str = "source") -> DataFrame:
    """Per evaluation split, its source and the training source: evaluation records with an exact and with a near partner there; a null source stands as null.

    Representatives meet, with how many of their copies each source holds, so
    neither links nor copies are multiplied out.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(split).alias("split"), F.col(source).alias("source")).distinct()
    placed = members.join(rows, "id")
    here = placed.where("side = 1").groupBy(F.col("rep").alias("e"), "split", "source").agg(F.count(F.lit(1)).alias("n"))
    there = placed.where("side = 0").select(F.col("rep").alias("t"), F.col("source").alias("train_source")).distinct()
    per = links.join(there, "t").groupBy("e", "train_source").agg(F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("near"))
    return here.join(per, "e").groupBy("split", "source", "train_source").agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("exact"), F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("near")
    )


def report(df: DataFrame, found: DataFrame, key: str = "row_id", split: str = "split", source: str = "source", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Per split and source: records, exact and near overlaps, the share of both and their mean coverage; a null source stands as null."""
    rows = df.where(F.col(split).isin(*evaluation)).select(key, split, source)
    j = rows.join(found.select(key, "exact", "coverage"), key, "left")
    return j.groupBy(split, source).agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).alias("exact"),
        F.coalesce(F.sum((~F.col("exact")).cast("long")), F.lit(0)).alias("near"),
        F.round(F.count("exact") / F.count(F.lit(1)), 6).alias("share"),
        F.round(F.avg("coverage"), 6).alias("coverage"),
    )
