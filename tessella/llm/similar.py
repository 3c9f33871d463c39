"""Problem 2: records whose sets of words are similar, across a collection too large for pairwise comparison.

T-occurrence search after the DivideSkip idea.  Two records whose similarity
reaches t share at least T = ceil(t / (1 + t) * (|a| + |b|)) words, so a partner
of a stands in T of the inverted lists of a's words.  The lists are divided:

*   Short lists, of a fixed greatest length (SHORT records), are merged, those
    of the T - 1 longest lists set aside.  The merge is Spark's sorted shuffle:
    one join on the list, which adaptive execution splits where a list is hot.
*   Lists of frequent words grow with the corpus and are never merged as they
    are.  A partner met in no short list can differ from a in few frequent
    words only (`most`), so the frequent words are dealt into parts, each part's
    content has a list of its own, and of the parts all but `most` are equal:
    again T-occurrence, now over parts.  The most + 1 parts that the words'
    frequencies make the rarest are merged, the longer ones set aside.

Sizes and a 108-bit sketch rule out most of what a list brings together.  Of
the candidates left, every list that was set aside is probed by binary search
in the partner's sorted words, and those reaching T are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import keep
from .textforms import words

#: Greatest length of a list that is merged as it is, whatever the corpus.
SHORT = 50
#: Frequent words are told by a table of 2^SLOT_BITS one-byte entries: the bound of what is broadcast, whatever the corpus.
SLOT_BITS = 24
HASH_BITS = 52  # of a word; the rest numbers the records of a batch while lists are probed
_MOST_KEPT = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them (finaliser of splitmix64; fixed values)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """52-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, ws) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in ws]
        except KeyError:
            if len(known) > _MOST_KEPT:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - HASH_BITS)
            return [known[w] for w in ws]


def sorted_lists(flat: np.ndarray, n: list[int]) -> pa.ListArray:
    """Lists of the lengths `n`, laid end to end in `flat`, each sorted."""
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    own = np.repeat(np.arange(len(n)), n)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat[np.lexsort((flat, own))].view(np.int64)))


def flattened(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of longs, end to end, and where each list starts."""
    starts = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[starts[0] : starts[-1]].view(np.uint64), starts - starts[0]


def word_sets(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """`id`, `n`, `lo`, `hi`, `tokens` of rows with at least `least` distinct words: their number, the 128-bit hash of their set, their sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, flat, n = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and len(s := set(words(t))) >= least:
                    ids.append(i)
                    n.append(len(s))
                    flat += hashes(s)
            h = np.array(flat, np.uint64)
            starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            lo = np.add.reduceat(_mix(h + _ODD), starts[:-1]) if n else h
            hi = np.add.reduceat(_mix(h), starts[:-1]) if n else h
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), sorted_lists(h, n)], ["id", "n", "lo", "hi", "tokens"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n int, lo long, hi long, tokens array<long>")


class Long:
    """Which hashes have long lists, and about how long: a table of one byte a slot, sent as its filled slots.

    A word that shares its slot with one of a long list counts as frequent too;
    nothing but speed depends on it.
    """

    def __init__(self, slots: np.ndarray, values: np.ndarray):
        self.slots, self.values = slots, values
        self._table: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.slots, self.values

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a short list, else 1 and more, 8 more for each doubling of its length."""
        if self._table is None:
            self._table = np.zeros(1 << SLOT_BITS, np.uint8)
            self._table[self.slots] = self.values
        return self._table[(hashes >> np.uint64(HASH_BITS - SLOT_BITS)).astype(np.int64)]


def long_lists(lists: DataFrame, column: str = "tokens") -> Long:
    """Of hashes in an array column, those in more than SHORT rows."""
    counts = lists.select(F.explode(column).alias("w")).groupBy("w").count().where(F.col("count") > SHORT)
    value = F.least(F.lit(255), F.lit(1) + F.floor(8 * F.log2(F.col("count") / SHORT))).cast("int")
    rows = counts.groupBy(F.shiftrightunsigned("w", HASH_BITS - SLOT_BITS).alias("slot")).agg(F.max(value).alias("v")).toArrow()  # at most 2^SLOT_BITS rows
    return Long(np.asarray(rows.column("slot")).astype(np.int64), np.asarray(rows.column("v")).astype(np.uint8))


_BITS = 108
_SIZE = (1 << 20) - 1  # greatest number of words that fits beside the second part of a sketch


def parity(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of each record: parity of its words in each of 108 buckets, in two parts of 64 and 44 bits.  Two records differ in no more bits than words."""
    b = (h >> np.uint64(32)) % np.uint64(_BITS)
    one = np.uint64(1)
    low = np.where(b < 64, one << (b & np.uint64(63)), np.uint64(0))
    high = np.where(b >= 64, one << (b & np.uint64(63)), np.uint64(0))
    return np.bitwise_xor.reduceat(low, starts[:-1]), np.bitwise_xor.reduceat(high, starts[:-1])


def packed_size(n: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number of words and the second part of the sketch in one integer."""
    return ((high << np.uint64(20)) | np.minimum(n, _SIZE).astype(np.uint64)).view(np.int64)


def _ranks(own: np.ndarray) -> np.ndarray:
    """The number 0.. of each row within its owner, rows of an owner standing together."""
    if not len(own):
        return own
    first = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
    return np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))


def _base(n: np.ndarray) -> np.ndarray:
    """The least number of parts (as a power of two) a record of n words is dealt into: grows with n only, so that partners agree."""
    return np.maximum(2, np.floor(np.log2(np.maximum(n, 1) / 4 + 1e-9))).astype(np.int64)


def signatures(tokens: np.ndarray, starts: np.ndarray, n: np.ndarray, long: Long, threshold: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The lists each record is merged in: positions of records, keys of lists, and the sketch of every record.

    `tokens[starts[i]:starts[i+1]]` are the words of record i.  Two records
    whose similarity reaches `threshold` share a key: a short list's word, or
    an equal part of their frequent words.  The latter: let `most` of a record
    be how many frequent words may differ from a partner it shares no short
    list with, and its last level the first, from its base on, whose filled
    parts outnumber `most`.  At the lower of both last levels at least one part
    is equal, and in the common order of parts (rarest first) the first equal
    one is among the first `most` + 1 of either record.
    """
    m = len(n)
    lens = np.diff(starts)
    own = np.repeat(np.arange(m), lens)
    h = _mix(tokens + _ODD)
    sketch = (np.zeros(m, np.uint64), np.zeros(m, np.uint64))
    if len(tokens):
        sketch = parity(h, starts)
    value = long(tokens) if len(tokens) else np.zeros(0, np.uint8)
    rare = value == 0
    r = np.bincount(own[rare], minlength=m)
    u = n - r
    # short lists: of all lists in one common order, frequent words last, the T - 1 last are set aside
    prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    idx = np.flatnonzero(rare)
    order = idx[np.lexsort((h[idx], own[idx]))]
    o = own[order]
    take = _ranks(o) < prefix[o]
    rows, keys = [o[take]], [h[order[take]]]
    # parts: how many frequent words may differ if no short list is shared
    most = np.floor(u * (1 - threshold) / threshold - r + 1e-9).astype(np.int64)
    active = (most >= 0) & (r < prefix) & (u > 0)
    last, first = _base(n), _base(np.ceil(threshold * n - 1e-9))
    fi = np.flatnonzero(~rare)
    fo, fh, fw = own[fi], h[fi], 256 - value[fi].astype(np.int64)
    level = 2
    while active.any():
        parts = np.int64(1) << level
        sel = active[fo] & (first[fo] <= level)
        cell = fo[sel] * parts + ((fh[sel] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(cell, kind="stable")
        c = cell[by]
        if len(c):
            cut = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
            total = np.add.reduceat(_mix(fh[sel][by] + np.uint64(level)), cut)
            weight = np.add.reduceat(fw[sel][by], cut)
            rec = c[cut] // parts
            key = _mix(total + (c[cut] % parts).astype(np.uint64) * _ODD + np.uint64(level))
            rarest = np.lexsort((key, -weight, rec))
            kept = rarest[_ranks(rec[rarest]) <= most[rec[rarest]]]
            rows.append(rec[kept])
            keys.append(key[kept])
            filled = np.bincount(rec, minlength=m)
            active &= ~((level >= last) & (filled > most))  # at worst when each word is a part: `most` is less than u
        level += 1
    return np.concatenate(rows), np.concatenate(keys), sketch


def keyed(spark: SparkSession, sets: DataFrame, long: Long, threshold: float, prints: Long | None = None) -> DataFrame:
    """`key`, `lo`, `more`, `sketch`: every list each set of words stands in, once a partition.

    With `prints` the fingerprints in column `prints` are lists as well, but for those it calls long.
    """
    shared = spark.sparkContext.broadcast((long, prints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        long, hot = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                lo = b.column(0).to_pylist()
                new = [k for k, x in enumerate(lo) if x not in seen and not seen.add(x)]
                if len(seen) > 1_000_000:
                    seen.clear()
                if len(new) < len(lo):
                    b = b.take(pa.array(new, pa.int64()))
                if not b.num_rows:
                    continue
                tokens, starts = flattened(b.column(2))
                ids, n = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)
                rows, keys, sketch = signatures(tokens, starts, n, long, threshold)
                if hot is not None:
                    flat, at_print = flattened(b.column(3))
                    own = np.repeat(np.arange(len(n)), np.diff(at_print))
                    ok = hot(flat) == 0
                    rows, keys = np.r_[rows, own[ok]], np.r_[keys, _mix(flat[ok] ^ _ODD)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[rows]), pa.array(packed_size(n, sketch[1])[rows]), pa.array(sketch[0][rows].view(np.int64))], ["key", "lo", "more", "sketch"])

    return sets.select("lo", "n", "tokens", *(["prints"] if prints is not None else [])).mapInArrow(run, "key long, lo long, more long, sketch long")


def met(a: DataFrame, b: DataFrame, threshold: float, same: bool) -> DataFrame:
    """(`a`, `b`), each once: records of `a` and `b` that a list brings together and sizes and sketches do not rule out; `same`: both are one table, and `a` < `b`."""
    a, b = a.alias("a"), b.alias("b")
    words_of = lambda x: F.col(f"{x}.more").bitwiseAND(F.lit(_SIZE))
    differ = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) + F.bit_count(F.shiftrightunsigned(F.col("a.more").bitwiseXOR(F.col("b.more")), 20))
    na, nb = words_of("a"), words_of("b")
    size = (F.greatest(na, nb) == _SIZE) | ((F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9) & (differ <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9))
    on = (F.col("a.key") == F.col("b.key")) & size
    if same:
        on = on & (F.col("a.lo") < F.col("b.lo"))
    return a.join(b.hint("merge"), on).select(F.col("a.lo").alias("a"), F.col("b.lo").alias("b")).distinct()


@contextmanager
def list_partitions(spark: SparkSession, lists: int):
    """While a join over about `lists` rows of lists runs: enough partitions that each reads some 8 MB, and hot ones split."""
    conf = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(spark.sparkContext.defaultParallelism, lists // 250_000)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def overlap(a: set[str], b: set[str]) -> float:
    """Distinct words both hold over distinct words either holds; 0 for two empty sets."""
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def occurrences(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of sorted lists of hashes: how many of the one are found in the other by binary search, and both lengths."""
    both, na, nb = [], [], []
    for at in range(0, len(a), 1 << (64 - HASH_BITS)):  # the number of a pair fills the bits that hashes leave
        numbered = []
        for x, n in ((a, na), (b, nb)):
            flat, starts = flattened(x.slice(at, 1 << (64 - HASH_BITS)))
            own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            n.append(np.diff(starts))
            numbered.append((flat | (own.astype(np.uint64) << np.uint64(HASH_BITS)), own))
        (query, own), (lists, _) = numbered
        place = np.searchsorted(lists, query)
        hit = np.zeros(len(query), bool)
        inside = place < len(lists)
        hit[inside] = lists[place[inside]] == query[inside]
        both.append(np.bincount(own[hit], minlength=len(na[-1])))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *both]), np.concatenate([none, *na]), np.concatenate([none, *nb])


def probed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs `a`, `b` (ids of `sets`) that stand together in at least T = ceil(t / (1 + t) * (|a| + |b|)) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, na, nb = occurrences(b.column(2), b.column(3))
            ix = pa.array(np.flatnonzero(both >= np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix)], ["a", "b"])

    read = only(sets.select("id", "tokens"), pairs, ["a", "b"]).dropDuplicates(["id"])
    j = pairs.join(read.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(read.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return j.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def only(rows: DataFrame, pairs: DataFrame, sides: list[str]) -> DataFrame:
    """The rows (`id`, ...) that some pair names; adaptive execution broadcasts the ids while they are few."""
    return rows.join(pairs.select(F.explode(F.array(*sides)).alias("id")).distinct(), "id", "left_semi")


def similar(spark: SparkSession, df: DataFrame, key: str = "row_id", text: str = "comment_text", threshold: float = 0.8, least: int = 12) -> tuple[DataFrame, DataFrame]:
    """(membership, links): `id`, `rep` of every row with at least `least` distinct words, and similar pairs `a` < `b` of representatives.

    Rows with equal word sets form a class named by its least key, so exact
    copies, a third of all rows even, never meet in a join.  Links hold every
    pair of classes whose similarity reaches `threshold`.  Null, empty and
    wordless texts and texts of too few words are in no class; repeated keys
    are one row; an empty table gives two empty tables.
    """
    if threshold <= 0.5:
        raise ValueError("the threshold must be above 0.5: below, all frequent words of a record may differ")
    sets = keep(word_sets(df, key, text, least))
    long = long_lists(sets)
    reps = keep(sets.groupBy("lo", "hi").agg(F.min("id").alias("rep")))
    members = keep(sets.select("id", "lo", "hi").join(reps, ["lo", "hi"]).select("id", "rep").distinct())
    lists = keyed(spark, sets, long, threshold)
    with list_partitions(spark, 20 * reps.count()):
        candidates = met(lists, lists, threshold, same=True)
        named = candidates.join(reps.select(F.col("lo").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("lo").alias("b"), F.col("rep").alias("y")), "b")
        pairs = keep(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return members, keep(probed(pairs, sets, threshold).distinct())


_BLOCK = 1000  # rows of a class that meet those of another, or of its own, in one place


def expanded(members: DataFrame, links: DataFrame, key: str = "row_id") -> DataFrame:
    """All pairs of rows, smaller key first, each once: links between classes and pairs within a class.

    A class of many rows is cut into blocks of about a thousand, and pairs of
    blocks are joined, so that no task holds more than a block against a block.
    """
    blocks = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).select("rep", "n", F.ceil(F.col("n") / _BLOCK).cast("int").alias("g"))
    rows = members.join(blocks, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), F.col("g")).cast("int").alias("s"))
    each = lambda g, name: F.explode(F.sequence(F.lit(0), F.col(g) - 1)).alias(name)
    across = links.join(blocks.select(F.col("rep").alias("a"), F.col("g").alias("ga")), "a").join(blocks.select(F.col("rep").alias("b"), F.col("g").alias("gb")), "b")
    across = across.select("a", "b", "gb", each("ga", "sa")).select("a", "b", "sa", each("gb", "sb"))
    within = blocks.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), "g", each("g", "sa")).select("a", "b", "sa", each("g", "sb")).where("sa <= sb")
    met_blocks = across.unionByName(within)
    x = rows.select(F.col("rep").alias("a"), F.col("s").alias("sa"), F.col("id").alias("x"))
    y = rows.select(F.col("rep").alias("b"), F.col("s").alias("sb"), F.col("id").alias("y"))
    pairs = met_blocks.join(x, ["a", "sa"]).join(y, ["b", "sb"]).where("a <> b or sa < sb or x < y")
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def groups(df: DataFrame, members: DataFrame, links: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per row of `df`: `key`, `class_id`, the `members` of the class and its `links` to other classes.

    A row of too few words, or of a null text, is a class of its own without links.
    """
    both = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    per = sizes.join(both, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
    named = members.join(per, "rep").select(F.col("id").alias("_id"), F.col("rep").alias("class_id"), "members", "links")
    rows = df.select(key)
    return rows.join(named, rows[key].cast("long") == named["_id"], "left").select(key, F.coalesce("class_id", rows[key].cast("long")).alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("links", F.lit(0)).alias("links"))
