"""Near-duplicate leakage: evaluation texts whose character n-grams are close to a training text's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep


def _text(t: str) -> str:
    return " ".join(t.lower().split())


def band_keys(t: str, bands: int, width: int, n: int = 8) -> np.ndarray | None:
    """One key a band of min-hashes of a text's character n-grams; None for a blank text."""
    t = _text(t)
    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return None
    n = min(n, len(points))
    h = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + points[i : len(points) - n + 1 + i]
    h = np.unique(h)
    h ^= h >> np.uint64(29)
    minima = (h[None, :] * _FACTORS[: bands * width, None] >> np.uint64(8)).min(1)
    keys = np.arange(bands, dtype=np.uint64)
    for i in range(width):
        keys = (keys ^ minima[i::width]) * np.uint64(0x9E3779B97F4A7C15)
    return keys


# odd multipliers, one a min-hash
_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _banded(rows: DataFrame, bands: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                if (x := band_keys(t, bands, width)) is not None:
                    at += [k] * bands
                    keys.append(x)
            ix = pa.array(at, pa.int64())
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(flat.view(np.int64))], ["id", "e", "key"])

    return rows.select("id", "e", "comment_text").mapInArrow(run, "id long, e boolean, key long")


def profile(t: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 3- and 4-grams of a text, as hashes in order, and how often each occurs."""
    points = np.frombuffer(_text(t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    all_ = []
    for n in (3, 4):
        h = np.full(max(0, len(points) - n + 1), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(h)]
            h ^= h >> np.uint64(31)
        all_.append(h)
    grams, counts = np.unique(np.concatenate(all_), return_counts=True)
    return grams, counts.astype(float)


#: Document frequencies of n-grams are kept by hash in 2^_BINS cells: the bound of what is broadcast, whatever the corpus.
_BINS = 20


def _bins(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts n-grams of each cell occur, and the number of texts; added up within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(_bins(profile(t)[0])) for t in b.column(0).to_pylist() if t]
            cells, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["cell", "n"])

    rows = texts.select("comment_text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2^_BINS rows
    out = np.zeros(1 << _BINS, np.int64)
    out[np.asarray(rows.column("cell"))] = np.asarray(rows.column("n"))
    return out, texts.count()


def weighted(p: tuple[np.ndarray, np.ndarray], rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A profile with its counts times the rarity of each n-gram."""
    return p if rarity is None else (p[0], p[1] * rarity[_bins(p[0])])


def cosine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Cosine of two profiles; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    dot = (a[1] * np.where(b[0][at] == a[0], b[1][at], 0)).sum()
    return float(dot / np.sqrt((a[1] ** 2).sum() * (b[1] ** 2).sum()))


def _cosines(pairs: DataFrame, threshold: float, rarity: np.ndarray | None) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sims, seen = [], [], {}
            for k, both in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for t in both:
                    if t not in seen:
                        if len(seen) > 500:
                            seen.clear()
                        seen[t] = weighted(profile(t), shared.value)
                s = cosine(*(seen[t] if t in seen else weighted(profile(t), shared.value) for t in both))
                if s >= threshold:
                    at.append(k)
                    sims.append(round(s, 6))
            ix = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(sims, pa.float64())], ["row_id", "train_id", "cosine"])

    spread = pairs.select("e", "t", "ex", "tx").repartition(max(8, pairs.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(run, "row_id long, train_id long, cosine double")


def leaking(df: DataFrame, threshold: float = 0.9, bands: int = 20, width: int = 4, idf: bool = True, evaluation: tuple[str, ...] = ("val",)) -> DataFrame:
    """Evaluation rows with the closest training row whose cosine over 3- and 4-grams reaches `threshold`.

    With `idf`, counts are weighted by ln((1 + N) / (1 + n)) + 1 of the N
    different training texts and the n that hold the n-gram.  Candidates agree
    in one of `bands` bands of `width` min-hashes of their 8-grams; equal texts
    stand for each other on both sides, and only ids go through the joins on
    bands, which adaptive execution splits where a band is hot.  `row_id`,
    `train_id`, `cosine`.
    """
    rows = df.where(F.col("split").isin("train", *evaluation) & F.col("comment_text").isNotNull()).select("row_id", "comment_text", (F.col("split") != "train").alias("e"))
    firsts = rows.groupBy("comment_text", "e").agg(F.min("row_id").alias("id"))
    keyed = _banded(firsts, bands, width)
    e = keyed.where("e").select(F.col("id").alias("e"), "key")
    t = keyed.where("not e").select(F.col("id").alias("t"), "key")
    pairs = keep(e.join(t, "key").select("e", "t").distinct())
    rarity = None
    if idf:
        held, n = document_frequencies(firsts.where("not e"))
        rarity = np.log((1 + n) / (1 + held)) + 1
    texts = firsts.select("id", "comment_text").join(pairs.select(F.explode(F.array("e", "t")).alias("id")).distinct(), "id", "left_semi")
    full = pairs.join(texts.select(F.col("id").alias("e"), F.col("comment_text").alias("ex")), "e").join(texts.select(F.col("id").alias("t"), F.col("comment_text").alias("tx")), "t")
    best = _cosines(full, threshold, rarity).groupBy("row_id").agg(F.max_by(F.struct("train_id", "cosine"), F.struct("cosine", -F.col("train_id"))).alias("b")).select(F.col("row_id").alias("first"), "b.*")
    same = rows.where("e").join(firsts.where("e").select("comment_text", F.col("id").alias("first")), "comment_text")
    return same.join(best, "first").select("row_id", "train_id", "cosine")
