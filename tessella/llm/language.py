"""Problem 1: the language of each document and of each stretch of a mixed one, with a confidence.

Hierarchical discrimination: linear support vector machines first tell the
language family (one against the rest, the largest margin wins), then, within
that family only, one-versus-one machines separate the closely related
languages by their votes.  All machines are linear in
the mean of word vectors (word identity and character n-grams), so a word's
eleven-or-so scores are computed once a worker and a sentence is a mean.

The classifier is fitted here, on a bounded sample of rows that carry a label
(`per_label` rows a language); wrong labels in the sample are outvoted by a
naive Bayes pass over the same sample before the machines are fitted.  Every
tenth sentence is held out, and the confidence is fitted to those: the one
factor of the scores that makes it likeliest.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textforms import words

LANGUAGES = ("en", "ru", "tr", "es", "fr", "it", "pt", "de")
FAMILIES = {"Germanic": ("en", "de"), "Slavic": ("ru",), "Turkic": ("tr",), "Romance": ("es", "fr", "it", "pt")}
#: A usual romanisation of Russian, to know it in Latin letters.
ROMANISED = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" ")))
_STOP_RE = re.compile(r"[.!?…。！？．]+|\n+")
#: A sentence of n words needs 1 + _EXTRA / n times the margin.
_EXTRA = 6.0
_STRETCH = 6
SHORTEST = 5  # words of a sentence that counts


def base_code(lang: Column) -> Column:
    """The language a code names: blanks, case and region suffixes set aside."""
    return F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*$", 1))


_BREAK = "qzxqz"  # stands for a sentence break while a text is read as a whole


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a text; sentences without a word are left out."""
    out, now = [], []
    for w in words(_STOP_RE.sub(f" {_BREAK} ", text)):
        if w != _BREAK:
            now.append(w)
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def grams(word: str) -> list[str]:
    """Character n-grams of two to four characters of a word with its ends marked."""
    w = f"<{word}>"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def _without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("ı", "i")) if not unicodedata.combining(c))


def _romanised(word: str) -> str:
    return "".join(ROMANISED.get(c, c) for c in word)


class Model:
    """The fitted machines: weights of words and n-grams, one column a machine."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray, languages: list[str]):
        self.index, self.weights, self.bias, self.languages, self.factor = index, weights, bias, languages, 3.0
        self.families = [f for f in FAMILIES if any(x in languages for x in FAMILIES[f])]
        self.pairs = [p for f in self.families for p in combinations([x for x in FAMILIES[f] if x in languages], 2)]

    def word_vectors(self, new: list[str]) -> np.ndarray:
        """The machines' weights of each word: of itself and, together of length one or so, of its n-grams."""
        get = self.index.get
        flat, lens = [], []
        for w in new:
            ids = [i for g in grams(w) if (i := get(g)) is not None]
            flat += ids
            lens.append(len(ids))
        out = np.zeros((len(new), self.weights.shape[1]), np.float32)
        n = np.array(lens)
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
            out[some] = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(np.array([len(new[k]) * 3 for k in some], np.float32))[:, None]
        own = [get(" " + w, -1) for w in new]
        known = np.flatnonzero(np.array(own) >= 0)
        out[known] += self.weights[[own[k] for k in known]]
        return out

    def scores(self, machines: np.ndarray) -> np.ndarray:
        """Score of each language from the machines' outputs, greatest for the winner of the family with the largest margin.

        The winner within a family has the family's margin; the others lag by
        what they are behind in the family's votes.
        """
        out = np.zeros((len(machines), len(self.languages)), np.float32)
        nf = len(self.families)
        votes = np.zeros_like(out)
        for k, (a, b) in enumerate(self.pairs):
            n = len([x for x in FAMILIES[next(f for f in self.families if a in FAMILIES[f])] if x in self.languages]) - 1
            m = np.clip(machines[:, nf + k], -2, 2) / n
            votes[:, self.languages.index(a)] += m
            votes[:, self.languages.index(b)] -= m
        for k, f in enumerate(self.families):
            mine = [self.languages.index(x) for x in FAMILIES[f] if x in self.languages]
            out[:, mine] = machines[:, k : k + 1] + votes[:, mine] - votes[:, mine].max(1, keepdims=True)
        return out

    def confidence(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each language."""
        e = np.exp(self.factor * (scores - scores.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _svm(x: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, y: np.ndarray, reg: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine (squared hinge loss, L2) by accelerated gradient steps; x in coordinate form."""
    rows, cols, vals = (a.astype(t) for a, t in zip(x, (np.int64, np.int64, np.float64)))
    m = len(y)
    scale = 2.0 / np.sqrt(max(1e-12, (vals**2).sum() / m))  # rows of norm 2, so that weights and bias converge alike
    vals = vals * scale
    by_col = np.argsort(cols, kind="stable")
    c_rows, c_vals = rows[by_col], vals[by_col]
    used, c_at = np.unique(cols[by_col], return_index=True)
    filled, r_at = np.unique(rows, return_index=True)  # rows come in order
    pos = y > 0
    cost = np.where(pos, m / (2 * max(1, pos.sum())), m / (2 * max(1, (~pos).sum()))) / m

    def mul(w: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        out[filled] = np.add.reduceat(w[cols] * vals, r_at)
        return out

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[used] = np.add.reduceat(g[c_rows] * c_vals, c_at)
        return out

    v = np.ones(n) / np.sqrt(n)
    for _ in range(6):
        v = back(cost * mul(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (reg + 2 * (top * 1.3 + 1.0))
    w, b, w0, b0, t = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        slack = np.maximum(0, 1 - y * (mul(zw) + zb))
        g = -2 * cost * y * slack
        w0, b0, t = w, b, t1
        w, b = zw - step * (back(g) + reg * zw), zb - step * g.sum()
    return w * scale, b


def fit(labelled: list[tuple[str, str]], per_language: int = 500) -> Model:
    """A model from (language, text) rows; languages with under two usable sentences are left out.

    `per_language` bounds the sentences the machines are fitted on.
    """
    mixed_up = sorted((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), x, t) for x, t in labelled if x in LANGUAGES and t)
    docs = [(x, sentences(t)) for _, x, t in mixed_up]
    counts: dict[str, Counter] = defaultdict(Counter)
    for x, ss in docs:
        for s in ss:
            counts[x].update(s)
            counts[x].update(_without_accents(w) for w in s)
    known = [x for x in LANGUAGES if counts[x]]
    if len(known) < 2:
        raise ValueError("labels of at least two languages are needed")
    vocabulary = len({w for c in counts.values() for w in c})
    totals = {x: sum(counts[x].values()) for x in known}
    logs = [np.log(0.1 / (totals[x] + 0.1 * vocabulary)) for x in known]
    table: dict[str, np.ndarray] = {}
    for w in {w for c in counts.values() for w in c}:
        # seen in one language only, and rarely: a name; it says nothing
        if sum(counts[x][w] for x in known) >= 3:
            table[w] = np.array([np.log((counts[x][w] + 0.1) / (totals[x] + 0.1 * vocabulary)) - logs[k] for k, x in enumerate(known)])
    taken: dict[str, list[list[str]]] = defaultdict(list)
    zero = np.zeros(len(known))
    for x, ss in docs:
        for s in ss:
            if len(s) >= SHORTEST:
                score = sum((table.get(w, zero) for w in s), zero)
                k = int(score.argmax())
                rest = np.delete(score, k).max()
                if score[k] - rest > 2.0 and len(taken[known[k]]) < per_language:
                    taken[known[k]].append(s)
    use = [x for x in LANGUAGES if len(taken[x]) >= 2]
    examples: list[tuple[int, list[str]]] = []
    for x in use:
        # of each sentence also a short stretch, so that short sentences are told apart as well
        for s in [y for k, s in enumerate(taken[x]) for y in ((s, s[k % (len(s) - _STRETCH) :][:_STRETCH]) if len(s) > _STRETCH + 2 else (s,))]:
            examples.append((use.index(x), s))
            bare = [_without_accents(w) for w in s]
            if bare != s:
                examples.append((use.index(x), bare))
            if x == "ru" and any("а" <= c <= "я" for c in s[0]):
                examples.append((use.index(x), [_romanised(w) for w in s]))
    held, examples = examples[::10], [x for k, x in enumerate(examples) if k % 10]
    vocabulary_ids: dict[str, int] = {}
    rows = [[vocabulary_ids.setdefault(w, len(vocabulary_ids)) for w in s] for _, s in examples]
    spelled = list(vocabulary_ids)
    seen = np.bincount([w for r in rows for w in set(r)], minlength=len(spelled))
    counts_of: Counter = Counter()
    for w, k in zip(spelled, seen.tolist()):
        for g in {" " + w, *grams(w)}:
            counts_of[g] += k
    index = {g: i for i, g in enumerate(g for g, k in counts_of.items() if k >= 3)}
    ids, weights = [], []
    for w in spelled:
        of = [i for g in grams(w) if (i := index.get(g)) is not None]
        each = [1 / np.sqrt(len(w) * 3)] * len(of)
        if (i := index.get(" " + w)) is not None:
            of.append(i)
            each.append(1.0)
        ids.append(np.array(of, np.int64))
        weights.append(np.array(each))
    c = np.concatenate([ids[w] for r in rows for w in r])
    v = np.concatenate([weights[w] / len(r) for r in rows for w in r])
    lens = np.array([sum(len(ids[w]) for w in r) for r in rows])
    r = np.repeat(np.arange(len(rows)), lens)
    lang = np.array([k for k, _ in examples])
    model = Model(index, np.zeros((len(index), 0), np.float32), np.zeros(0, np.float32), use)
    machines = []
    for f in model.families:
        mine = [use.index(x) for x in FAMILIES[f] if x in use]
        machines.append(_svm((r, c, v), len(index), np.where(np.isin(lang, mine), 1.0, -1.0)))
    for a, b in model.pairs:
        keep = np.isin(lang, [use.index(a), use.index(b)])
        renumber = np.cumsum(keep) - 1
        part = keep[r]
        machines.append(_svm((renumber[r[part]], c[part], v[part]), len(index), np.where(lang[keep] == use.index(a), 1.0, -1.0)))
    model.weights = np.stack([w for w, _ in machines], 1).astype(np.float32)
    model.bias = np.array([b for _, b in machines], np.float32)
    scores = model.scores(_machines(model, [], [w for _, t in held for w in t], np.array([len(t) for _, t in held]))[0])
    truth = np.arange(len(held)), [k for k, _ in held]

    def loss(factor: float) -> float:
        model.factor = factor
        return -float(np.log(np.maximum(model.confidence(scores)[truth], 1e-9)).mean())

    model.factor = min((1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0), key=loss)
    return model


def fitted(labelled: list[tuple[str, str]]) -> Model | None:
    """The model, or None where the labels do not suffice for one."""
    try:
        return fit(labelled)
    except ValueError:
        return None


def labelled_sample(df: DataFrame, text: str = "comment_text", lang: str = "lang", key: str = "row_id", per_label: int = 400) -> list[tuple[str, str]]:
    """At most about `per_label` rows of each label, chosen by the hash of the key: the documented bound of the training sample."""
    rows = df.select(base_code(F.col(lang)).alias("x"), F.col(text).alias("t"), F.col(key).alias("k")).where(F.col("x").isin(*LANGUAGES) & (F.length("t") >= 20))
    counts = {r[0]: r[1] for r in rows.groupBy("x").count().collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for x, n in counts.items():
        share = F.when(F.col("x") == x, F.lit(min(1.0, per_label / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1_000_003)) / 1_000_003.0 < share)
    # the share makes about per_label rows; the limit is the proven bound of what reaches the driver
    return [(r[0], r[1]) for r in drawn.select("x", "t").limit(2 * per_label * len(LANGUAGES)).collect()]


_MOST_WORDS = 300_000


def _machines(model: Model, cache: list, flat: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all machines for sentences given as one list of words and their lengths, and the row of each word in the vectors `cache[1]`."""
    if cache and len(cache[0]) > _MOST_WORDS:
        cache.clear()
    if not cache:
        cache += [{}, np.zeros((1024, len(model.bias)), np.float32)]
    ids, vectors = cache
    new = [w for w in dict.fromkeys(flat) if w not in ids]
    if new:
        start = len(ids)
        if start + len(new) > len(vectors):
            vectors = cache[1] = np.concatenate([vectors, np.zeros((max(len(vectors), len(new)), vectors.shape[1]), np.float32)])
        ids.update(zip(new, range(start, start + len(new))))
        for at in range(0, len(new), 5000):
            vectors[start + at : start + at + 5000][: len(new) - at] = model.word_vectors(new[at : at + 5000])
    if not flat:
        return np.zeros((0, len(model.bias)), np.float32), np.zeros(0, np.int64)
    at = np.fromiter((ids[w] for w in flat), np.int64, len(flat))
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return np.add.reduceat(vectors[at], starts, axis=0) / lens[:, None] + model.bias, at


def _switches(model: Model, vectors: np.ndarray, at: np.ndarray, lens: np.ndarray, margin: float) -> dict[int, int]:
    """Of sentences in two languages, after how many words the language switches.

    Looked at are sentences whose first and last five words are told apart;
    both sides must be ahead in their own language as a sentence must be.
    """
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    long = np.flatnonzero(lens >= 2 * SHORTEST)
    if not len(long):
        return {}
    five = np.arange(SHORTEST)
    heads, tails = ((vectors[at[(s[long])[:, None] + five]]).mean(1) + model.bias for s in (starts, starts + lens - SHORTEST))
    out = {}
    for j in long[model.scores(heads).argmax(1) != model.scores(tails).argmax(1)].tolist():
        n = int(lens[j])
        sums = np.cumsum(vectors[at[starts[j] : starts[j] + n]], axis=0)
        k = np.arange(SHORTEST, n - SHORTEST + 1)
        before = model.scores(sums[k - 1] / k[:, None] + model.bias)
        after = model.scores((sums[-1] - sums[k - 1]) / (n - k)[:, None] + model.bias)
        a, b, r = before.argmax(1), after.argmax(1), np.arange(len(k))
        ahead, behind = before[r, a] - before[r, b], after[r, b] - after[r, a]
        best = int((k * ahead + (n - k) * behind).argmax())
        if ahead[best] > margin * (1 + _EXTRA / k[best]) and behind[best] > margin * (1 + _EXTRA / (n - k[best])):
            out[j] = int(k[best])
    return out


def segments(spark: SparkSession, df: DataFrame, model: Model | None, key: str = "row_id", text: str = "comment_text", margin: float = 0.5) -> DataFrame:
    """One row per stretch of one language: `key`, `segment`, `words`, `longest`, `language`, `confidence`.

    A sentence takes the language of the whole comment unless another scores
    higher by more than `margin`, and more the shorter it is; a sentence of
    under five words always does.
    A sentence that switches its language, with five words or more on either
    side, is two stretches.  Neighbouring stretches of one language make one
    segment; `longest` is the number of words of its longest whole sentence.  Texts without a word (null, empty,
    blank, only signs) give one row with language and confidence null, and so
    does every row where there is no model (too few labels to fit one).
    """
    if model is None:
        return df.select(key, F.lit(0).alias("segment"), F.lit(0).alias("words"), F.lit(0).alias("longest"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"))
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache: list = []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                yield _segmented(model, cache, b, margin)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, segment int, words int, longest int, language string, confidence double").withColumnRenamed("k", key)


def _segmented(model: Model, cache: list, b: pa.RecordBatch, margin: float) -> pa.RecordBatch:
    flat: list[str] = []
    lens: list[int] = []
    owner: list[int] = []
    for r, t in enumerate(b.column(1).to_pylist()):
        for s in sentences(t) if t else ():
            flat += s
            lens.append(len(s))
            owner.append(r)
    n = np.array(lens, np.int64)
    own = np.array(owner, np.int64)
    whole = n
    if len(n):
        outputs, at = _machines(model, cache, flat, n)
        if cut := _switches(model, cache[1], at, n, margin):
            parts = [(j, k) for j, x in enumerate(lens) for k in ((cut[j], x - cut[j]) if j in cut else (x,))]
            own = own[[j for j, _ in parts]]
            n = np.array([k for _, k in parts], np.int64)
            whole = np.array([0 if j in cut else k for j, k in parts], np.int64)
            outputs = np.add.reduceat(cache[1][at], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None] + model.bias
    scores = model.scores(outputs) if len(n) else np.zeros((0, len(model.languages)), np.float32)
    # the whole comment: mean over its words
    total = np.zeros((b.num_rows, len(model.languages)))
    np.add.at(total, own, scores * n[:, None])
    main = total.argmax(1)
    best = scores.argmax(1) if len(n) else np.zeros(0, np.int64)
    rows = np.arange(len(n))
    ahead = scores[rows, best] - scores[rows, main[own]] if len(n) else np.zeros(0)
    chosen = np.where((ahead > margin * (1 + _EXTRA / np.maximum(n, 1))) & (n >= SHORTEST), best, main[own]) if len(n) else best
    new = np.ones(len(n), bool)
    if len(n) > 1:
        new[1:] = (own[1:] != own[:-1]) | (chosen[1:] != chosen[:-1])
    first = np.flatnonzero(new)
    if len(first):
        seg_words = np.add.reduceat(n, first)
        seg_long = np.maximum.reduceat(whole, first)
        seg_scores = np.add.reduceat(scores * n[:, None], first, axis=0) / seg_words[:, None]
        seg_own, seg_lang = own[first], chosen[first]
        conf = model.confidence(seg_scores)[np.arange(len(first)), seg_lang]
        starts = np.ones(len(first), bool)
        starts[1:] = seg_own[1:] != seg_own[:-1]
        number = np.arange(len(first)) - np.maximum.accumulate(np.where(starts, np.arange(len(first)), 0))
    else:
        seg_words = seg_long = seg_own = seg_lang = number = np.zeros(0, np.int64)
        conf = np.zeros(0)
    none = np.setdiff1d(np.arange(b.num_rows), own)
    names = np.array(model.languages, object)
    z = len(none)
    keys = b.column(0).take(pa.array(np.concatenate([seg_own, none])))
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(np.concatenate([number, np.zeros(z, np.int64)]), pa.int32()), pa.array(np.concatenate([seg_words, np.zeros(z, np.int64)]), pa.int32()), pa.array(np.concatenate([seg_long, np.zeros(z, np.int64)]), pa.int32()),
         pa.array([*names[seg_lang], *[None] * z], pa.string()), pa.array([*np.round(conf, 4).tolist(), *[None] * z], pa.float64())],
        ["k", "segment", "words", "longest", "language", "confidence"],
    )


def mislabelled(df: DataFrame, found: DataFrame, key: str = "row_id", lang: str = "lang", doubt: float = 0.8) -> DataFrame:
    """`key`, `true_lang`: comments of one language whose label names another or none, and every language of a mixed comment.

    `found` is the result of `segments`.  Only languages with a sentence of
    five words count in a mixed comment; a comment of one language needs five
    words.  Below the confidence `doubt` a label that names a language stands,
    and a stretch does not make a comment mixed.
    Repeated keys are taken as one comment.
    """
    per = found.where("language is not null").groupBy(key).agg(F.sum("words").alias("words"), F.collect_set(F.when((F.col("longest") >= SHORTEST) & (F.col("confidence") >= doubt), F.col("language"))).alias("long"), F.max_by("language", F.struct("words", "language")).alias("main"), F.max_by("confidence", F.struct("words", "language")).alias("sure"))
    labels = df.select(key, base_code(F.col(lang)).alias("_label")).groupBy(key).agg(F.min("_label").alias("_label"))
    wrong = (F.col("words") >= SHORTEST) & ~F.col("_label").eqNullSafe(F.col("main")) & ((F.col("sure") >= doubt) | ~F.coalesce(F.col("_label").isin(*LANGUAGES), F.lit(False)))
    true = F.when(F.size("long") >= 2, F.col("long")).when(wrong, F.array("main"))
    return per.join(labels, key).select(key, F.explode(true).alias("true_lang"))
