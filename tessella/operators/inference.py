"""Language rules, batch scoring with a pluggable scorer, and result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, has_word, is_ascii
from ..schema import LABELS, LANGS, SERVING_THRESHOLDS

# Characters that speak for a language.
CHARACTERS = {
    "ru": r"\x{0400}-\x{052F}", "tr": "ĞğİıŞş", "es": "ÁÉÍÑÓÚÜ", "fr": r"\x{C0}-\x{C6}\x{C8}-\x{CF}\x{D2}-\x{D6}Œœ", "it": "ÀÈÉÌÒÙ", "pt": r"\x{C0}-\x{C3}ÇÉÊ\x{D3}-\x{D5}",
}
NAME_TO_CODE = {"English": "en", "Russian": "ru", "Turkish": "tr", "Spanish": "es", "French": "fr", "Italian": "it", "Portuguese": "pt"}


def character_scores(c: Column) -> dict[str, Column]:
    """Per language the number of characters that speak for it; English has none."""
    return {x: (F.length(F.regexp_replace(c, f"[^{CHARACTERS[x]}]", "")) if x in CHARACTERS else F.lit(0)) for x in LANGS}


def token_scores(c: Column) -> dict[str, Column]:
    """Per language the number of tokens that hold its code; the first code in language order wins."""
    words = F.split(F.lower(c), f"[{SPACE}]+")
    code = lambda w: F.coalesce(*[F.when(F.contains(w, F.lit(x)), x) for x in LANGS])
    found = F.transform(words, code)
    return {x: F.size(F.filter(found, lambda w: w == x)) for x in LANGS}


def detect_by_rules(c: Column, detected: Column | None = None) -> Column:
    """Language of a text: a detector's answer if supported, English for texts without a word or in ASCII, else the best of characters twice and tokens once; English if nothing scores."""
    chars, toks = character_scores(c), token_scores(c)
    score = {x: chars[x] * 2 + toks[x] for x in LANGS}
    best = F.array_max(F.array(*[F.struct(score[x].cast("int").alias("s"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(LANGS)]))
    rules = F.when(~has_word(c) | is_ascii(c), "en").when(best["s"] > 0, best["x"]).otherwise("en")
    if detected is None:
        return rules
    return F.when(has_word(c) & detected.isin(*LANGS), detected).otherwise(rules)


def detect_by_stop_words(c: Column, stop: dict[str, list[str]]) -> Column:
    """The language whose stop words make up most tokens of a text, the first of equal ones; null if it holds none.

    A detector for `detect_by_rules` where no library is at hand.
    """
    lists = {x: frozenset(stop[x]) for x in LANGS if x in stop}

    @F.pandas_udf("string")
    def detect(s: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            ws = t.lower().split()
            hits = {x: sum(w.strip(".,;:!?\"()") in known for w in ws) for x, known in lists.items()}
            best = max(hits, key=hits.get, default=None)
            return best if best and hits[best] else None

        return s.map(one, na_action="ignore")

    return detect(c)


def code_of_name(display: Column) -> Column:
    """Code of a display name such as 'flag English': the second word; English by default."""
    name = F.try_element_at(F.split(display, " "), F.lit(2))
    pairs = F.create_map(*[F.lit(x) for kv in NAME_TO_CODE.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), F.lit("en"))


def scored(df: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], key: str = "row_id", text: str = "comment_text", lang: str = "lang", batch: int = 8) -> DataFrame:
    """`key` and one probability a label, by a scorer loaded once a task and called on small batches.

    `load()` returns a function from texts and languages to rows of
    probabilities in label order.  Blank and null texts get zeros.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in batches:
            texts, langs = pdf["t"].fillna("").tolist(), pdf["l"].fillna("en").tolist()
            out = [[0.0] * len(LABELS) for _ in texts]
            live = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(live), batch):
                part = live[at : at + batch]
                for i, row in zip(part, score([texts[i] for i in part], [langs[i] for i in part])):
                    out[i] = row
            yield pd.DataFrame({"k": pdf["k"], **{x: [r[j] for r in out] for j, x in enumerate(LABELS)}})

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    return slim.mapInPandas(run, f"k {kind}, " + ", ".join(f"{x} double" for x in LABELS)).withColumnRenamed("k", key)


def lexicon_scorer() -> Callable[[list[str], list[str]], list[list[float]]]:
    """The scorer used where no model is at hand: shares of words on a short list, squashed; a stand-in with the scorer's interface."""
    from .explain import LEXICON

    def score(texts: list[str], langs: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            low = t.lower()
            out.append([min(1.0, 0.05 + 0.4 * sum(w in low for w in LEXICON[x][1])) for x in LABELS])
        return out

    return score


def results(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Result rows: `probabilities` by label, `is_toxic`, `toxic_categories` in label order."""
    probabilities = F.create_map(*[x for y in LABELS for x in (F.lit(y), F.col(y))])
    hits = F.filter(F.array(*[F.when(F.col(y) >= thresholds[y], F.lit(y)) for y in LABELS]), lambda x: x.isNotNull())
    return df.withColumn("probabilities", probabilities).withColumn("toxic_categories", hits).withColumn("is_toxic", F.size("toxic_categories") > 0)


def top_category(probabilities: dict[str, Column], fallback: str = "toxic", least: float = 0.2) -> Column:
    """The label of the greatest probability, the first of equal ones; `fallback` if none is above `least`."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(p, F.lit(0.0)).alias("p"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, (x, p) in enumerate(probabilities.items())]))
    return F.when(best["p"] > least, best["x"]).otherwise(fallback)


def predicted(spark: SparkSession, texts: list[str], langs: list[str] | None = None, load=lexicon_scorer, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Result rows of a few texts given by hand; languages by the rules where none are given."""
    rows = [(i, t, (langs or [None] * len(texts))[i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, comment_text string, lang string")
    df = df.withColumn("lang", F.coalesce("lang", detect_by_rules(F.coalesce("comment_text", F.lit("")))))
    return results(scored(df, load), thresholds or SERVING_THRESHOLDS).join(df.select("row_id", "comment_text", "lang"), "row_id")
