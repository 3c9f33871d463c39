"""Importance of tokens by word lists, and an attention-like matrix of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import LABELS

# Per label the score of a token and the pieces it may hold.
LEXICON = {
    "toxic": (0.8, ["idiot", "stupid", "fuck", "shit", "hate", "kill", "die", "racist", "ugly"]),
    "severe_toxic": (0.9, ["fuck", "shit", "kill"]),
    "obscene": (0.85, ["fuck", "shit"]),
    "threat": (0.9, ["kill", "die", "hurt"]),
    "insult": (0.8, ["idiot", "stupid", "ugly"]),
    "identity_hate": (0.9, ["racist"]),
}


def _score(token: Column, label: str) -> Column:
    score, pieces = LEXICON[label]
    return F.when(F.lower(token).rlike("|".join(pieces)), score).otherwise(0.0)


def token_importance(df: DataFrame, text: str, probabilities: dict[str, Column], key: str = "row_id") -> DataFrame:
    """One row a token: `key`, `pos`, `token` and its importance for every label.

    Scores are divided by the greatest of the text and multiplied by the
    label's probability; under 0.05 all are 0.
    """
    words = tokens(F.col(text))
    cols = {}
    for x in LABELS:
        score, pieces = LEXICON[x]
        hit = F.exists(words, lambda w: F.lower(w).rlike("|".join(pieces)))
        cols[f"_{x}"] = F.when((probabilities[x] >= 0.05) & hit, probabilities[x] / score).otherwise(0.0)
    each = df.withColumns(cols).select(key, *cols, F.posexplode(words).alias("pos", "token"))
    return each.select(key, "pos", "token", *[F.round(_score(F.col("token"), x) * F.col(f"_{x}"), 6).alias(x) for x in LABELS])


def attention(vectors: DataFrame, group: str, vector: str, order: str) -> DataFrame:
    """For each group of vectors the matrix softmax(H H' / sqrt(d)), one row a vector.  Groups are texts: as many vectors as a text has tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        h = np.stack([np.asarray(v, float) for v in pdf[vector]])
        z = h @ h.T / np.sqrt(h.shape[1])
        e = np.exp(z - z.max(1, keepdims=True))
        return pd.DataFrame({group: pdf[group], order: pdf[order], "attention": list(e / e.sum(1, keepdims=True))})

    s = vectors.schema
    return vectors.select(group, order, vector).groupBy(group).applyInPandas(run, f"{group} {s[group].dataType.simpleString()}, {order} {s[order].dataType.simpleString()}, attention array<double>")


def shown_tokens(pieces: Column, special: tuple[str, ...] = ("<s>", "</s>", "<pad>", "<unk>", "<mask>")) -> Column:
    """Sub-word pieces for display: special ones left out, the word mark removed, empty ones named [SPACE]."""
    kept = F.filter(pieces, lambda w: ~w.isin(*special))
    bare = F.transform(kept, lambda w: F.replace(w, F.lit("▁"), F.lit("")))
    return F.transform(bare, lambda w: F.when(w == "", "[SPACE]").otherwise(w))


def shown_matrix(pieces: Column, matrix: Column, special: tuple[str, ...] = ("<s>", "</s>", "<pad>", "<unk>", "<mask>")) -> Column:
    """A square matrix (array of rows) without the rows and columns of special pieces."""
    at = F.filter(F.transform(pieces, lambda w, i: F.when(~w.isin(*special), i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.transform(at, lambda j: F.get(F.get(matrix, i), j)))
