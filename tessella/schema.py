"""Names, types and fixed tables of the comment corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order matters: bit patterns and matrices follow it.
LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
LANGS = ["en", "ru", "tr", "es", "fr", "it", "pt"]
LANG_IDS = {x: i for i, x in enumerate(LANGS)}
LANG_NAMES = {"english": 0, "russian": 1, "turkish": 2, "spanish": 3, "french": 4, "italian": 5, "portuguese": 6}

COMMENTS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(x, T.IntegerType()) for x in LABELS]
    + [T.StructField("lang", T.StringType())]
)

# Thresholds of the serving, command-line and recommended settings, in label order.
SERVING_THRESHOLDS = dict(zip(LABELS, (0.60, 0.54, 0.60, 0.48, 0.60, 0.50)))
CLI_THRESHOLDS = dict(zip(LABELS, (0.80, 0.45, 0.48, 0.42, 0.70, 0.43)))
# Offsets added to the logits of every language but English when serving.
LOGIT_OFFSETS = dict(zip(LABELS, (-0.02, 0.0, 0.02, 0.0, -0.03, 0.0)))


def lookup(values: dict, key: Column, default=None) -> Column:
    """A literal map applied to a column; the default where the key is unknown or null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def is_pos(c: str | Column) -> Column:
    """Positive label: greater than zero; null is not."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c) > 0, F.lit(False))
