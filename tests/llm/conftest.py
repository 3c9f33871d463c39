from __future__ import annotations

import pytest

DIRTY = [None, "", "   ", "\n\t", "!!! ...", "one", "a" * 60_000, "word " * 20_000, "‍​", "\U0001f600\U0001f600", "<|endoftext|>", "ﬁ ½ ＡＢ ́ x"]


@pytest.fixture(scope="session")
def dirty(spark):
    """Rows of every kind of dirt, some twice, with columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", 7, 1) for i, t in enumerate(DIRTY)] + [(100 + i, t, "train" if i % 2 else "val", None, None, None) for i, t in enumerate(DIRTY)]
    return spark.createDataFrame(rows, "row_id long, comment_text string, split string, key string, n int, id int")


@pytest.fixture(scope="session")
def nothing(dirty):
    return dirty.limit(0)
