from __future__ import annotations

import os
import re
import subprocess
import sys

import pyspark
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry
from tessella.functions import text as X

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def in_sql(sql: str) -> dict[str, set[str]]:
    lists = re.findall(r"WHEN '(..)' THEN list_filter\(ws, lambda w: w NOT IN \(((?:'(?:[^']|'')*'(?:, )?)*)\)\)", sql)
    return {x: {w.replace("''", "'") for w in re.findall(r"'((?:[^']|'')*)'", words)} - {""} for x, words in lists}


def test_lists_are_sparks(spark):
    library = {x: set(StopWordsRemover.loadDefaultStopWords(n)) for x, n in X.STOP_LISTS.items()}
    assert {x: set(words) for x, words in X.stop_words(spark).items()} == library
    assert in_sql(entry.oracle_sql()["stopwords_filter"]) == library


def test_sql_where_pyspark_lies_apart_from_its_jars(tmp_path):
    """As under SPARK_HOME/python: the SQL once had empty stop lists there."""
    here = os.path.dirname(pyspark.__file__)
    apart = tmp_path / "pyspark"
    apart.mkdir()
    for f in os.listdir(here):
        if f not in ("jars", "__pycache__"):
            os.symlink(os.path.join(here, f), apart / f)
    code = "import os, pyspark, __spark_entry__ as e; assert not os.path.exists(os.path.join(os.path.dirname(pyspark.__file__), 'jars')); print(e.oracle_sql()['stopwords_filter'])"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}", "PYTHONUTF8": "1"}
    got = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, encoding="utf-8", check=True, timeout=120).stdout.rstrip("\n")
    assert got == entry.oracle_sql()["stopwords_filter"]
    assert {x: len(words) for x, words in in_sql(got).items()} == {"en": 181, "es": 313, "fr": 156, "it": 279, "pt": 203, "ru": 151, "tr": 53}
